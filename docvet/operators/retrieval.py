"""Lexical (BM25), embedding and hybrid retrieval over a stored inverted index.

The index is built once from a chunk table. Any number of queries is answered in one job of joins: query
terms meet postings by (term, block of chunks), so that a frequent term is spread over its blocks, and
blocks whose best possible score lies under a query's threshold are never read. Cosines are blocked matrix products
of a group of queries and a group of chunks. No query passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docvet.functions.text import compute_once, prefix_snippet, snippet, stemmed_tokens
from docvet.operators.chunking import with_metadata
from docvet.operators.embeddings import EmbeddingProvider, embedding_input, record_hash
from docvet.session import COMPACT, shared_table, small_batches

# BM25 constants, context weight and phrase bonuses.
K1 = 1.2
B = 0.75
CONTEXT_WEIGHT = 0.35
TEXT_PHRASE_BONUS = 1.0
CONTEXT_PHRASE_BONUS = 0.4

# Chunks of a posting block, chunks and queries of a matrix product (powers of two).
BLOCK_BITS = 10
GROUP_BITS = 12
QUERY_GROUP = 128
# Tokens that the index build sorts at once in a task.
SLICE_TOKENS = 500_000
# Rows at most of a table that is sent to every task which reads postings; a row is a queried term or a term that a phrase needs.
FEW_ROWS = 500_000
# Slack of the threshold test: sums of doubles in another order.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """A chunk table as stored tables.

    ``documents``: doc (a number), the chunk's columns and, with a provider, vector; its tokens and their number are made of the text where they are
    read. ``postings``: term, doc, positions in text and context and context_count; made of the text's length and the number of places in it: block and
    saturation (the BM25 factor beside idf). ``blocks``: term, block, number of postings and the most that one of them can give for an idf of 1; a block of a
    term may come in parts, each with postings of its own. ``terms``: term, document_frequency.
    """

    documents: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    document_count: int
    average_length: float
    provider: EmbeddingProvider | None = None


_WORD_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8))


def _stem(token: str) -> str:
    """``stem`` of functions/text.py, for one token."""
    if len(token) > 4 and token.endswith("ies"):
        return token[:-3] + "y"
    return token[:-1] if len(token) > 3 and token.endswith("s") and not token.endswith(("ss", "us", "is")) else token


def _words(slice_bytes: int):
    """(doc, words, text_bytes), no nulls -> (doc, text_length, tokens): the tokens that ``stemmed_tokens`` gives of lower-case text, and how many of them begin in its first ``text_bytes``.

    The bytes of about ``slice_bytes``, at least one row, are looked at together; a row of them is one text.
    """

    def cut(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        inside = _WORD_BYTES[data]
        before = np.append(False, inside[:-1])[: len(inside)]
        before[offsets[:-1][offsets[:-1] < len(inside)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.append(inside[1:], False)[: len(inside)]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        ends = np.cumsum(np.flatnonzero(inside & ~after) + 1 - starts)
        tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[inside]))
        coded = tokens.dictionary_encode()
        tokens = pa.array([_stem(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        first = np.searchsorted(starts, offsets)
        length = np.searchsorted(starts, offsets[:-1] + rows["text_bytes"].to_numpy()) - first[:-1]
        return pa.RecordBatch.from_arrays([rows["doc"], pa.array(length, pa.int32()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), tokens)], names=["doc", "text_length", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words = rows["words"]
            _, places, held = words.buffers()
            offsets = np.frombuffer(places, dtype=np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset: words.offset + len(words) + 1].astype(np.int64)
            data = np.frombuffer(held, dtype=np.uint8) if held else np.empty(0, dtype=np.uint8)
            at = 0
            while at < len(rows):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1)
                yield cut(rows.slice(at, end - at), offsets[at: end + 1] - offsets[at], data[offsets[at]: offsets[end]])
                at = end

    return run


_PLACES = "term string, doc bigint, text_length int, text_at array<int>, context_at array<int>"


def _term_places(slice_tokens: int):
    """(doc, text_length, tokens) -> places of each term in each row, by term within a slice of the rows.

    A row is a whole chunk, so nothing has to meet elsewhere: a slice's tokens are sorted by (term, row), places stay ascending.
    A slice has about ``slice_tokens`` tokens, at least one row.
    """

    def slices(sizes: np.ndarray) -> Iterator[slice]:
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + slice_tokens, "right")))
            yield slice(first, last)
            first = last

    def sort(tokens: pa.ListArray, docs: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        sizes, coded = tokens.value_lengths().to_numpy(), tokens.flatten().dictionary_encode()
        alphabetic = pc.sort_indices(coded.dictionary)
        place_of = np.empty(len(alphabetic), dtype=np.int64)
        place_of[alphabetic.to_numpy()] = np.arange(len(alphabetic))
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = place_of[coded.indices.to_numpy()] * len(sizes) + row
        order = np.argsort(key, kind="stable")
        key, pos, length = key[order], pos[order], lengths[row[order]]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        in_text = pos < length

        def places(here: np.ndarray, values: np.ndarray) -> pa.ListArray:
            ends = np.cumsum(np.add.reduceat(here, starts, dtype=np.int64))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[here], pa.int32()))

        first = key[starts]
        return pa.RecordBatch.from_arrays([
            coded.dictionary.take(alphabetic).take(pa.array(first // len(sizes))), pa.array(docs[first % len(sizes)], pa.int64()),
            pa.array(length[starts], pa.int32()), places(in_text, pos), places(~in_text, pos - length),
        ], names=["term", "doc", "text_length", "text_at", "context_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch["tokens"]), 0), 0))
            tokens, docs, lengths = rows["tokens"], rows["doc"].to_numpy(), rows["text_length"].to_numpy()
            for part in slices(tokens.value_lengths().to_numpy()):
                yield sort(tokens.slice(part.start, part.stop - part.start), docs[part], lengths[part])

    return run


def _block_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and greatest ``most`` of the postings of each (term, block) of a batch."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(["term", "block"], use_threads=False).aggregate([("most", "count"), ("most", "max")])
        yield from found.select(["term", "block", "most_count", "most_max"]).rename_columns(["term", "block", "postings", "most"]).to_batches()


def build_index(chunks: DataFrame, provider: EmbeddingProvider | None = None) -> Index:
    """Index of ``chunks``; a provider adds the vectors that hybrid retrieval needs. Four tables are written, text once.

    Neither tokens nor postings are shuffled, only the terms of each task, and what follows from a stored column isn't stored.
    """
    with small_batches(chunks.sparkSession):
        return _built(chunks, provider)


def _built(chunks: DataFrame, provider: EmbeddingProvider | None) -> Index:
    context = F.concat_ws(" ", F.coalesce("path", F.lit("")), F.array_join("heading_path", " "))
    vector = {"vector": provider.vector(embedding_input(provider))} if provider else {}
    rows = compute_once(chunks, **vector) if vector else chunks
    stored = shared_table(rows.withColumn("doc", F.monotonically_increasing_id()), **COMPACT)
    made = {"text_tokens": stemmed_tokens(F.col("text")), "context_tokens": stemmed_tokens(context)}

    text = F.lower("text")
    words = stored.where("text IS NOT NULL").select("doc", F.concat(text, F.lit(" "), F.lower(context)).alias("words"), F.octet_length(text).alias("text_bytes"))
    of_words, of_tokens = _words(8 * SLICE_TOKENS), _term_places(SLICE_TOKENS)
    places = shared_table(words.mapInArrow(lambda batches: of_tokens(of_words(batches)), _PLACES).withColumns({"text_count": F.size("text_at"), "context_count": F.size("context_at")}), **COMPACT)
    counted = stored.agg(F.count("*").alias("n"), F.count("text").alias("texts")).first()
    total = places.agg(F.sum("text_count").alias("n")).first().n or 0
    average = max(total / max(counted.texts, 1), 1.0)

    length_part = K1 * (F.lit(1 - B) + B * F.greatest("text_length", F.lit(1)) / F.lit(average))
    postings = places.select(
        "term", F.shiftright("doc", BLOCK_BITS).alias("block"), "doc", (F.col("text_count") * (K1 + 1) / (F.col("text_count") + length_part)).alias("saturation"),
        "context_count", "text_at", "context_at",
    )
    most = (F.col("saturation") + CONTEXT_WEIGHT * F.col("context_count")).alias("most")
    blocks = shared_table(postings.select("term", "block", most).mapInArrow(_block_parts, "term string, block bigint, postings bigint, most double"), **COMPACT)
    terms = shared_table(blocks.groupBy("term").agg(F.sum("postings").alias("document_frequency")), **COMPACT)
    documents = stored.withColumns(made).withColumn("text_length", F.size("text_tokens"))
    return Index(documents, postings, blocks, terms, counted.n, average, provider)


def _kept_small(df: DataFrame) -> DataFrame:
    """``df``, stored; of up to ``FEW_ROWS`` rows, it goes to the tasks that read what it is joined with, which then isn't shuffled."""
    df = shared_table(df)
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct stemmed terms of each query in first-seen order; queries without terms drop out.

    Queries without an id have no result. An id that is there more than once stands for its least query.
    """
    one = queries.where("query_id IS NOT NULL").groupBy("query_id").agg(F.min("query").alias("query"))
    terms = one.select("query_id", "query", F.array_distinct(stemmed_tokens(F.col("query"))).alias("terms"))
    return terms.where(F.size("terms") > 0)


def corpus_statistics(index: Index) -> DataFrame:
    """One row: number of chunks and mean token count (at least 1)."""
    return index.documents.sparkSession.createDataFrame([(index.document_count, index.average_length)], "document_count bigint, average_length double")


def document_frequency(index: Index, prepared: DataFrame) -> DataFrame:
    """In how many chunks each queried term occurs, in text or context."""
    return index.terms.join(prepared.select(F.explode("terms").alias("term")), "term", "left_semi")


def _weighted(index: Index, prepared: DataFrame) -> DataFrame:
    """(query_id, term_pos, term, idf) of the queried terms that the index has."""
    total, frequency = F.lit(index.document_count), F.col("document_frequency")
    idf = F.log(F.lit(1.0) + (total - frequency + 0.5) / (frequency + 0.5))
    asked = prepared.select("query_id", F.posexplode("terms").alias("term_pos", "term"))
    return asked.join(index.terms, "term").select("query_id", "term_pos", "term", idf.alias("idf"))


def _surviving_blocks(index: Index, weighted: DataFrame, best: int) -> DataFrame:
    """(query_id, block) that can hold one of a query's ``best`` chunks.

    Each block of a term has a chunk that reaches the block's maximum by this term alone. So ``best`` chunks score at least the
    maximum of the term's block number ``best``, and the greatest such value among a query's terms is a threshold.
    """
    reach = weighted.join(index.blocks, "term").groupBy("query_id", "term_pos", "block").agg(F.max(F.col("idf") * F.col("most")).alias("reach"))
    order = Window.partitionBy("query_id", "term_pos").orderBy(F.desc("reach"))
    threshold = (
        reach.withColumn("n", F.row_number().over(order)).where(F.col("n") <= best).where(F.col("n") == best)
        .groupBy("query_id").agg(F.max("reach").alias("threshold"))
    )
    bound = reach.groupBy("query_id", "block").agg((F.sum("reach") + (TEXT_PHRASE_BONUS + CONTEXT_PHRASE_BONUS)).alias("bound"))
    kept = bound.join(threshold, "query_id", "left").where(F.col("bound") >= F.coalesce("threshold", F.lit(0.0)) - SLACK)
    return kept.select("query_id", "block")


def _substrings(term: Column, lengths: Column) -> Column:
    """All substrings of a term whose length is one of ``lengths``."""
    fitting = F.filter(lengths, lambda n: n <= F.length(term))
    return F.array_distinct(F.flatten(F.transform(
        fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length(term) - n + 1), lambda at: F.substring(term, at, n))
    )))


def _phrase_slots(index: Index, prepared: DataFrame) -> DataFrame:
    """(query_id, size, slot, term): indexed terms that can stand at each place of a query's joined terms.

    The joined terms are looked for as a substring of the joined tokens: the first may end a longer
    token, the last may begin one, and a single one may lie inside.
    """
    slots = prepared.select("query_id", F.size("terms").alias("size"), F.posexplode("terms").alias("slot", "needle"))
    inner = slots.where("slot > 0 AND slot < size - 1").join(index.terms.select(F.col("term").alias("needle")), "needle", "left_semi")
    found = inner.select("query_id", "size", "slot", F.col("needle").alias("term"))

    def lengths(part: DataFrame) -> Column:
        return F.coalesce(part.agg(F.collect_set(F.length("needle")).alias("n")).scalar(), F.array().cast("array<int>"))

    # The number of different lengths is at most that of the longest query term.
    for which, cut in (
        ("size > 1 AND slot = 0", lambda t, ns: F.transform(F.filter(ns, lambda n: n <= F.length(t)), lambda n: F.substring(t, F.length(t) - n + 1, n))),
        ("size > 1 AND slot = size - 1", lambda t, ns: F.transform(F.filter(ns, lambda n: n <= F.length(t)), lambda n: F.substring(t, F.lit(1), n))),
        ("size = 1", _substrings),
    ):
        part = slots.where(which)
        pieces = index.terms.select("term", lengths(part).alias("lengths")).select("term", F.explode(cut(F.col("term"), F.col("lengths"))).alias("needle"))
        found = found.unionByName(pieces.join(part, "needle").select("query_id", "size", "slot", "term"))
    return found


def phrase_bonuses(index: Index, prepared: DataFrame) -> DataFrame:
    """(query_id, doc, bonuses): chunks whose text or context holds the query's joined terms. Positions decide; no text is read."""
    met = index.postings.join(_kept_small(_phrase_slots(index, prepared)), "term")

    def starts(places: str, in_text: bool) -> Column:
        own = F.when(F.col("size") == 1, F.slice(places, 1, 1)).otherwise(F.col(places))
        return F.transform(own, lambda p: F.struct(F.lit(in_text).alias("in_text"), F.when(F.col("size") == 1, F.lit(0)).otherwise(p - F.col("slot")).alias("start")))

    at = met.select("query_id", "size", "slot", "doc", F.inline(F.concat(starts("text_at", True), starts("context_at", False)))).where("start >= 0")
    whole = at.groupBy("query_id", "doc", "in_text", "start").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n >= size")
    bonus = lambda here, points: F.coalesce(F.max(F.when(here, F.lit(points))), F.lit(0.0))
    return whole.groupBy("query_id", "doc").agg(
        F.array(bonus(F.col("in_text"), TEXT_PHRASE_BONUS), bonus(~F.col("in_text"), CONTEXT_PHRASE_BONUS)).alias("bonuses")
    )


# Sorts the phrase bonus after every term.
_PHRASE_POS = 2_000_000_000


def term_scores(index: Index, prepared: DataFrame, best: int | None = None) -> DataFrame:
    """(query_id, doc, score, matched_terms), unrounded; with ``best``, blocks without one of a query's ``best`` chunks are left out.

    A chunk of a block that is left out may come with its phrase bonus alone, which is less than its score and than the threshold.
    """
    weighted = _kept_small(_weighted(index, prepared))
    text_points = F.col("idf") * F.col("saturation")  # 0 without a place in the text
    context_points = F.col("context_count") * F.col("idf") * CONTEXT_WEIGHT
    met = index.postings.join(weighted, "term")
    points = met.select("query_id", "block", "doc", F.struct("term_pos", "term", F.array(text_points, context_points).alias("points")).alias("part"))
    if best is not None:
        points = points.join(shared_table(_surviving_blocks(index, weighted, best)), ["query_id", "block"], "left_semi")
    points = points.drop("block")
    bonus = phrase_bonuses(index, prepared).select(
        "query_id", "doc",
        F.struct(F.lit(_PHRASE_POS).alias("term_pos"), F.lit(None).cast("string").alias("term"), F.col("bonuses").alias("points")).alias("part"),
    )
    # Rows of a group are the terms of one query in one chunk: bounded by the query length. They are
    # added in query order, so equal chunks get equal scores on every run.
    grouped = points.unionByName(bonus).groupBy("query_id", "doc").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    score = F.aggregate(F.flatten(F.transform("parts", lambda p: p["points"])), F.lit(0.0), lambda acc, v: acc + v)
    terms = F.transform(F.filter("parts", lambda p: p["term"].isNotNull()), lambda p: p["term"])
    return grouped.select("query_id", "doc", score.alias("score"), terms.alias("matched_terms")).where(F.col("score") > 0)


def lexical_scores(index: Index, queries: DataFrame, best: int | None = None) -> DataFrame:
    """Lexical score of every (query, chunk) hit, or of all that can be among the ``best`` of a query, for any number of queries."""
    scores = term_scores(index, shared_table(query_terms(queries)), best)
    return scores.join(index.documents.select("doc", "chunk_id", "chunk_index"), "doc").select(
        "query_id", "chunk_id", "chunk_index", "score", "matched_terms", "doc"
    )


def top_per_query(scores: DataFrame, max_results: int, *order: Column) -> DataFrame:
    """Best rows per query; the rank filter trims each task before the shuffle."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= max_results)


_TIES = ("chunk_index", "chunk_id")


def retrieve_lexical(index: Index, queries: DataFrame, max_results: int = 5, snippet_chars: int = 240) -> DataFrame:
    """Top chunks per query by BM25, with snippets."""
    if max_results < 1 or snippet_chars < 1:
        raise ValueError("max_results and snippet_chars must be at least 1.")
    scores = lexical_scores(index, queries, max_results)
    top = top_per_query(scores, max_results, F.desc("score"), *map(F.asc, _TIES)).drop(*_TIES)
    joined = with_metadata(index.documents.drop("text_tokens", "context_tokens", "text_length", "vector").join(shared_table(top), "doc"))
    return joined.select(
        "query_id", "rank", "chunk_id", "artifact_id", "path", "chunk_index", "start_line", "end_line", "heading_path",
        F.round("score", 6).alias("score"), "matched_terms",
        snippet(F.col("text"), F.col("matched_terms"), snippet_chars).alias("snippet"), "content_hash", "metadata_hash",
    )


def _validate(max_results: int, lexical_weight: float, embedding_weight: float, snippet_chars: int) -> None:
    if max_results < 1 or snippet_chars < 1:
        raise ValueError("max_results and snippet_chars must be at least 1.")
    if lexical_weight < 0 or embedding_weight < 0 or lexical_weight + embedding_weight <= 0:
        raise ValueError("retrieval weights must not be negative and at least one must be positive.")


_HYBRID = (
    "query_id string, doc bigint, chunk_index int, chunk_id string, matched_terms string, hybrid_score double, lexical_score double, "
    "normalized_lexical_score double, embedding_score double"
)


_CELL = "doc_group bigint, doc array<bigint>, chunk_index array<int>, chunk_id array<string>, kind string, matrix binary"


def _packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """The numbers' kind and bytes, compressed: as whole millionths where these give back the same numbers, else as they are."""
    with np.errstate(all="ignore"):
        whole = np.rint(matrix * 1e6)
        if np.abs(whole).max(initial=0) < 1 << 31 and (whole / 1e6 == matrix).all():
            matrix = whole.astype(np.int32)
    shuffled = matrix.reshape(-1, 1).view(np.uint8).T.tobytes()
    return matrix.dtype.str, pa.compress(shuffled, codec="zstd", asbytes=True) if shuffled else b""


def _unpacked(kind: str, data: bytes, lines: int, width: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    plain = pa.decompress(data, lines * width * size, codec="zstd", asbytes=True) if lines * width else b""
    matrix = np.frombuffer(plain, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).reshape(lines, width)
    return matrix / 1e6 if matrix.dtype.kind == "i" else matrix


def _chunk_cells(bits: int):
    """(doc, chunk_index, chunk_id, vector) -> matrices of the chunks of a group; a group may come in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch["doc"].to_numpy() >> bits
            starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            for first, last in zip(starts, starts[1:] + [len(group)]):
                part = batch.slice(first, last - first)
                kind, data = _packed(part["vector"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(last - first, -1))
                lists = [pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), part[c].slice(0)) for c in ("doc", "chunk_index", "chunk_id")]
                yield pa.RecordBatch.from_arrays([pa.array([group[first]], pa.int64()), *lists, pa.array([kind]), pa.array([data], pa.binary())], names=[f.split()[0] for f in _CELL.split(", ")])

    return run


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.sqrt((matrix * matrix).sum(axis=1))[:, None]
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _best_of_cell(max_results: int, lexical_weight: float, embedding_weight: float):
    """Best chunks of a group of chunks for each query of a group, from cosines and the lexical scores that fall into this cell."""

    def best(chunks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        queries, hits = asked[asked["doc"].isna()].reset_index(drop=True), asked[asked["doc"].notna()]
        if not len(chunks) or not len(queries):
            return pd.DataFrame(columns=[f.split()[0] for f in _HYBRID.split(", ")])
        asked_for = np.array(queries["vector"].tolist(), dtype=float)
        vectors = np.concatenate([_unpacked(k, m, len(d), asked_for.shape[1]) for k, m, d in zip(chunks["kind"], chunks["matrix"], chunks["doc"])])
        chunks = pd.DataFrame({c: np.concatenate(chunks[c].tolist()) for c in ("doc", "chunk_index", "chunk_id")}).sort_values(["chunk_index", "chunk_id"], kind="stable")
        vectors, chunks = vectors[chunks.index], chunks.reset_index(drop=True)
        cosine = np.maximum(0.0, _unit(asked_for) @ _unit(vectors).T)
        lexical = np.zeros_like(cosine)
        line = hits["query_id"].map({q: k for k, q in enumerate(queries["query_id"])}).to_numpy(dtype=int)
        column = hits["doc"].astype("int64").map({c: k for k, c in enumerate(chunks["doc"])}).to_numpy(dtype=int)
        lexical[line, column] = hits["lexical_score"].to_numpy()
        terms = dict(zip(zip(line.tolist(), column.tolist()), hits["matched_terms"]))
        most = queries["max_score"].fillna(0.0).to_numpy()[:, None]
        normalized = np.divide(lexical, most, out=np.zeros_like(lexical), where=most > 0)
        hybrid = lexical_weight * normalized + embedding_weight * cosine
        out = []
        for q in range(len(queries)):
            score = hybrid[q]
            rows = np.flatnonzero(score > 0)
            if len(rows) > max_results:  # rounded values decide, so all that may round to the last one stay
                rows = rows[score[rows] >= np.partition(score[rows], -max_results)[-max_results] - 2e-6]
            found = [(round(float(score[c]), 6), round(float(normalized[q, c]), 6), round(float(cosine[q, c]), 6), int(c)) for c in rows]
            for h, n, e, c in sorted(found, key=lambda x: (-x[0], -x[1], -x[2], x[3]))[:max_results]:
                chunk = chunks.iloc[c]
                out.append((queries["query_id"][q], chunk["doc"], chunk["chunk_index"], chunk["chunk_id"], terms.get((q, c), ""), h, lexical[q, c], n, e))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _HYBRID.split(", ")])

    return best


def hybrid_scores(
    index: Index, queries: DataFrame, max_results: int = 5, lexical_weight: float = 0.6, embedding_weight: float = 0.4
) -> DataFrame:
    """The best rows of each group of chunks for any number of queries; queries without terms give none.

    A group of at most 2^GROUP_BITS chunks and one of about QUERY_GROUP queries meet in one task with their lexical scores, so that
    the score of each pair is known there and only the best leave it. Vectors move as compressed matrices.
    """
    if index.provider is None:
        raise ValueError("the index has no vectors; build it with a provider.")
    prepared = query_terms(queries)
    prepared = shared_table(prepared.withColumn("vector", index.provider.vector(F.col("query"))))
    groups = max(1, -(-prepared.count() // QUERY_GROUP))
    of_query, of_doc = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("query_group"), F.shiftright("doc", GROUP_BITS).alias("doc_group")
    lexical = shared_table(term_scores(index, prepared).select(
        "query_id", "doc", F.round("score", 6).alias("lexical_score"), F.array_join("matched_terms", " ").alias("matched_terms")
    ))
    top = lexical.groupBy("query_id").agg(F.max("lexical_score").alias("max_score"))
    asked = prepared.join(top, "query_id", "left").select("query_id", of_query, "vector", "max_score")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("query_group")
    chunks = index.documents.select("doc", "chunk_index", "chunk_id", "vector").mapInArrow(_chunk_cells(GROUP_BITS), _CELL).select("*", every)
    cells = index.documents.select(of_doc).distinct().select("doc_group", every)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = cells.join(asked, "query_group").select(
        "query_group", "doc_group", "query_id", none("bigint", "doc"), "vector", "max_score", none("double", "lexical_score"), none("string", "matched_terms")
    ).unionByName(lexical.select(
        of_query, of_doc, "query_id", "doc", none("array<double>", "vector"), none("double", "max_score"), "lexical_score", "matched_terms"
    ))
    key = ["query_group", "doc_group"]
    return chunks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(
        lambda left, right: _best_of_cell(max_results, lexical_weight, embedding_weight)(left, right), _HYBRID
    )


def retrieve_hybrid(
    index: Index,
    queries: DataFrame,
    max_results: int = 5,
    lexical_weight: float = 0.6,
    embedding_weight: float = 0.4,
    snippet_chars: int = 240,
) -> DataFrame:
    """Top chunks per query by weighted lexical and embedding score. Query text is not returned."""
    _validate(max_results, lexical_weight, embedding_weight, snippet_chars)
    scores = hybrid_scores(index, queries, max_results, lexical_weight, embedding_weight)
    top = top_per_query(
        scores, max_results, F.desc("hybrid_score"), F.desc("normalized_lexical_score"), F.desc("embedding_score"), *map(F.asc, _TIES),
    ).drop(*_TIES)
    terms = F.when(F.col("matched_terms") == "", F.array().cast("array<string>")).otherwise(F.split("matched_terms", " "))
    joined = with_metadata(index.documents.drop("text_tokens", "context_tokens", "text_length").join(shared_table(top.withColumn("matched_terms", terms)), "doc"))
    lexical_cut = snippet(F.col("text"), F.col("matched_terms"), snippet_chars)
    cut = F.when(F.col("lexical_score") > 0, lexical_cut).otherwise(prefix_snippet(F.col("text"), snippet_chars))
    return joined.select(
        "query_id", "rank", "chunk_id", "artifact_id", "path", "chunk_index", "start_line", "end_line", "heading_path",
        "hybrid_score", "lexical_score", "normalized_lexical_score", "embedding_score", "matched_terms",
        cut.alias("snippet"), "content_hash", "metadata_hash", record_hash(index.provider, F.col("vector"), True).alias("embedding_hash"),
    )
