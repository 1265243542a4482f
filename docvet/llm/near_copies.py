"""Near copies by the Jaccard similarity of word shingles: MinHash bands name candidates, whole shingle sets decide.

Texts with the same set of shingles are one node. A document has BANDS keys of WIDE minima each; nodes that share a key are joined to
the least of them, and the components of these stars are clusters: two nodes as similar as `least` are in one cluster, but
for a chance of 3 in a million at 0.8. Sets are made for members of clusters only. A cluster is cut into parts of bounded size; a task
compares the sets of one part and of the cluster's least node exactly, and leaves out pairs that are already connected. Parts are compared
with each other where a cluster is not yet connected, and then all but its largest piece with everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docvet.llm.common import byte_runs, components, gram_hashes, row_keys, stored, word_hashes

#: Keys of a document, and minima in each.
BANDS, WIDE = 32, 5
#: Words that a task remembers; nodes and shingles of a part, on average.
KNOWN_WORDS, PART_NODES, PART_SHINGLES = 500_000, 256, 400_000
#: Shingles that are hashed at once.
_RUN = 2_048
_ODD = np.random.default_rng(20).integers(1, 1 << 63, (2, BANDS * WIDE, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words of the lower-cased (A-Z) text; a shorter text is one run, one without words none."""
    out = []
    for run in byte_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        if len(known) > KNOWN_WORDS:
            known.clear()
        out.append(word_hashes(run.split(), known))
    found = np.concatenate(out)
    return np.unique(gram_hashes(found, min(words, len(found)))) if len(found) else found


def band_keys(grams: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(grams):
        return []
    least = np.full(BANDS * WIDE, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), _RUN):
            least = np.minimum(least, ((grams[at:at + _RUN] ^ _ODD[0]) * _ODD[1]).min(axis=1))
    return [xxhash.xxh64_intdigest(least[k * WIDE:(k + 1) * WIDE].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def connect(sets: list[np.ndarray], least: float, pieces: list[int], left: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join what is as similar as `least`: a spanning forest beside `pieces`, numbers of what is connected before.

    With `left`, the first `left` sets are compared with the others only.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark, piece, out = np.zeros(len(values), dtype=bool), np.array(pieces), []
    for i in range(len(sets) if left is None else left):
        ahead = slice(i + 1 if left is None else left, len(sets))
        if not (piece[ahead] != piece[i]).any():
            continue
        own = place[starts[i]:starts[i] + sizes[i]]
        mark[own] = True
        common = np.add.reduceat(mark[place[starts[ahead.start]:]], starts[ahead] - starts[ahead.start], dtype=np.int64)
        mark[own] = False
        for j in (np.flatnonzero(common >= least * (sizes[i] + sizes[ahead] - common) - 1e-9) + ahead.start).tolist():
            if piece[j] != piece[i]:
                out.append((i, j))
                piece[piece == piece[j]] = piece[i]
    return out


def _links(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Columns s, grams, and, where two sides are compared, side (0 or 1) and piece."""
        s, grams = table.column("s").to_numpy(), [np.array(g, dtype=np.int64).view(np.uint64) for g in table.column("grams").to_numpy()]
        left, piece = None, np.arange(len(s))
        if "side" in table.column_names:
            side = table.column("side").to_numpy()
            order, left = np.argsort(side, kind="stable"), int((side == 0).sum())
            s, grams, piece = s[order], [grams[k] for k in order], np.unique(table.column("piece").to_numpy()[order], return_inverse=True)[1]
        found = connect(grams, least, piece.tolist(), left) if len(s) > 1 and left != len(s) else []
        return pa.table({"a": pa.array([int(s[i]) for i, _ in found], pa.int64()), "b": pa.array([int(s[j]) for _, j in found], pa.int64())})

    return run


def _between(held: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Links between parts of clusters of several parts that `links` leave in several pieces."""
    many = held.where("parts > 1")
    pieces = components(links)
    known = stored(many.join(pieces.withColumnRenamed("node", "s").withColumnRenamed("root", "piece"), "s", "left").selectExpr("root", "s", "part", "parts", "coalesce(piece, s) AS piece"))
    sizes = known.groupBy("root", "piece").agg(F.count("*").alias("n"))
    largest = stored(sizes.groupBy("root").agg(F.count("*").alias("count"), F.max(F.struct("n", "piece")).alias("top")).where("count > 1").selectExpr("root", "top.piece AS top"))
    open_ = many.join(known.select("s", "piece"), "s").join(largest, "root").withColumn("rest", F.expr("piece <> top"))
    open_ = stored(open_)
    from_parts = stored(open_.where("rest").selectExpr("root", "part AS x").distinct())
    left = open_.where("rest").select("root", F.col("part").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"), F.lit(0).alias("side"), "s", "piece", "grams")
    right = open_.join(from_parts, "root").where("part > x OR NOT rest").select("root", "x", F.col("part").alias("y"), F.lit(1).alias("side"), "s", "piece", "grams")
    both = left.where("x <> y").unionByName(right.where("x <> y"))
    return both.groupBy("root", "x", "y").applyInArrow(_links(least), "a bigint, b bigint")


def similar(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, component_id, head): one row per row of `docs`; documents are linked by a Jaccard similarity of at least `least`.

    component_id is the least doc_id reachable by links, head marks the row that stands for its class. Texts without words are one class,
    shorter ones than `words` words are linked if their words agree. Repeated rows are heads together. An empty table gives no rows.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            sets = [shingles(t, words, known) for t in b.column(3).to_pylist()]
            s = pa.array([xxhash.xxh64_intdigest(g.tobytes()) - (1 << 63) for g in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], s, pa.array([len(g) for g in sets], pa.int64()), pa.array([band_keys(g) for g in sets], pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "s", "size", "bands"]
            )

    k1, k2 = row_keys(id_col, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), k1, k2, F.col(text_col).alias("text"))
    rows = stored(rows.mapInArrow(sign, "doc_id bigint, k1 bigint, k2 bigint, s bigint, size bigint, bands array<bigint>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    nodes = stored(rows.groupBy("s").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), first.alias("first")))

    members = nodes.select("s", F.explode("bands").alias("band"))
    hubs = stored(members.groupBy("band").agg(F.count("*").alias("n"), F.min("s").alias("hub")).where("n > 1").drop("n"))
    clusters = stored(components(stored(members.join(hubs, "band").where("s <> hub").selectExpr("s AS a", "hub AS b").distinct())).withColumnRenamed("node", "s"))
    sized = clusters.join(nodes.select("s", "size"), "s").groupBy("root").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    parts = stored(sized.selectExpr("root", f"CAST(ceil(greatest(size / {PART_SHINGLES}, n / {PART_NODES})) AS INT) AS parts"))
    wanted = clusters.join(parts, "root").join(nodes.selectExpr("s", "first.k1 AS k1", "first.k2 AS k2"), "s")
    wanted = stored(wanted.withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            sets = pa.array([shingles(t, words, known).view(np.int64) for t in b.column(4).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], sets], ["root", "s", "part", "parts", "grams"])

    texts = docs.select(k1, k2, F.col(text_col).alias("text")).dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"])
    held = stored(texts.select("root", "s", "part", "parts", "text").mapInArrow(make, "root bigint, s bigint, part int, parts int, grams array<bigint>"))
    hub = held.where("s = root AND parts > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("to <> part")
    inner = held.select("root", "part", "s", "grams").unionByName(hub.select("root", F.col("to").alias("part"), "s", "grams"))
    links = stored(inner.groupBy("root", "part").applyInArrow(_links(least), "a bigint, b bigint"))
    if not parts.where("parts > 1").isEmpty():
        links = stored(links.unionByName(_between(held, links, least)))

    known = stored(nodes.join(components(links).withColumnRenamed("node", "s").withColumnRenamed("root", "class"), "s", "left").selectExpr("s", "first", "coalesce(class, s) AS class"))
    heads = stored(known.groupBy("class").agg(F.min("first").alias("first")))
    classes = stored(known.drop("first").join(heads, "class").select("s", "first"))
    return rows.join(classes, "s").selectExpr("doc_id", "k1", "k2", "first.doc_id AS component_id", "k1 = first.k1 AND k2 = first.k2 AS head")


def keep_one(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near copies, with all its columns: the least doc_id (null last), then the least text key.

    Repeated rows are one document. They are merged before the shuffle, so that a row held many times doesn't meet in one task.
    """
    heads = stored(similar(docs, least, words, id_col, text_col).where("head").selectExpr("k1 AS __r1", "k2 AS __r2").distinct())
    k1, k2 = row_keys(id_col, text_col)
    rows = docs.withColumns({"__k1": k1, "__k2": k2}).dropDuplicates(["__k1", "__k2"])
    kept = rows.join(heads, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left_semi")
    return kept.drop("__k1", "__k2")
