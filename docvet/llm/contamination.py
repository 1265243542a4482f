"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores what they join.

Test items are cut into passages of at most PASSAGE words, each of which overlaps the next by half, and taken in blocks of bounded size. All n-grams of a passage are seeds, so
that each unchanged run of n words has one, whatever other documents hold. With a `spread` above 1, of every `spread` neighbouring
n-grams that some document holds the rarest is a seed, after a pass that counts documents; edited copies then need longer unchanged runs.
A pass looks seeds up in each document; every meeting of a seed with a passage gives a window of the document, and windows that
share enough words with the passage to reach the score are aligned with it word by word. Passes are narrow: what is broadcast
is a block of test items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docvet.llm.common import byte_runs, gram_hashes, row_keys, stored, word_hashes

#: Words of a passage, and words of test items in one block.
PASSAGE, BLOCK_WORDS = 128, 1_000_000
#: Words that a task remembers, and cells of alignments that it computes at once.
KNOWN_WORDS, CELLS = 500_000, 1_000_000
#: Meetings of seeds that are looked at together, and passages whose words a task remembers.
HITS, KNOWN_PASSAGES = 1_000_000, 50_000
#: ASCII signs that are neither letters nor digits as spaces.
_PLAIN = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_PART = re.compile(rb"[^ ]+")
_TABLE_BITS = 22


def plain_text(text: str | None) -> str:
    """Lower case, without changing the number of characters."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Hash of each word of the whole text; words are runs of letters and digits in lower case."""
    out = []
    for run in byte_runs(plain_text(text).encode("utf-8", "surrogatepass")):
        if len(known) > KNOWN_WORDS:
            known.clear()
        out.append(word_hashes(run.translate(_PLAIN).split(), known))
    return np.concatenate(out) if len(out) > 1 else out[0]


@dataclass(frozen=True)
class Passages:
    """Passages of test items: row and id of the item, first word, length and words of each, end to end."""

    rows: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    words: np.ndarray

    def seeds(self, n: int, spread: int, counts: dict[int, int] | None, whole: bool = False) -> Seeds:
        """All n-grams, or the rarest of every `spread` neighbouring ones that are counted; `whole`: of passages of n words only."""
        found: dict[int, list[tuple[int, int]]] = {}
        for k, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            grams = gram_hashes(self.words[start:start + size], n).tolist()
            if whole and size != n:
                continue
            chosen = set(range(len(grams)))
            if counts is not None:
                rank = [(counts.get(g, 0), g) for g in grams]
                runs = ([x for x in range(a, min(a + spread, len(grams))) if rank[x][0]] for a in range(max(1, len(grams) - spread + 1)))
                chosen = {min(run, key=rank.__getitem__) for run in runs if run}
            for at in sorted(chosen):
                found.setdefault(grams[at], []).append((k, at))
        keys = np.array(sorted(found), dtype=np.uint64)
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[keys >> np.uint64(64 - _TABLE_BITS)] = True
        first = np.concatenate(([0], np.cumsum([len(found[k]) for k in keys.tolist()]))).astype(np.int64)
        pairs = np.array([p for k in keys.tolist() for p in found[k]], dtype=np.int64).reshape(-1, 2)
        return Seeds(keys, table, first, pairs[:, 0], pairs[:, 1])


@dataclass(frozen=True)
class Seeds:
    """Sorted n-gram hashes, a table of their upper bits, and the passages and places of each."""

    keys: np.ndarray
    table: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray

    def hits(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the document, passage, place in the passage) of every meeting, in parts of bounded size."""
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - _TABLE_BITS)])
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)  # without keys the table lets nothing through
        real = self.keys[key] == grams[at]
        at, key = at[real], key[real]
        ends = np.cumsum(self.first[key + 1] - self.first[key]) if len(at) else at
        low = 0
        while low < len(at):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + HITS, "right")))
            own, many = key[low:high], np.diff(ends[low:high], prepend=before)
            rows = np.repeat(self.first[own] - (ends[low:high] - many - before), many) + np.arange(many.sum())
            yield np.repeat(at[low:high], many), self.passage[rows], self.place[rows]
            low = high


def align(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best score, end in left, end in right) of local alignments of rows of words: 1 for a match, -1 for a change or a gap.

    Zeros pad and match nothing. Gaps within a row follow from a running maximum, so that a row of cells is one step.
    """
    count, wide = right.shape
    steps = np.arange(wide, dtype=np.int32)
    above = np.zeros((count, wide + 1), dtype=np.int32)
    best, end_l, end_r = (np.zeros(count, dtype=np.int32) for _ in range(3))
    for i in range(left.shape[1]):
        w = left[:, i:i + 1]
        cell = np.maximum(above[:, :-1] + np.where((right == w) & (w != 0), 1, -1), above[:, 1:] - 1)
        cell = np.maximum(cell, 0)
        cell = np.maximum.accumulate(cell + steps, axis=1) - steps
        top = cell.argmax(axis=1)
        value = cell[np.arange(count), top]
        better = value > best
        best[better], end_l[better], end_r[better] = value[better], i + 1, top[better] + 1
        above[:, 1:] = cell
    return best, end_l, end_r


def _windows(at: np.ndarray, passage: np.ndarray, place: np.ndarray, p: Passages, words: np.ndarray, need: np.ndarray, own: dict) -> list[tuple[int, int, int]]:
    """(passage, from, to) windows of a document around its hits that hold as many words of the passage as the score needs matches.

    Words of a passage are looked up once for all its hits, so that a phrase that many passages share costs a scan of the document for
    each of them at most, not one for each meeting. Windows that overlap for one passage are one, unless it gets too long.
    """
    length = p.sizes[passage]
    margin = length // 4 + 3
    low, high = np.maximum(at - place - margin, 0), np.minimum(at - place + length + margin, len(words))
    order = np.lexsort((low, passage))
    passage, low, high = passage[order], low[order], high[order]
    cuts = np.flatnonzero(np.diff(passage)) + 1
    out: list[tuple[int, int, int]] = []
    for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(passage)]):
        k = int(passage[first])
        if k not in own:
            if len(own) >= KNOWN_PASSAGES:
                own.clear()
            own[k] = np.unique(p.words[p.starts[k]:p.starts[k] + p.sizes[k]])
        a, b = low[first:last], high[first:last]
        start, stop = int(a[0]), int(b.max())
        part = words[start:stop]
        spot = np.minimum(np.searchsorted(own[k], part), len(own[k]) - 1)
        inside = np.concatenate(([0], np.cumsum(own[k][spot] == part)))
        fit = inside[b - start] - inside[a - start] >= need[k]
        begin = len(out)
        for x, z in zip(a[fit].tolist(), b[fit].tolist()):
            if len(out) > begin and x <= out[-1][2] - p.sizes[k] and z - out[-1][1] <= 4 * PASSAGE:
                out[-1] = (k, out[-1][1], max(z, out[-1][2]))
            elif len(out) == begin or out[-1] != (k, x, z):
                out.append((k, x, z))
    return out


def find_matches(texts: list[str | None], p: Passages, seeds: dict[int, Seeds], need: np.ndarray) -> dict[int, dict[int, tuple[float, int, int]]]:
    """text number -> row of an item -> (score, first word, word after the last) of the best passage; need: least alignment of each passage.

    Seeds are given by their number of words.
    """
    known: dict[bytes, int] = {}
    found: dict[int, dict[int, tuple[float, int, int]]] = {}
    queue: list[tuple[int, int, int, np.ndarray]] = []
    own: dict[int, np.ndarray] = {}

    def flush() -> None:
        queue.sort(key=lambda q: (p.sizes[q[1]], len(q[3])))
        at = 0
        while at < len(queue):
            part, cells = [], 0
            while at < len(queue) and (not part or cells < CELLS):
                part.append(queue[at])
                cells = len(part) * len(queue[at][3]) + 1
                at += 1
            left = np.zeros((len(part), max(int(p.sizes[k]) for _, k, _, _ in part)), dtype=np.uint64)
            right = np.zeros((len(part), max(len(w) for *_, w in part)), dtype=np.uint64)
            for r, (_, k, _, w) in enumerate(part):
                left[r, : p.sizes[k]] = p.words[p.starts[k]:p.starts[k] + p.sizes[k]]
                right[r, : len(w)] = w
            best, end_l, end_r = align(left, right)
            good = np.flatnonzero(best >= need[[k for _, k, _, _ in part]])
            if len(good):
                back_l, back_r = np.zeros_like(left[good]), np.zeros_like(right[good])
                for r, g in enumerate(good):
                    back_l[r, : end_l[g]], back_r[r, : end_r[g]] = left[g, : end_l[g]][::-1], right[g, : end_r[g]][::-1]
                _, _, size = align(back_l, back_r)
                for g, s in zip(good.tolist(), size.tolist()):
                    text, k, low, _ = part[g]
                    mine, item = found.setdefault(text, {}), int(p.rows[k])
                    hit = (float(best[g] / p.sizes[k]), low + int(end_r[g]) - s, low + int(end_r[g]))
                    if item not in mine or (-hit[0], hit[1]) < (-mine[item][0], mine[item][1]):
                        mine[item] = hit
        queue.clear()

    cells = 0
    for t, text in enumerate(texts):
        words = words_of(text, known)
        for n, some in seeds.items():
            for hits in some.hits(gram_hashes(words, n)):
                for k, a, b in _windows(*hits, p, words, need, own):
                    queue.append((t, k, a, words[a:b]))
                    cells += b - a
                if cells > 4 * CELLS:
                    flush()
                    cells = 0
    flush()
    return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Passages]:
    """Test items as passages, in blocks of about BLOCK_WORDS words; the driver holds one block."""
    known: dict[bytes, int] = {}
    rows, items, sizes, words, held = [], [], [], [], 0

    def block() -> Passages:
        size = np.array(sizes, dtype=np.int64)
        return Passages(np.array(rows, dtype=np.int64), np.array(items, dtype=np.int64), np.cumsum(size) - size, size, np.concatenate(words))

    for row, r in enumerate(benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL").toLocalIterator()):
        w = words_of(r.text, known)
        w[w == 0] = 1
        for at in range(0, max(1, len(w) - PASSAGE // 2), PASSAGE // 2):
            part = w[at:at + PASSAGE]
            if len(part):
                rows.append(row)
                items.append(r.item_id)
                sizes.append(len(part))
                words.append(part)
                held += len(part)
        if held >= BLOCK_WORDS:
            yield block()
            rows, items, sizes, words, held = [], [], [], [], 0
    if items:
        yield block()


def _counts(docs: DataFrame, p: Passages, n: int, text_col: str) -> dict[int, int]:
    """Documents that hold each n-gram of the passages, over all rows of `docs`."""
    spark = docs.sparkSession
    grams = np.unique(np.concatenate([gram_hashes(p.words[s:s + z], n) for s, z in zip(p.starts.tolist(), p.sizes.tolist())]))
    table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    table[grams >> np.uint64(64 - _TABLE_BITS)] = True
    sent = spark.sparkContext.broadcast((grams, table))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = sent.value
        known: dict[bytes, int] = {}
        total = np.zeros(len(keys), dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                g = gram_hashes(words_of(text, known), n)
                g = g[seen[g >> np.uint64(64 - _TABLE_BITS)]]
                at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                total[np.unique(at[keys[at] == g])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {int(grams[r.gram]): r.n for r in rows}


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.5, n: int = 3, spread: int = 1, least_words: int = 8, enough: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, k1, k2, item_id, score, start, end): a row for each document and test item whose best local alignment reaches `least`,
    or counts `enough` words of the passage.

    The score is the alignment's (matches less changes and gaps) over the passage's words; start and end are character offsets.
    A copy is seen if it has an unchanged run of `n` words. Test items of fewer than `least_words` words are found as a whole and
    unchanged only; those without words or with a null id are not looked for; null and empty texts match nothing.
    Repeated documents and repeated test items each have their rows. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    fields = "doc_id bigint, k1 bigint, k2 bigint, item_id bigint, score double, start bigint, end bigint"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    out = None
    for p in _blocks(benchmark, item_col, item_text_col):
        seeds = {n: p.seeds(n, spread, _counts(docs, p, n, text_col) if spread > 1 else None)}
        seeds |= {k: p.seeds(k, 1, None, whole=True) for k in range(1, n) if (p.sizes == k).any()}
        need = np.where(p.sizes < least_words, p.sizes, np.minimum(np.ceil(least * p.sizes - 1e-9), enough))
        sent = spark.sparkContext.broadcast((p, seeds, need))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            passages, seeds, need = sent.value
            item_of = dict(zip(passages.rows.tolist(), passages.items.tolist()))
            for b in batches:
                texts = b.column(3).to_pylist()
                hits = find_matches(texts, passages, seeds, need)
                found = []
                for t, items in sorted(hits.items()):
                    data = plain_text(texts[t]).encode("utf-8", "surrogatepass")
                    spans = [m.span() for m in _PART.finditer(data.translate(_PLAIN))]
                    offset = lambda x: len(data[:x].decode("utf-8", "surrogatepass"))  # noqa: E731, B023
                    for row, (score, a, z) in sorted(items.items()):
                        found.append((*(b.column(c)[t].as_py() for c in range(3)), item_of[row], score, offset(spans[a][0]), offset(spans[z - 1][1])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["doc_id", "k1", "k2", "item_id", "score", "start", "end"])

        leaks = rows.mapInArrow(look, fields)
        out = leaks if out is None else out.union(leaks)
    return out if out is not None else spark.createDataFrame([], fields)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **finding) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns; rows that agree in id and text fare alike."""
    leaks = stored(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **finding).selectExpr("k1 AS __r1", "k2 AS __r2").distinct())
    k1, k2 = row_keys(id_col, text_col)
    wide = docs.withColumns({"__k1": k1, "__k2": k2})
    return wide.join(leaks, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left_anti").drop("__k1", "__k2")
