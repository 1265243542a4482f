"""Line dedup by overlapping windows of three lines.

A line is what stands between line ends, and within it what stands between sentence ends, so that a passage set into other
text has lines of its own. Windows of three neighbouring lines that aren't blank are hashed. A window met again, later in the
order of (doc_id, text key, line), is a repeat, and all lines that repeats cover are removed from its document.

Each task first settles the repeats among its own documents, in blocks of bounded size, so that a window reaches the global
comparison at most once for each block, however often it occurs.

Chance makes short windows meet, so the lines that overlapping repeats cover need eight words in all: all windows are hashed, and lists,
verse, code and texts of one word a line are compared too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docvet.llm.common import row_keys, stored

#: Ends of lines and of sentences, which stay with what they end.
LINE = re.compile(r"(?<=\n)|(?<=[.!?] )")
#: Characters of scripts that have no spaces between words; two of them count as a word of a run.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Windows that a task compares among themselves at once.
BLOCK_WINDOWS = 2_000_000


def split_lines(text: str | None) -> list[str]:
    """Pieces that make up the text when joined; an empty text has none."""
    return [x for x in LINE.split(text) if x] if text else []


def window_hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first and second hash) of the windows of lines that aren't blank, without case and outer white space."""
    plain = [x.strip().lower() for x in lines]
    at = np.array([k for k, x in enumerate(plain) if x], dtype=np.int32)
    n = len(at) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(plain[k].encode("utf-8", "surrogatepass")) for k in at), dtype=np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        out = [h[:n, c].copy() for c in (0, 1)]
        for c, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            for k in range(1, size):
                out[c] *= np.uint64(odd)
                out[c] ^= out[c] >> np.uint64(31)
                out[c] += h[k:k + n, c]
    return at[:n], out[0], (out[1] >> np.uint64(32)).astype(np.int64)


def long_runs(lines: list[str], starts: np.ndarray, size: int, least_words: int) -> np.ndarray:
    """Of the sorted places of repeats among `lines`, none of them blank, those whose run of overlapping windows has enough words in all."""
    words = np.concatenate(([0], np.cumsum([max(x.strip().count(" ") + 1, len(_DENSE.findall(x)) // 2) for x in lines])))
    run = np.cumsum(np.diff(starts, prepend=starts[:1]) >= size)
    first, last = np.searchsorted(run, run, "left"), np.searchsorted(run, run, "right") - 1
    return starts[words[starts[last] + size] - words[starts[first]] >= least_words]


def _windows(size: int):
    names = ["h1", "h2", "o", "k1", "k2", "place", "later"]

    def settle(block: list[tuple]) -> pa.RecordBatch:
        """First rows of each window of the block, and the others marked as later."""
        o, k1, k2 = (np.concatenate([np.full(len(b[4]), b[c], dtype=np.int64) for b in block]) for c in (0, 1, 2))
        place = np.concatenate([b[3] for b in block])
        h1, h2 = np.concatenate([b[4] for b in block]).view(np.int64), np.concatenate([b[5] for b in block])
        order = np.lexsort((place, k2, k1, o, h2, h1))
        cols = [x[order] for x in (h1, h2, o, k1, k2, place)]
        same = np.concatenate(([False], (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])))
        group = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        own = np.all([c == c[group] for c in cols[2:]], axis=0)  # a row that is there twice is one document
        keep = ~(same & own)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*cols, same)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for b in batches:
            o, k1, k2 = (b.column(c).to_numpy() for c in range(3))
            for k, text in enumerate(b.column(3).to_pylist()):
                at, h1, h2 = window_hashes(split_lines(text), size)
                if len(h1):
                    block.append((o[k], k1[k], k2[k], at, h1, h2))
                    held += len(h1)
                if held >= BLOCK_WINDOWS:
                    yield settle(block)
                    block, held = [], 0
        if block:
            yield settle(block)

    return run


def repeated_windows(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, places): for each document with repeats, the lines at which a repeated window starts."""
    order = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(order.alias("o"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    found = stored(rows.mapInArrow(_windows(size), "h1 bigint, h2 bigint, o bigint, k1 bigint, k2 bigint, place int, later boolean"))
    # at most one row for each window and block
    firsts = found.where("NOT later").selectExpr(
        "h1", "k1", "k2", "place", "struct(o, k1, k2, place) > min(struct(o, k1, k2, place)) OVER (PARTITION BY h1, h2) AS later"
    ).where("later")
    repeats = found.where("later").select("k1", "k2", "place").unionByName(firsts.select("k1", "k2", "place"))
    return repeats.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))


def remove_repeats(
    docs: DataFrame, size: int = 3, least_words: int = 8, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "lines", removed_col: str = "removed"
) -> DataFrame:
    """`docs` with the text free of repeats, and lines (int), removed (the numbers of the removed lines, in order), in place of columns of these names.

    The first occurrence of a window stays, in the order of (doc_id with null first, text key, line); windows that overlap
    within one text count too. Overlapping repeats that cover fewer than `least_words` words in all stay; words are counted by spaces, and in scripts without
    them by two characters. Rows that agree in id and text are one document and fare alike. Texts of fewer than `size`
    lines never change; a null text stays null with 0 lines; a text whose lines are all repeats becomes empty.
    """
    spans = stored(repeated_windows(docs, size, id_col, text_col)).withColumnsRenamed({"k1": "__r1", "k2": "__r2", "places": "__places"})
    k1, k2 = row_keys(id_col, text_col)
    wide = docs.drop(lines_col, removed_col).withColumns({"__k1": k1, "__k2": k2})
    wide = wide.join(spans, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left").drop("__k1", "__k2", "__r1", "__r2")
    names = [c for c in wide.columns if c != "__places"]
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed = [], [], []
            for text, places in zip(b.column(text_col).to_pylist(), b.column("__places").to_pylist()):
                lines = split_lines(text)
                gone = np.zeros(len(lines), dtype=bool)
                if places:
                    real = np.array([k for k, x in enumerate(lines) if x.strip()], dtype=np.int64)
                    starts = np.searchsorted(real, np.array(sorted(places)))
                    starts = long_runs([lines[k] for k in real], starts, size, least_words)
                    for k in range(size):
                        gone[real[starts + k]] = True
                    text = "".join(x for x, g in zip(lines, gone.tolist()) if not g)
                texts.append(text)
                counts.append(len(lines))
                removed.append(np.flatnonzero(gone).tolist())
            columns = [pa.array(texts, pa.string()) if k == at else b.column(c) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(removed, pa.list_(pa.int32()))], [*names, lines_col, removed_col])

    fields = wide.select(*names, F.lit(0).alias(lines_col), F.array(F.lit(0)).alias(removed_col)).schema
    return wide.mapInArrow(cut, fields)
