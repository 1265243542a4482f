"""Packing of documents into windows by non-negative least squares.

Whole windows are cut off each document first. What remains of them, shorter than a window, is sorted into length classes;
combinations of up to three classes that fill a window are enumerated, and how often to repeat each is the non-negative
least-squares fit of their sums to the histogram of the classes. Repeats are rounded down, and what they leave is packed
greedily: laid end to end and cut at windows, the last one at powers of two, which need no padding.

Each task packs its own documents in blocks of bounded size, so that no text or token is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

#: Tokens that a task packs together.
BLOCK_TOKENS = 16_000_000
#: Tokens of a length class: the most padding that one piece can cause in a window made from classes.
CLASS = 8
#: White space of a length that the pattern's backtracking can't take is left to the tokenizer file.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")
FIELDS = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """Byte-level BPE from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def whole_encoder(path: str) -> Tokenizer:
    """The same vocabulary and merges from a tokenizer file; slower, but its stack doesn't grow with a run of white space."""
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=4)
def combinations(classes: int) -> np.ndarray:
    """Rows of one to three classes (1..classes) that sum to `classes`; zeros fill up."""
    rows = [(classes, 0, 0)] + [(a, classes - a, 0) for a in range(1, classes // 2 + 1)]
    rows += [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    return np.array(rows, dtype=np.int64)


def repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = 40) -> np.ndarray:
    """x >= 0 with the least squared distance of the combinations' sums to `histogram` (index 0 unused): active sets, several columns at once."""
    n = len(histogram)
    target = histogram.astype(np.float64)
    target[0] = 0
    x = np.zeros(len(combos))
    active = np.zeros(len(combos), dtype=bool)
    used = (target > 0)
    used[0] = True
    able = used[combos].all(axis=1)

    def matrix(columns: np.ndarray) -> np.ndarray:
        m = np.zeros((n, len(columns)))
        for k in range(combos.shape[1]):
            np.add.at(m, (combos[columns, k], np.arange(len(columns))), 1.0)
        m[0] = 0
        return m

    for _ in range(rounds):
        now = np.flatnonzero(active)
        rest = target - matrix(now) @ x[now]
        rest[0] = 0
        gain = np.where(able & ~active, rest[combos].sum(axis=1), 0.0)
        if gain.max(initial=0) <= 1e-6 * max(1.0, target.max()):
            break
        taken = np.zeros(n, dtype=bool)
        for c in np.argsort(-gain)[: 4 * n].tolist():
            if gain[c] <= 0:
                break
            own = [k for k in combos[c].tolist() if k]
            if not taken[own].any():
                taken[own] = True
                active[c] = True
        while True:
            now = np.flatnonzero(active)
            m = matrix(now)
            z = np.linalg.solve(m.T @ m + 1e-8 * np.eye(len(now)), m.T @ target)
            if (z > 1e-9).all():
                x[now] = z
                break
            bad = z <= 1e-9
            step = np.min(x[now][bad] / np.maximum(x[now][bad] - z[bad], 1e-12), initial=1.0)
            x[now] += step * (z - x[now])
            drop = now[x[now] <= 1e-9]
            if not len(drop):
                drop = now[bad]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def plan(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset, number of sequences) for pieces shorter than a window; sequence -1 for those that no combination takes."""
    classes = window // CLASS
    of = -(-sizes // CLASS)
    combos = combinations(classes)
    count = np.floor(repeats(np.bincount(of, minlength=classes + 1), combos) + 1e-6).astype(np.int64)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(classes + 2))
    next_, end = first[:-1].copy(), first[1:]
    sequence, offset, made = np.full(len(sizes), -1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), 0
    for c in np.argsort(-count, kind="stable").tolist():
        if not count[c]:
            break
        own = [k for k in combos[c].tolist() if k]
        n = min([count[c], *((end[k] - next_[k]) // own.count(k) for k in own)])
        at = np.zeros(n, dtype=np.int64)
        for k in own:
            rows = order[next_[k]:next_[k] + n]
            next_[k] += n
            sequence[rows], offset[rows] = made + np.arange(n), at
            at = at + sizes[rows]
        made += n
    return sequence, offset, made


def pack_block(tokens: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Documents of so many tokens -> (document, start, length, sequence, offset) of pieces in document order that lose no token."""
    full = tokens // window
    doc = np.repeat(np.arange(len(tokens)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * window
    made = len(doc)
    parts = [(doc, start, np.full(made, window, dtype=np.int64), np.arange(made), np.zeros(made, dtype=np.int64))]
    short = np.flatnonzero(tokens % window)
    sizes, at = tokens[short] % window, full[short] * window
    sequence, offset, count = plan(sizes, window)
    fit = sequence >= 0
    parts.append((short[fit], at[fit], sizes[fit], made + sequence[fit], offset[fit]))
    made += count
    rest = np.flatnonzero(~fit)
    if len(rest):
        ends = np.concatenate(([0], np.cumsum(sizes[rest])))
        total = int(ends[-1])
        cuts = list(range(0, total - total % window + 1, window))
        tail = total % window
        for bit in range(window.bit_length(), -1, -1):
            if tail >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
        cuts = np.array(cuts, dtype=np.int64)
        points = np.unique(np.concatenate([ends, cuts]))
        low, high = points[:-1], points[1:]
        piece, run = np.searchsorted(ends, low, "right") - 1, np.searchsorted(cuts, low, "right") - 1
        parts.append((short[rest[piece]], at[rest[piece]] + low - ends[piece], high - low, made + run, low - cuts[run]))
    out = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all rows of `docs`: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    A document is its ids and then `end_id`; a null or empty text is that id alone. Each id lies in one piece, and the pieces of
    a sequence follow one another from offset 0. A sequence that isn't full and has no power of two of ids is to be padded.
    `vocabulary` is a file of ranks and `tokenizer` the tokenizer file with the same ids, for texts with very long runs of white space; every worker can read both. sequence_id holds the task's number in its upper bits; repeated
    rows are packed one by one; an empty table gives no rows; other columns are not read.
    """
    if window % CLASS or window & (window - 1):
        raise ValueError("the window must be a power of two and hold whole classes")

    def pieces(ids: list, doc_ids: list, base: int) -> Iterator[pa.RecordBatch]:
        tokens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.concatenate(ids)
        doc, start, length, sequence, offset = pack_block(tokens, window)
        offsets = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u4", copy=False))])
        columns = [
            pa.array(doc_ids, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), data, pa.array(tokens[doc]), pa.array(base + sequence), pa.array(offset),
        ]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        batch = pa.RecordBatch.from_arrays(columns, names)
        for k in range(0, batch.num_rows, 2000):
            yield batch.slice(k, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = encoder(vocabulary, pattern).encode_ordinary

        def encode(text: str) -> list[int]:
            if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
                return whole_encoder(tokenizer).encode(text, add_special_tokens=False).ids
            return ordinary(text)

        last = np.array([end_id], dtype=np.uint32)
        base = TaskContext.get().partitionId() << 36
        ids, doc_ids, held = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.concatenate([np.array(encode(text), dtype=np.uint32), last]) if text else last
                ids.append(own)
                doc_ids.append(doc_id)
                held += len(own)
                if held >= BLOCK_TOKENS:
                    yield from pieces(ids, doc_ids, base)
                    base += held  # more than the block has sequences
                    ids, doc_ids, held = [], [], 0
        if ids:
            yield from pieces(ids, doc_ids, base)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, FIELDS)
