"""Toxic spans by a linear-chain conditional random field with the labels "toxic" and "other".

Labels are known for documents only, so tokens are labelled first: words whose share of toxic documents is higher than
chance allows, over all labelled documents of the sample, are toxic tokens where they stand in a toxic document. The field is
trained on segments of such tokens. Forward-backward marginals give each token's probability; a document's score is the
greatest of them, calibrated on the sample, and its offending offsets are the runs of tokens of at least one half.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docvet.llm.common import stored, text_runs

_WORD = re.compile(r"\w+")
#: Tokens of a training segment, and buckets for each kind of feature.
SEGMENT, BUCKETS = 64, 1 << 16
#: Kinds of features: the word, its first and its last four letters, the word before and the word after.
KINDS = 5
#: Ridge of each kind; beginnings and endings say less than whole words.
RIDGE = (0.05, 5.0, 5.0, 1.0, 1.0)
#: Words that a task remembers between texts, and tokens that go through the chain at once.
KNOWN_WORDS, CHAIN_TOKENS = 300_000, 2_000_000
_LEAST = 1e-9


def features(word: str) -> tuple[int, int, int]:
    w = word.lower()
    return tuple(xxhash.xxh64_intdigest(x) % BUCKETS for x in (w, f"^{w[:4]}", f"{w[-4:]}$"))


@dataclass(frozen=True)
class Field:
    """weights[kind, bucket] of label toxic against other; move[i, j] and start[j] are potentials of label pairs and of first labels."""

    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def score(self, greatest: np.ndarray) -> np.ndarray:
        p = np.clip(greatest, _LEAST, 1 - _LEAST)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.offset)))


@dataclass
class Words:
    """Weights of words as a token, as the one before it and as the one after it, remembered by a task."""

    crf: Field
    ids: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, 1024), dtype=np.float32))

    def potentials(self, text: str) -> np.ndarray:
        """What speaks for "toxic" at each token of a whole text."""
        out = []
        for _, piece in text_runs(text):
            words = _WORD.findall(piece)
            if len(self.ids) > KNOWN_WORDS:
                self.ids.clear()
            for w in set(words).difference(self.ids):
                k = self.ids[w] = len(self.ids)
                if k == self.weights.shape[1]:
                    self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)], axis=1)
                a, b, c = features(w)
                f = self.crf.weights
                self.weights[:, k] = f[0, a] + f[1, b] + f[2, c], f[3, a], f[4, a]
            ids = self.ids
            out.append(self.weights[:, [ids[w] for w in words]] if words else np.zeros((3, 0), dtype=np.float32))
        own, before, after = np.concatenate(out, axis=1)
        total = own.astype(np.float64)
        total[1:] += before[:-1]
        total[:-1] += after[1:]
        return total


def _ratios(gain: np.ndarray, first: np.ndarray, m: np.ndarray, start: np.ndarray) -> np.ndarray:
    """r[t] = gain[t] * (m01 + r[t-1] m11) / (m00 + r[t-1] m10), anew with gain * start1 / start0 where `first`.

    Tokens lie in rows of equal length; the maps of a row are composed for all rows at once, the rows are joined one after
    another, and then all rows run again from their true beginnings.
    """
    n = len(gain)
    wide = max(1, int(math.sqrt(n)))
    rows = -(-n // wide)
    pad = rows * wide - n
    shape = lambda x, fill: np.concatenate([x, np.full(pad, fill, dtype=x.dtype)]).reshape(rows, wide).T.copy()
    g, f = shape(gain, 1.0), shape(first, False)
    a, b = np.where(f, 0.0, g * m[1, 1]), np.where(f, g * start[1], g * m[0, 1])
    c, d = np.where(f, 0.0, m[1, 0]), np.where(f, start[0], m[0, 0])
    pa_, pb, pc, pd = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(wide):
        pa_, pb, pc, pd = a[t] * pa_ + b[t] * pc, a[t] * pb + b[t] * pd, c[t] * pa_ + d[t] * pc, c[t] * pb + d[t] * pd
        top = np.maximum(np.maximum(pa_, pb), np.maximum(pc, pd))
        pa_, pb, pc, pd = pa_ / top, pb / top, pc / top, pd / top
    into, r = np.empty(rows), 1.0
    for k, (x, y, z, w) in enumerate(zip(pa_.tolist(), pb.tolist(), pc.tolist(), pd.tolist())):
        into[k] = r
        r = (x * r + y) / (z * r + w)
    out, r = np.empty_like(g), into
    for t in range(wide):
        r = out[t] = (a[t] * r + b[t]) / (c[t] * r + d[t])
    return out.T.reshape(-1)[:n]


def marginals(potentials: list[np.ndarray], crf: Field) -> np.ndarray:
    """P(toxic) of every token, for chains laid end to end; by forward and backward ratios, which is exact."""
    sizes = np.array([len(p) for p in potentials])
    gain = np.exp(np.clip(np.concatenate(potentials), -30, 30)) if len(potentials) else np.empty(0)
    if not len(gain):
        return gain
    ends = np.cumsum(sizes[sizes > 0])
    first, last = np.zeros(len(gain), dtype=bool), np.zeros(len(gain), dtype=bool)
    first[np.concatenate(([0], ends[:-1]))] = True
    last[ends - 1] = True
    m = np.exp(crf.move)
    forward = _ratios(gain, first, m, np.exp(crf.start))
    behind = _ratios(gain[::-1], last[::-1], m.T, np.ones(2))[::-1]  # with the token's own gain, which is divided out
    return 1 / (1 + gain / (forward * behind))


def _train(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, words: np.ndarray, rounds: int, rate: float) -> Field:
    """Log likelihood of all segments, climbed with AdaGrad. ids, labels: segments x SEGMENT, padded; words: id x 3 buckets."""
    count, wide = ids.shape
    real = np.arange(wide) < sizes[:, None]
    buckets = np.full((KINDS, count, wide), BUCKETS)
    for kind in range(3):
        buckets[kind] = np.where(real, words[ids, kind], BUCKETS)
    buckets[3, :, 1:], buckets[4, :, :-1] = buckets[0, :, :-1], buckets[0, :, 1:]
    weights, move, start = np.zeros((KINDS, BUCKETS + 1)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full_like(x, 1e-8) for x in (weights, move, start)]
    y = np.stack([labels == 0, labels == 1], axis=2) & real[:, :, None]
    truth_move = np.einsum("sti,stj->ij", y[:, :-1].astype(float), y[:, 1:].astype(float))
    truth_start = y[:, 0].sum(axis=0)
    for _ in range(rounds):
        e = sum(weights[k][buckets[k]] for k in range(KINDS))
        pot = np.exp(np.clip(np.stack([np.zeros_like(e), e], axis=2), -30, 30))
        m = np.exp(move)
        fwd, bwd = np.empty_like(pot), np.ones_like(pot)
        fwd[:, 0] = pot[:, 0] * np.exp(start)
        fwd[:, 0] /= fwd[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, wide):
            x = (fwd[:, t - 1] @ m) * pot[:, t]
            fwd[:, t] = np.where(real[:, t, None], x / x.sum(axis=1, keepdims=True), fwd[:, t - 1])
        for t in range(wide - 2, -1, -1):
            x = (bwd[:, t + 1] * pot[:, t + 1]) @ m.T
            bwd[:, t] = np.where(real[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
        p = fwd * bwd
        p /= p.sum(axis=2, keepdims=True)
        pairs = fwd[:, :-1, :, None] * m * (pot[:, 1:] * bwd[:, 1:])[:, :, None, :]
        pairs /= pairs.sum(axis=(2, 3), keepdims=True)
        expected = (pairs * real[:, 1:, None, None]).sum(axis=(0, 1))
        miss = np.where(real, (labels == 1) - p[:, :, 1], 0.0)
        grads = [
            np.stack([np.bincount(buckets[k].ravel(), miss.ravel(), BUCKETS + 1) for k in range(KINDS)]) - np.array(RIDGE)[:, None] * weights,
            truth_move - expected - RIDGE[0] * move, truth_start - p[:, 0].sum(axis=0) - RIDGE[0] * start,
        ]
        for x, g, s in zip((weights, move, start), grads, seen):
            s += g * g
            x += rate * g / np.sqrt(s)
        weights[:, BUCKETS] = 0
    return Field(weights[:, :BUCKETS].astype(np.float32), move, start)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a ridge logistic regression of y on z."""
    a, b = 0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * z).sum() - 0.1 * a, (y - p).sum() - 0.01 * b])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -5, 5))
    return max(a, 0.0), b


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_segments: int = 6_000, rounds: int = 60, seed: int = 5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Field:
    """A field from a sample of at most `max_labelled` labelled rows by a hash of their id, and of those at most `max_segments`
    segments with and as many without toxic tokens; the calibration uses the sample's rows.

    Null ids and labels are left out; of an id with several labels the greatest counts, and of an id with several rows one. Without toxic rows, or words that stand
    out, the field gives every document the same score, near the share of toxic rows.
    """
    spark = docs.sparkSession
    chosen = labels.selectExpr(f"CAST({id_col} AS BIGINT) AS label_id", f"CAST({label_col} AS INT) AS toxic").where("label_id IS NOT NULL AND toxic IN (0, 1)")
    chosen = chosen.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    chosen = stored(chosen.orderBy(F.xxhash64(F.lit(seed), F.col("label_id")), "label_id").limit(max_labelled))
    rows = docs.select(F.col(id_col).cast("bigint").alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # bounded by max_labelled; of an id with several rows the one with the least text hash, merged before the shuffle
    rows = rows.join(F.broadcast(chosen), "label_id").groupBy("label_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    rows = stored(rows.select("toxic", F.col("one.text").alias("text")))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = sorted({w.lower() for _, piece in text_runs(text) for w in set(_WORD.findall(piece))})
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(words), pa.int32()), pa.array(words, pa.string())], ["toxic", "word"])

    counts = stored(rows.mapInArrow(words_of, "toxic int, word string").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")))
    size, all_n, all_k = counts.agg(F.count("*"), F.sum("n"), F.sum("k")).first()
    share = (all_k or 0) / all_n if all_n else 0.0
    lexicon: set[str] = set()
    if 0 < share < 1:
        q = F.col("k") / F.col("n")
        part = lambda x, y: F.when(x > 0, x * F.log(x / F.lit(y))).otherwise(F.lit(0.0))
        surprise = F.col("n") * (part(q, share) + part(1 - q, 1 - share))
        lexicon = {r.word for r in counts.where((q > 0.75) & (surprise > math.log(size) - 2)).select("word").collect()}

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[tuple] = []
                for at, piece in text_runs(text):
                    words = [w.lower() for w in _WORD.findall(piece)]
                    for k in range(0, len(words), SEGMENT):
                        part = words[k:k + SEGMENT]
                        marks = [int(toxic and w in lexicon) for w in part]
                        out.append((max(marks), xxhash.xxh64_intdigest(" ".join(part), seed) >> 1, part, marks))
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["kind", "h", "words", "marks"])

    cut = rows.mapInArrow(segments, "kind int, h bigint, words array<string>, marks array<int>")
    held = [r for kind in (0, 1) for r in cut.where(F.col("kind") == kind).orderBy("h").limit(max_segments).collect()]
    if not lexicon or not held:
        base = chosen.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        return Field(np.zeros((KINDS, BUCKETS), dtype=np.float32), np.zeros((2, 2)), np.zeros(2), 0.0, math.log((base + 1e-6) / (1 - base + 1e-6)))
    known: dict[str, int] = {}
    ids, marks = np.zeros((len(held), SEGMENT), dtype=np.int64), np.zeros((len(held), SEGMENT), dtype=np.int8)
    for k, r in enumerate(held):
        ids[k, : len(r.words)] = [known.setdefault(w, len(known)) for w in r.words]
        marks[k, : len(r.words)] = r.marks
    sizes = np.array([len(r.words) for r in held])
    del held
    crf = _train(ids, marks, sizes, np.array([features(w) for w in known]), rounds, 0.5)

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x[0] for x in _scores(b.column(1).to_pylist(), crf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["toxic", "p"])

    held = rows.mapInArrow(greatest, "toxic int, p double").collect()  # one number for each row of the sample
    p = np.clip(np.array([r.p for r in held]), _LEAST, 1 - _LEAST)
    slope, offset = _platt(np.log(p / (1 - p)), np.array([r.toxic for r in held], dtype=np.float64))
    return Field(crf.weights, crf.move, crf.start, slope, offset)


def _scores(texts: list[str | None], crf: Field) -> list[tuple[float, list[tuple[int, int]]]]:
    """(greatest marginal, spans of tokens of at least one half as character offsets) of each text; 0 without tokens."""
    words, out, at = Words(crf), [], 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < CHAIN_TOKENS):
            group.append(words.potentials(texts[at] or ""))
            size += len(group[-1])
            at += 1
        p = marginals(group, crf)
        start = 0
        for k, potentials in enumerate(group, at - len(group)):
            own = p[start:start + len(potentials)]
            start += len(potentials)
            spans: list[tuple[int, int]] = []
            if len(own) and own.max() >= 0.5:
                toxic, index = own >= 0.5, 0
                for shift, piece in text_runs(texts[k] or ""):
                    for m in _WORD.finditer(piece):
                        if toxic[index]:
                            if spans and index and toxic[index - 1]:
                                spans[-1] = (spans[-1][0], shift + m.end())
                            else:
                                spans.append((shift + m.start(), shift + m.end()))
                        index += 1
            out.append((float(own.max()) if len(own) else 0.0, spans))
    return out


def score(docs: DataFrame, crf: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans array<struct<start, end>>): one row per row of `docs`, from the whole text alone.

    A null text is empty; a text without words has the least score. Equal texts have equal scores. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _scores(b.column(1).to_pylist(), crf)
            scores = crf.score(np.array([x for x, _ in found], dtype=np.float64))
            spans = pa.array([[{"start": s, "end": e} for s, e in x] for _, x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), spans], ["doc_id", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, spans array<struct<start: int, end: int>>")
