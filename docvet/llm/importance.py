"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The target model counts hashed words, word pairs and their shapes in labelled good documents, the raw model those in all
documents. A document's log weight is the mean log ratio of the two models over its n-grams, times `sharpness` n-grams; Gumbel noise
that follows from its id and text is added, and the k greatest are the sample. k is the number of documents whose
noise-free weight is over a level set between the labelled good and bad documents, so that it grows with the input.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docvet.llm.common import byte_runs, gram_hashes, row_keys, stored

#: Words that a task remembers, beside those of the run of text that it reads.
KNOWN_WORDS = 500_000
#: Buckets for the shapes of words and of word pairs, after those for words.
SHAPE_BUCKETS = 4096
#: Stands for a pair of equal words, whichever word it is.
_REPEAT = np.uint64(0x5EED5EED5EED5EED)
_SHAPE = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)


def word_shape(word: bytes) -> str:
    """Case of a word's letters, whether it has digits, and the signs around them."""
    lead, core, trail = _SHAPE.match(word.decode("utf-8", "replace")).groups()
    case = "-" if not core else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa" if core[0].isupper() and core[1:].islower() else "?"
    return f"{lead[:4]}|{case}{'0' * any(c.isdigit() for c in core)}|{trail[:4]}"


class Words:
    """Hashes of words and of their shapes, remembered by a task."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.hashes = np.zeros((2, 1024), dtype=np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > KNOWN_WORDS:
            self.ids.clear()
        ids, digest = self.ids, xxhash.xxh64_intdigest
        for w in set(words).difference(ids):
            k = ids[w] = len(ids)
            if k == self.hashes.shape[1]:
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
            self.hashes[0, k], self.hashes[1, k] = digest(w), digest(word_shape(w))
        return self.hashes[:, [ids[w] for w in words]]


def gram_buckets(text: str | None, buckets: int, words: Words) -> np.ndarray:
    """Bucket of each word and neighbouring pair, and of their shapes, of a whole text; case and signs count."""
    out, last, size = [], None, np.uint64(buckets - SHAPE_BUCKETS)
    for run in byte_runs((text or "").encode("utf-8", "surrogatepass")):
        parts = run.split()
        if not parts:
            continue
        h, s = words.of(parts)
        both = np.stack([h, s]) if last is None else np.concatenate([last, [h, s]], axis=1)
        pairs = gram_hashes(both[0], 2)
        pairs[both[0][1:] == both[0][:-1]] = _REPEAT
        out += [h % size, pairs % size, size + s % np.uint64(SHAPE_BUCKETS), size + gram_hashes(both[1], 2) % np.uint64(SHAPE_BUCKETS)]
        last = np.array([[h[-1]], [s[-1]]])
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


@dataclass(frozen=True)
class Model:
    """log ratio of target to raw for each bucket; the level over which a weight counts as good; parameters of the weights."""

    ratios: np.ndarray
    level: float
    sharpness: float
    seed: int

    def weight(self, grams: np.ndarray) -> float:
        """Log weight of a document; without words it is 0, as likely in either model."""
        return float(self.ratios[grams].mean() * self.sharpness) if len(grams) else 0.0


def _gumbel(keys: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise from 64-bit row keys."""
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return -np.log(-np.log((z >> np.uint64(11)).astype(np.float64) / float(1 << 53) + 2.0**-54))


def fit(
    docs: DataFrame, labels: DataFrame, buckets: int = 10_000 + SHAPE_BUCKETS, max_labelled: int = 20_000, sharpness: float = 100.0, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Models over whole texts: the raw one of all rows of `docs`, the target one of a sample of at most `max_labelled` labelled rows.

    Of the sample, by a hash of the id, two thirds of the good documents make the target model; the others and the bad ones set
    the level. Without labels of both kinds the level is 0. Null labels and ids are not labels; of an id with several labels
    the least counts, and of an id with several rows one. What the driver gets is one sum for each bucket and one weight for each labelled row.
    """
    spark = docs.sparkSession
    chosen = labels.selectExpr(f"CAST({id_col} AS BIGINT) AS label_id", f"CAST({label_col} AS INT) AS good").where("label_id IS NOT NULL AND good IN (0, 1)")
    chosen = chosen.groupBy("label_id").agg(F.min("good").alias("good")).withColumn("h", F.xxhash64(F.lit(seed), F.col("label_id")))
    chosen = stored(chosen.orderBy("h", "label_id").limit(max_labelled))
    rows = docs.select(F.col(id_col).cast("bigint").alias("label_id"), F.col(text_col).alias("text"))
    # bounded by max_labelled rows of 20 bytes; of an id with several rows the one with the least text hash, merged before the shuffle
    labelled = rows.join(F.broadcast(chosen), "label_id").groupBy("label_id", "good", "h").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    kind = F.when(F.col("good") == 1, F.when(F.pmod("h", F.lit(3)) < 2, F.lit(1)).otherwise(F.lit(2))).otherwise(F.lit(3)).alias("kind")
    labelled = stored(labelled.select(kind, F.col("one.text").alias("text")))
    rows = rows.select(F.lit(0).alias("kind"), "text").unionByName(labelled.where("kind = 1"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.bincount(gram_buckets(text, buckets, known), minlength=buckets)
                if kind == 1:
                    target += n
                else:
                    raw += n
        at = np.flatnonzero(raw + target)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in sums.toLocalIterator():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    model = Model(np.log(target / target.sum()) - np.log(raw / raw.sum()), 0.0, sharpness, seed)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            w = [model.weight(gram_buckets(t, buckets, known)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64())], ["kind", "w"])

    held = labelled.where("kind > 1").mapInArrow(weigh, "kind int, w double").collect()
    return Model(model.ratios, _level([r.w for r in held if r.kind == 2], [r.w for r in held if r.kind == 3]), sharpness, seed)


def _level(good: list[float], bad: list[float]) -> float:
    """Between the two kinds where the sum of the shares of wrongly placed ones is least; the middle of the widest such gap, nearer to the bad ones."""
    if not good or not bad:
        return 0.0
    values = np.array(sorted({*good, *bad}))
    g, b = np.sort(good), np.sort(bad)
    wrong = np.searchsorted(g, values[1:], "left") / len(g) + 1 - np.searchsorted(b, values[1:], "left") / len(b)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    gap = max(best, key=lambda k: values[k + 1] - values[k])
    return float(values[gap] + (values[gap + 1] - values[gap]) / 3)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, log_weight, key): one row per row of `docs`, with and without the noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            w = np.array([model.weight(gram_buckets(t, len(model.ratios), known)) for t in b.column(3).to_pylist()], dtype=np.float64)
            key = w + _gumbel(b.column(1).to_numpy(), model.seed)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(w), pa.array(key)], ["doc_id", "k1", "k2", "log_weight", "key"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, log_weight double, key double")


def kth_greatest(scores: DataFrame, column: str, k: int, bins: int = 1024, exact: int = 10_000) -> float:
    """The k-th greatest value of a column without nulls or NaN, by narrowing a histogram; the driver holds `bins` counts or `exact` values."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    if k <= 0 or low is None:
        return math.inf
    above = 0
    while low < high:
        inside = scores.where(F.col(column).between(low, high))
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.low):
            if above + r.n >= k:
                low, high, n = r.low, r.high, r.n
                break
            above += r.n
        if n <= exact:
            values = sorted((r[0] for r in scores.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - above - 1]
    return low


def sample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", **fitting) -> tuple[DataFrame, Model, float]:
    """(scores with `selected`, model, cut): a row is selected if its key is at least the k-th greatest, so that ties stay together.

    Repeated rows have one key and share their fate. A null or empty text weighs 0. An empty table gives no rows and the cut
    infinity. Columns other than id and text are not read.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    scores = stored(score(docs, model, id_col, text_col))
    if k is None:
        k = scores.where(F.col("log_weight") >= model.level).count()
    cut = kth_greatest(scores, "key", k)
    return scores.withColumn("selected", F.col("key") >= F.lit(cut)), model, cut


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """The selected rows of `docs` with all their columns; weights are made again from the text, so that no text is shuffled."""
    _, model, cut = sample(docs, labels, None, id_col, text_col, **fitting)
    k1, _ = row_keys(id_col, text_col)
    wide = docs.withColumn("__k1", k1)
    names = wide.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            w = np.array([model.weight(gram_buckets(t, len(model.ratios), known)) for t in b.column(names.index(text_col)).to_pylist()], dtype=np.float64)
            key = w + _gumbel(b.column(len(names) - 1).to_numpy(), model.seed)
            yield b.filter(pa.array(key >= cut))

    return wide.mapInArrow(run, wide.schema).drop("__k1")
