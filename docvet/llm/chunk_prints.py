"""Document fingerprints by content-defined chunking.

A gear hash of the last bytes runs along the text; a chunk ends where its masked bits are zero, with a strict mask before
the normal size and a loose one after it. Boundaries depend on the bytes near them alone, so that an edit changes only the
chunks around it. A fingerprint is the set of chunk digests, weighted by chunk length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Least, normal and most bytes of a chunk. The masks take high bits, which depend on the most bytes; the strict one has two more.
LEAST, NORMAL, MOST = 12, 40, 160
LOOSE, STRICT = np.uint32(0xA4800000), np.uint32(0xA4940000)
#: Bytes that pass through the gear hash at once.
BLOCK = 1 << 22
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of the last 32 bytes' gears, each shifted by its distance; by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks, the last one at the end of the data."""
    strict: list[int] = []
    loose: list[int] = []
    for at in range(0, len(data), BLOCK):
        back = min(at, 31)
        h = gear(np.frombuffer(data, dtype=np.uint8, count=min(BLOCK, len(data) - at) + back, offset=at - back))[back:]
        hits = np.flatnonzero((h & LOOSE) == 0)
        loose += (hits + (at + 1)).tolist()
        strict += (hits[(h[hits] & STRICT) == 0] + (at + 1)).tolist()
    ends, start, size = [], 0, len(data)
    ns, nl = len(strict), len(loose)
    s = l = 0
    while start < size:
        if size - start <= LEAST:
            ends.append(size)
            break
        s = bisect_left(strict, start + LEAST, s)
        end = strict[s] if s < ns else size
        if end > start + NORMAL:
            l = bisect_left(loose, start + NORMAL, l)
            end = min(loose[l] if l < nl else size, start + MOST, size)
        ends.append(end)
        start = end
    return ends


def chunk_set(text: str | None) -> dict[int, int]:
    """48-bit digest of each chunk and the bytes it stands for in the text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    digest, found, start = xxhash.xxh3_64_intdigest, {}, 0
    for end in boundaries(data):
        key = digest(data[start:end]) >> 16
        found[key] = found.get(key, 0) + end - start
        start = end
    return found


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes of `a` in chunks that `b` has, as a share of `a`; no chunk is counted more often than `b` has it. Two empty texts: 1."""
    if not a:
        return 0.0 if b else 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return sum(min(n, large.get(k, 0)) for k, n in small.items()) / sum(a.values())


def as_text(chunks: dict[int, int]) -> str:
    """Digests in order, each as 12 hex digits, a colon and its bytes."""
    return ";".join(f"{k:012x}:{n}" for k, n in sorted(chunks.items()))


def from_text(print_: str) -> dict[int, int]:
    return {int(k, 16): int(n) for k, n in (x.split(":") for x in print_.split(";"))} if print_ else {}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint), one row per row; a null text counts as empty, whose fingerprint is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([as_text(chunk_set(t)) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"]
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def edit(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of `following`."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each meets the row after it in the same range, `trail` rows only end a range."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before = None
    for b in batches:
        rows: list[tuple] = []
        for part, doc_id, text, trail in zip(*(b.column(k).to_pylist() for k in range(4))):
            text = text or ""
            own = chunk_set(text)
            if before is not None and before[0] == part:
                _, old_id, old, prints = before
                edited = edit(old, text)
                other = chunk_set(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((old_id, len(old), sha, as_text(prints), as_text(other), likeness(prints, other), likeness(prints, own)))
            before = None if trail else (part, doc_id, text, own)
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


STUDY = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Where null ids stand in the order.
FIRST_ID = -(1 << 63)


def _ranges(cuts: np.ndarray):
    """Range of a row among sorted cuts; an id that fills several ranges spreads over them in the order of u."""

    @F.pandas_udf("int")
    def part(o: pd.Series, u: pd.Series) -> pd.Series:
        below, upto = np.searchsorted(cuts, o.to_numpy(), "left"), np.searchsorted(cuts, o.to_numpy(), "right")
        return pd.Series((below + (u.to_numpy() / float(1 << 40) * (upto - below + (upto > below))).astype(np.int64)).astype(np.int32))

    return part("o", "u")


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and its likeness to that text and to the next document.

    Documents are ordered by id, nulls first, and rows of one id by a hash of their text, so that a hot id splits over ranges.
    Rows that agree in both follow one another. After the last comes the first; a single document follows itself. A null text is
    empty. The text is dealt once, by ranges whose ends come from approximate quantiles; the first row of a range also goes
    to the range before it. What the driver holds is one key for each range. An empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST_ID)).alias("o"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.pmod(F.xxhash64(text_col), F.lit(1 << 40)).alias("u"), F.col(text_col).alias("text"),
    )
    steps = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("o", steps, 20 * ranges).alias("cuts")).first().cuts if steps else None
    rows = rows.withColumn("part", _ranges(np.array(sorted(cuts or []), dtype=np.int64)))
    firsts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min(F.struct("o", "u")).alias("f")).select("part", "f.o", "f.u").collect())
    if not firsts:
        return spark.createDataFrame([], STUDY)
    ends = spark.createDataFrame([(*f, firsts[k - 1][0]) for k, f in enumerate(firsts)], "part int, first_o bigint, first_u bigint, ends int")
    here = F.struct(F.col("part"), F.lit(False).alias("trail"))
    there = F.struct(F.col("ends").alias("part"), F.lit(True).alias("trail"))
    goes = F.when((F.col("o") == F.col("first_o")) & (F.col("u") == F.col("first_u")), F.array(here, there)).otherwise(F.array(here))
    dealt = rows.join(F.broadcast(ends), "part").select("o", "u", "doc_id", "text", F.explode(goes).alias("goes"))
    ordered = (
        dealt.select("goes.part", "goes.trail", "o", "u", "doc_id", "text").repartition(max(1, ranges // 4), "part")
        .sortWithinPartitions("part", "trail", "o", "u").select("part", "doc_id", "text", "trail")
    )
    return ordered.mapInArrow(_chain, STUDY)
