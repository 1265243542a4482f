"""Mining of hard negatives by slots.

Each positive of an anchor asks for the best negatives whose score lies under its upper limit and over its lower one. These
windows overlap. The upper limits cut the scores into slots that don't: every block of rows keeps the k best of each slot, and
so does every merge. Read from a positive's own slot downwards, the slots' lists are already in order, so that the first k of
what follows are the best under its limit; those under its lower limit go.

Rows and anchors are written as matrices of bounded size, and every block of anchors meets every block of rows in a row
of its own, twice: for the positives, then for the slots. A task reads some files of either table, so that no matrix is shuffled or
sent to the driver, and keeps the best of an anchor over all its blocks of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from docvet.llm.common import stored

#: Rows and anchors of a block, and the most numbers in its matrix.
ROWS, ANCHORS, NUMBERS = 8192, 1024, 1 << 20
#: Lines of scores that are searched at once, and scores of a line of which the greatest is looked at first.
LINES, RUN = 64, 64
#: Integers below are exact in a product of float32, and of float64.
SINGLE, DOUBLE = 1 << 24, 1 << 53
#: Scores beyond 64 bits count as these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_BLOCK = "place int, block int, ids array<bigint>, labels array<bigint>, width int, kind string, matrix binary"
_FOUND = "place int, block int, line int, slot int, id bigint, score bigint"
_KEY = ["place", "block", "line"]


def whole(numbers: np.ndarray, lengths: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of these lengths, each as a line, short ones filled with zeros; the narrowest kind of number, Python's where float64 is too short."""
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = numbers
    with np.errstate(over="ignore"):
        up = np.floor(scale * out)
    most = np.abs(up).max(initial=0)
    for kind, limit in ((np.int16, 1 << 15), (np.int32, 1 << 31)):
        if most < limit:
            return up.astype(kind)
    return np.array([[int(u) if math.isfinite(u) else scale * int(x) for u, x in zip(a, b)] for a, b in zip(up.tolist(), out.tolist())], dtype=object).reshape(out.shape)


def as_bytes(m: np.ndarray) -> tuple[str, bytes]:
    return ("text", ",".join(map(str, m.ravel().tolist())).encode()) if m.dtype == object else (m.dtype.str, m.tobytes())


def from_bytes(kind: str, data: bytes, lines: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in data.decode().split(",")], dtype=object).reshape(lines, -1)
    return np.frombuffer(data, dtype=kind).reshape(lines, -1) if data else np.zeros((lines, 0), dtype=np.int16)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all lines of both; numbers that one side lacks count as zero."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :width], rows[:, :width]
    most = max(1, width) * int(abs(a).max(initial=0)) * int(abs(b).max(initial=0))
    kind = np.float32 if most < SINGLE else np.float64 if most < DOUBLE else object
    if kind is not object:
        return a.astype(kind) @ b.astype(kind).T
    out = np.array([[int(x) for x in line] for line in a.astype(object)], dtype=object).reshape(a.shape).dot(b.astype(object).T)
    return np.clip(out, LEAST, MOST) if out.size else np.zeros((len(a), len(b)))


def best(score: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the k greatest able scores of each line, ties by the smaller column."""
    if score.dtype != object and able.shape[1] > k and np.count_nonzero(able) > able.size // 256:
        masked = np.where(able, score, -np.inf)
        runs = able.shape[1] // RUN
        tops = masked[:, : runs * RUN].reshape(len(masked), runs, RUN).max(axis=2) if runs >= k else masked  # k runs have a score of at least their k-th top
        able = able & (masked >= np.partition(tops, -k, axis=1)[:, -k][:, None])
    line, column = np.divmod(np.flatnonzero(able), able.shape[1])
    order = np.lexsort((column, -score[line, column], line)) if score.dtype != object else sorted(range(len(line)), key=lambda n: (line[n], -score[line[n], column[n]], column[n]))
    line, column = line[order], column[order]
    keep = np.arange(len(line)) - np.searchsorted(line, line, "left") < k
    return line[keep], column[keep]


def in_slot(score: np.ndarray, low: np.ndarray, high: np.ndarray, slot: int) -> np.ndarray:
    """Where a score lies under its line's limit of the slot, over the next slot's limit and not under the slot's lower limit."""
    bound = (lambda x: x) if score.dtype == object else (lambda x: np.clip(x, -SINGLE, SINGLE) if score.dtype == np.float32 else np.clip(x, -DOUBLE, DOUBLE))
    column = lambda m, j: bound(m[:, j:j + 1]).astype(score.dtype)
    able = (score <= column(high, slot)) & (score >= column(low, slot))
    return able & (score > column(high, slot + 1)) if slot + 1 < high.shape[1] else able


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Matrices of `rows` (id, label, vector), which are dealt evenly to the places; a block's lines are in the order of their ids, nulls last."""
    places = max(1, math.ceil(rows.count() / size))

    def line(place: int, block: int, table: pa.Table) -> pa.RecordBatch:
        vectors = table.column(2).combine_chunks()
        m = whole(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.value_lengths().to_numpy(zero_copy_only=False), scale)
        kind, data = as_bytes(m)
        values = [place, block, table.column(0).to_pylist(), table.column(1).to_pylist(), m.shape[1], kind, data]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["place", "block", "ids", "labels", "width", "kind", "matrix"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block, held, lines, width = TaskContext.get().partitionId(), 0, [], 0, 1
        for b in batches:
            at = 0
            for n, size_ in enumerate(b.column(2).value_lengths().to_pylist()):
                width = max(width, size_)
                if lines and (lines >= 2 * size or (lines + 1) * width > NUMBERS):
                    held.append(b.slice(at, n - at))
                    yield line(place, block, pa.Table.from_batches(held))
                    at, block, held, lines, width = n, block + 1, [], 0, max(1, size_)
                lines += 1
            held.append(b.slice(at))
        if lines:
            yield line(place, block, pa.Table.from_batches(held))

    return stored(rows.repartition(places).sortWithinPartitions(F.asc_nulls_last("id")).mapInArrow(pack, _BLOCK))


class _Kept:
    """The k best of each line and slot of one block of anchors over the blocks of rows that a task reads, ties by the smaller id, nulls last."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, line: np.ndarray, slot: int, ids: pa.Array, score: np.ndarray) -> None:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        self.parts.append((line.astype(np.int64), np.full(len(line), slot, dtype=np.int64), null, ids.fill_null(0).to_numpy(), score.astype(np.int64)))
        self.size += len(line)
        if self.size > 1 << 18:
            self._cut()

    def _cut(self) -> None:
        line, slot, null, ids, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, null, ~score, slot, line))
        line, slot = line[order], slot[order]
        new = np.append(True, (line[1:] != line[:-1]) | (slot[1:] != slot[:-1]))[: len(line)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(line)), 0))
        keep = np.arange(len(line)) - start < self.k
        self.parts = [(line[keep], slot[keep], *(x[order][keep] for x in (null, ids, score)))]
        self.size = int(keep.sum())

    def batch(self, place: int, block: int) -> pa.RecordBatch:
        self._cut()
        ((line, slot, null, ids, score),) = self.parts
        values = [np.full(len(line), place), np.full(len(line), block), line, slot]
        return pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in values), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], ["place", "block", "line", "slot", "id", "score"])


def _floor(a: Column, b: int) -> Column:
    """floor(a / b) of a whole decimal, as a bigint."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("decimal(10,0)")), F.lit(b).cast("decimal(10,0)")).cast("bigint")


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100),
    scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `anchor` holds.

    A vector's components become floor(scale * x); a score is their integer inner product, higher first, ties by the smaller id.
    An anchor's positives are the first `positives` other rows of its label; a positive's negatives are the first `negatives` rows of other
    labels with low[0] * positive <= low[1] * score and high[1] * score <= high[0] * positive, ranked from 1. Positives without any give no row.

    Rows with a null label, a null vector or a component that is null or not finite take no part. Each repeated row counts: as
    an anchor, as another row and as a negative. A null id comes after all others in a tie and is an anchor only if `anchor` says so.
    Of vectors of different lengths, the shorter one is filled with zeros. Scores beyond 64 bits count as the nearest number of
    64 bits. Columns not named here aren't read, and may have any name; an empty table gives no rows.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    vector = F.col(vector_col) if rows.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    own = own.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    all_rows = _blocks(own.select("id", "label", "vector"), ROWS, scale)
    anchors = _blocks(own.where("anchor").select("id", "label", "vector"), ANCHORS, scale)
    right = all_rows.select(*(F.col(c).alias(f"r_{c}") for c in all_rows.columns)).hint("shuffle_replicate_nl")

    def cells(left: DataFrame) -> DataFrame:
        """A row for each block of anchors and block of rows; a task has some files of both, by blocks of anchors."""
        return left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns)).crossJoin(right)

    def side(b: pa.RecordBatch, k: int, name: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids, labels, kind, matrix = (b[f"{name}_{c}"][k] for c in ("ids", "labels", "kind", "matrix"))
        return ids.values, labels.values.to_numpy(), from_bytes(kind.as_py(), matrix.as_py(), len(ids.values))

    def searched(batches: Iterator[pa.RecordBatch], k: int, find: Callable, limits: Callable) -> Iterator[pa.RecordBatch]:
        at, kept, left, bounds = None, None, None, None
        for b in batches:
            for n in range(b.num_rows):
                here = (b["a_place"][n].as_py(), b["a_block"][n].as_py())
                if here != at:
                    if at:
                        yield kept.batch(*at)
                    at, kept, left = here, _Kept(k), side(b, n, "a")
                    bounds = limits(b, n, len(left[1]))
                ids, labels, matrix = side(b, n, "r")
                score = scores(left[2], matrix)
                for first in range(0, len(score), LINES):
                    part = slice(first, first + LINES)
                    for slot, line, column in find(score[part], np.equal.outer(left[1][part], labels), part, bounds):
                        kept.add(line + first, slot, ids.take(pa.array(column, pa.int64())), score[line + first, column])
        if at:
            yield kept.batch(*at)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from searched(batches, positives + 1, lambda score, same, part, _: [(0, *best(score, same, positives + 1))], lambda b, n, lines: None)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def limits(b: pa.RecordBatch, n: int, lines: int) -> tuple[np.ndarray, np.ndarray]:
            lows, highs = (np.full((lines, positives), v, dtype=object) for v in (MOST + 1, LEAST - 1))
            for x in b["a_limits"][n].as_py():
                m = len(x["positives"])
                lows[x["line"], :m] = [p["low"] for p in x["positives"]]
                highs[x["line"], :m] = [p["high"] for p in x["positives"]]
            return lows, highs

        def find(score: np.ndarray, same: np.ndarray, part: slice, bounds: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
            other = ~same
            for slot in range(positives):
                yield slot, *best(score, other & in_slot(score, bounds[0][part], bounds[1][part], slot), negatives)

        yield from searched(batches, negatives, find, limits)

    def themselves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                m = from_bytes(row["kind"], row["matrix"], len(row["ids"])).astype(object)
                own_score = [min(int(x), MOST) for x in (m * m).sum(axis=1)] if m.size else [0] * len(m)
                n = len(own_score)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([row[c]] * n, pa.int32()) for c in ("place", "block")), pa.array(range(n), pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(own_score, pa.int64())],
                    ["place", "block", "line", "anchor_id", "self"],
                )

    order = [F.desc("score"), F.asc_nulls_last("id")]
    first = lambda df, k, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*_KEY, *by).orderBy(*order))).where(F.col("rank") <= k)
    near = first(cells(anchors).mapInArrow(nearest, _FOUND), positives + 1).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    near = near.join(anchors.mapInArrow(themselves, "place int, block int, line int, anchor_id bigint, self bigint"), _KEY)
    own_place = F.array_position(F.transform("near", lambda x: x["id"].eqNullSafe(F.col("anchor_id")) & (x["score"] == F.col("self"))), True)
    others = F.slice(F.filter("near", lambda x, k: k + 1 != F.col("own_place")), 1, positives)
    wide = lambda x, by: x["score"].cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")
    limits = F.transform(others, lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), (-_floor(-wide(x, low[0]), low[1])).alias("low"), _floor(wide(x, high[0]), high[1]).alias("high")))
    asked = stored(near.withColumn("own_place", own_place).select(*_KEY, "anchor_id", limits.alias("positives")).where(F.size("positives") > 0))

    by_block = asked.groupBy("place", "block").agg(F.collect_list(F.struct("line", "positives")).alias("limits"))
    kept = first(cells(stored(anchors.join(by_block, ["place", "block"]))).mapInArrow(slots, _FOUND), negatives, "slot")
    lists = kept.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("kept"))
    answers = asked.join(lists, _KEY).select("anchor_id", "kept", F.posexplode("positives").alias("own_slot", "positive"))
    below = F.slice(F.filter("kept", lambda x: x["slot"] >= F.col("own_slot")), 1, negatives)
    answers = answers.select("anchor_id", "positive", F.posexplode(F.filter(below, lambda x: x["score"] >= F.col("positive.low"))).alias("rank", "negative"))
    return answers.select(
        "anchor_id", F.col("positive.id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"),
    )
