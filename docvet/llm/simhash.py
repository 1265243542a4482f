"""Near-duplicates by SimHash: fingerprints, and their self-join by walking pairs of nodes of a binary trie.

The trie is walked in two parts. On top, Spark expands node pairs `stride` bits at a time, adds up the bits in which
they differ and drops pairs over the budget, until both nodes of a pair hold at most `leaf` fingerprints. Below, one
task takes one node pair with its fingerprints, at most 2 x `leaf` of them, and goes on in the same way with arrays.
Fingerprints are distinct before the join, so that copies cost nothing. A task reports the links it finds as a
spanning forest with the number of linked documents, never as pairs within a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from docvet.llm.common import byte_runs, components, row_keys, stored

#: Node pairs that one task holds at once below the units.
FRONTIER = 400_000
#: Nodes whose sizes multiply to no more than this are compared leaf by leaf.
DIRECT = 32


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text; zero without words. Long texts are read in runs."""
    digest = xxhash.xxh64_intdigest
    set_bits, total, held = np.zeros(64, dtype=np.int64), 0, []
    runs = [r for r in byte_runs((text or "").encode("utf-8", "surrogatepass").lower())]
    for k, run in enumerate(runs):
        held += run.split()
        last = k == len(runs) - 1
        count = len(held) - words + 1
        if count < 1 and not (last and held and not total):
            continue
        joined = b" ".join(held)
        if count < 1:
            hashes = [digest(joined, 42)]
        else:
            ends = np.cumsum(np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1)
            starts = np.concatenate(([0], ends[:count - 1])) if count > 1 else np.zeros(1, dtype=np.int64)
            hashes = [digest(joined[s:e], 42) for s, e in zip(starts.tolist(), (ends[words - 1:] - 1).tolist())]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
        held = held[len(held) - words + 1:] if words > 1 else []
    if not total:
        return 0
    return int.from_bytes(np.packbits(set_bits * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, k1, k2, fp bigint): one row per row of `docs`, k1 and k2 name its id and text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, words) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], fps], ["doc_id", "k1", "k2", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, fp bigint")


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join i[k] with j[k] in a forest in which parents are never larger than their children."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def walk(left: np.ndarray, right: np.ndarray | None, weights: np.ndarray, depth: int, diff: int, budget: int):
    """(parent, linked): links within `left`, or between `left` and `right`, two nodes of depth `depth` that differ in `diff` bits.

    Fingerprints are sorted and distinct in each node; parent indexes both together, linked sums the weights of links.
    """
    keys = left if right is None else np.concatenate([left, right])
    n, size = len(left), len(keys)
    parent, linked = np.arange(size), np.zeros(size, dtype=np.int64)
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        if level not in ones:
            bit = (keys >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        return hi - (ones[level][hi] - ones[level][lo])

    one = lambda x: np.array([x], dtype=np.int64)
    stack = [(depth, one(0), one(n), one(0 if right is None else n), one(size), one(diff))]
    while stack:
        level, la, ha, lb, hb, d = stack.pop()
        if len(la) > FRONTIER:
            for at in range(0, len(la), FRONTIER):
                part = slice(at, at + FRONTIER)
                stack.append((level, la[part], ha[part], lb[part], hb[part], d[part]))
            continue
        wa, wb = ha - la, hb - lb
        near = (wa * wb <= DIRECT) | (level == 64)
        if near.any():
            a0, b0, na, nb = la[near], lb[near], wa[near], wb[near]
            rep = np.repeat(np.arange(len(a0)), na * nb)
            k = np.arange(len(rep)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = a0[rep] + k // nb[rep], b0[rep] + k % nb[rep]
            keep = i < j
            i, j = i[keep], j[keep]
            close = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            i, j = i[close], j[close]
            if len(i):
                parent = _union(parent, i, j)
                linked += np.bincount(i, weights[j], size).astype(np.int64) + np.bincount(j, weights[i], size).astype(np.int64)
            far = ~near
            la, ha, lb, hb, d = la[far], ha[far], lb[far], hb[far], d[far]
        if not len(la):
            continue
        ma, mb = split(la, ha, level), split(lb, hb, level)
        other = la != lb  # a node with itself has its children's cross pair once
        cross = d < budget
        parts = (
            (la, ma, lb, mb, d, None), (ma, ha, mb, hb, d, None),
            (la, ma, mb, hb, d + 1, cross), (ma, ha, lb, mb, d + 1, cross & other),
        )
        kept = []
        for p, q, r, s, e, mask in parts:
            ok = (q > p) & (s > r)
            ok = ok if mask is None else ok & mask
            kept.append([x[ok] for x in (p, q, r, s, e)])
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*kept))))
    return parent, linked


def _prefix(column: str, depth: int) -> Column:
    return F.lit(0).cast("bigint") if depth == 0 else F.shiftrightunsigned(column, 64 - depth) if depth < 64 else F.col(column)


def link(prints: DataFrame, budget: int = 3, leaf: int = 8192, stride: int = 2) -> DataFrame:
    """(fp, root, linked) from distinct (fp bigint, n bigint): parts of a spanning forest of all links of at most `budget`
    differing bits, and the documents (weights n) linked; a fingerprint may have several rows. Empty in, empty out."""
    if stride < 1 or 64 % stride or leaf < 1:
        raise ValueError("stride must divide 64 and leaf be positive")
    spark = prints.sparkSession
    moves = [(i, j, (i ^ j).bit_count()) for i in range(1 << stride) for j in range(1 << stride) if (i ^ j).bit_count() <= budget]
    move = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(b).alias("b")) for i, j, b in moves]))
    pairs = spark.range(1).selectExpr("CAST(0 AS BIGINT) AS a", "CAST(0 AS BIGINT) AS b", "0 AS diff")
    done: DataFrame | None = None
    depth = 0

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                sides = []
                for side in ("left", "right"):
                    values = row[side].values
                    keys = values.field("fp").to_numpy().view(np.uint64)
                    order = np.argsort(keys)
                    sides.append((keys[order], values.field("n").to_numpy()[order]))
                own = row["a"].as_py() == row["b"].as_py()
                (left, wl), (right, wr) = sides
                weights = wl if own else np.concatenate([wl, wr])
                keys = left if own else np.concatenate([left, right])
                parent, linked = walk(left, None if own else right, weights, row["depth"].as_py(), row["diff"].as_py(), budget)
                at = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at].view(np.int64)), pa.array(keys[parent[at]].view(np.int64)), pa.array(linked[at])], ["fp", "root", "linked"]
                )

    while True:
        node = _prefix("fp", depth)
        nodes = stored(prints.groupBy(node.alias("p")).agg(F.count("*").alias("size")))
        pairs = stored(
            pairs.join(nodes.selectExpr("p AS a", "size AS size_a"), "a").join(nodes.selectExpr("p AS b", "size AS size_b"), "b")
        )
        small = f"size_a <= {leaf} AND size_b <= {leaf}" if depth < 64 else "true"
        ready = pairs.where(small)
        count = ready.count()
        if count:
            held = prints.withColumn("p", node).join(nodes.where(f"size <= {leaf}"), "p")
            held = stored(held.groupBy("p").agg(F.collect_list(F.struct("fp", "n")).alias("held")))
            found = (
                ready.select("a", "b", "diff", F.lit(depth).alias("depth"))
                .join(held.selectExpr("p AS a", "held AS left"), "a").join(held.selectExpr("p AS b", "held AS right"), "b")
                .repartition(min(count, max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))))
                .mapInArrow(units, "fp bigint, root bigint, linked bigint")
            )
            done = found if done is None else done.union(found)
        if depth >= 64 or pairs.where(f"NOT ({small})").isEmpty():
            return stored(done) if done is not None else stored(prints.selectExpr("fp", "fp AS root", "n AS linked").where("false"))
        pairs = (
            pairs.where(f"NOT ({small})").select("*", move.alias("m")).where("a <> b OR m.i <= m.j")
            .selectExpr(f"a * {1 << stride} + m.i AS a", f"b * {1 << stride} + m.j AS b", "diff + m.b AS diff")
            .where(f"diff <= {budget}")
        )
        depth += stride


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3, leaf: int = 8192, stride: int = 2
) -> DataFrame:
    """One row per row of `docs`: doc_id, k1, k2, fp, component_id (the least doc_id reachable by links of at most `budget` bits),
    links (other documents at most `budget` bits away), head (true where the row is the one that stands for its class).

    Null or empty texts have fingerprint zero and link like any other. Repeated rows count as documents of their own, and are
    heads together. A null doc_id is never a class's id unless the class has no other. An empty table gives no rows; further
    columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    prints = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), first.alias("first")))
    links = link(prints.select("fp", "n"), budget, leaf, stride)
    roots = components(links.selectExpr("fp AS a", "root AS b")).withColumnRenamed("node", "fp")
    linked = links.groupBy("fp").agg(F.sum("linked").alias("linked"))
    known = stored(
        prints.join(roots, "fp", "left").join(linked, "fp", "left")
        .selectExpr("fp", "first", "coalesce(root, fp) AS root", "coalesce(linked, 0) + n - 1 AS links")
    )
    heads = stored(known.groupBy("root").agg(F.min("first").alias("first")))
    classes = stored(known.drop("first").join(heads, "root").select("fp", "first", "links"))
    return rows.join(classes, "fp").selectExpr(
        "doc_id", "k1", "k2", "fp", "first.doc_id AS component_id", "links", "k1 = first.k1 AND k2 = first.k2 AS head"
    )


def keep_one(docs: DataFrame, words: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, with all its columns: the least doc_id (null last), then the least text key.

    Repeated rows are one document. They are merged before the shuffle, so that a row held many times doesn't meet in one task.
    """
    heads = stored(near_duplicates(docs, id_col, text_col, words, budget).where("head").selectExpr("k1 AS __r1", "k2 AS __r2").distinct())
    k1, k2 = row_keys(id_col, text_col)
    rows = docs.withColumns({"__k1": k1, "__k2": k2}).dropDuplicates(["__k1", "__k2"])
    kept = rows.join(heads, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left_semi")
    return kept.drop("__k1", "__k2")
