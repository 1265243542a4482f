"""Audit of how the words of sources differ, by one-hot level products.

A level is one count that a group (lang, source) gives to some kept term. A block of terms is a 0/1 matrix with a row for each
term and a column for each (group, level); its transpose times itself holds, for every two columns, the number of terms that
have both: the joint tables of all pairs of groups at once. A pair of levels has one price, so that a table is priced
cell by cell. Columns for the level 0 aren't built: what they add follows from the levels of each group alone.

Everything is counted in integers. Let z be a group's value of a term that it lacks. Then the sum over all terms of f(p, q) is
  V f(za, zb) + sum over a's levels of f(p, zb) - f(za, zb) + sum over b's levels of f(za, q) - f(za, zb)
  + sum over the joint table of f(p, q) - f(p, zb) - f(za, q) + f(za, zb).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docvet.llm.common import byte_runs, stored

#: Terms whose counts a task holds while it reads; more are handed on and begun anew.
HELD_TERMS = 300_000
#: Terms of a block (entries of a product are at most that), columns of a panel, pairs of groups that a task sums before it hands them on.
BLOCK_TERMS, PANEL, HELD_PAIRS = 96, 2048, 1_000_000
#: A to Z become a to z; bytes of no term become spaces.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(data: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, repeats included, in lists of bounded length where its white space allows."""
    for run in byte_runs(data or b""):
        yield run.translate(_FOLD).split()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a row without term for each group."""

    def rows(counts: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), count in counts.items():
            words = [None, *count]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(words), pa.string()) for x in (lang, source)]
                + [pa.array(words, pa.binary()).view(pa.string()), pa.array([0, *count.values()], pa.int64()), pa.array([0, *map(held[lang, source].__getitem__, count)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                key = (lang, source)
                count, docs_of = counts.setdefault(key, Counter()), held.setdefault(key, Counter())
                before, seen = len(count), set()
                for words in terms_of(text.as_py()):
                    count.update(words)
                    seen.update(words)
                docs_of.update(seen)
                size += len(count) - before
            if size > HELD_TERMS:
                yield from rows(counts, held)
                counts, held, size = {}, {}, 0
        yield from rows(counts, held)

    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), F.col(text_col).cast("binary").alias("data"))
    parts = text.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact for counts up to 10^28; 1 where nothing is kept."""
    count, total, kept = (F.col(c) if isinstance(c, str) else c for c in (count, total, kept))
    top = (count + 1).cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = F.greatest(total.cast("decimal(28,0)") + kept.cast("decimal(20,0)"), F.lit(1).cast("decimal(29,0)"))
    return _div(top, below) + 1


def _div(a: Column, b: Column) -> Column:
    """Whole part of a / b, for values that aren't negative; exact on decimals and longs."""
    return F.call_function("div", a, b).cast("bigint")


def gap(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return _div((p - q) * (p - q), q)


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) for int64 values up to about 10^9."""
    return (p - q) * (p - q) // q


def joint_prices(row: np.ndarray, group: np.ndarray, level: np.ndarray, p: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, value) of a block: each entry says that the term `row` has that level in that group; one value for each two groups that share a term.

    The matrix is cut into panels of columns; a panel's transpose times another gives the joint tables of their groups.
    """
    columns, column = np.unique(np.stack([group, level, p, z], axis=1), axis=0, return_inverse=True)
    column = column.reshape(-1)
    hot, height, groups = {}, int(row.max()) + 1, int(group.max()) + 1
    for at in range(0, len(columns), PANEL):
        own = (column >= at) & (column < at + PANEL)
        hot[at] = np.zeros((height, min(PANEL, len(columns) - at)), dtype=np.float32)
        hot[at][row[own], column[own] - at] = 1
    keys, values = [], []
    for i, left in hot.items():
        for j, right in hot.items():
            joint = left.T @ right
            x, y = np.nonzero(joint)
            n = joint[x, y].astype(np.int64)
            (a, _, pa_, za), (b, _, pb, zb) = columns[x + i].T, columns[y + j].T
            keys.append(a * groups + b)
            values.append(np.where(a == b, 0, n * (prices(pa_, pb) - prices(pa_, zb) - prices(za, pb) + prices(za, zb))))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, at.reshape(-1), np.concatenate(values))
    apart = key // groups != key % groups
    return key[apart] // groups, key[apart] % groups, total[apart]


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms come in order of lang and count; each task sums its blocks' prices."""
    sums: dict[tuple[str, str, str], int] = {}

    def out() -> pa.RecordBatch:
        names = [pa.array([k[i] for k in sums], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*names, pa.array(list(sums.values()), pa.int64())], ["lang", "source", "item", "value"])

    for b in batches:
        langs, lists = b.column(0).to_pylist(), b.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        cells = lists.values
        sources = cells.field("source").dictionary_encode()
        names, group = sources.dictionary.to_pylist(), sources.indices.to_numpy().astype(np.int64)
        level, p, z = (cells.field(c).to_numpy() for c in ("n", "p", "z"))
        start = 0
        while start < len(langs):
            stop = start + 1
            while stop < len(langs) and stop - start < BLOCK_TERMS and langs[stop] == langs[start]:
                stop += 1
            at = slice(ends[start], ends[stop])
            row = np.repeat(np.arange(stop - start), np.diff(ends[start:stop + 1]))
            for x, y, value in zip(*(v.tolist() for v in joint_prices(row, group[at], level[at], p[at], z[at]))):
                key = (langs[start], names[x], names[y])
                sums[key] = sums.get(key, 0) + value
            start = stop
            if len(sums) > HELD_PAIRS:
                yield out()
                sums.clear()
    if sums:
        yield out()


def audit(
    docs: DataFrame, least_docs: int = 3, ranks: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and by which terms from the language.

    Terms are runs of letters: anything but ASCII characters that are no letters; only A to Z are lower-cased. A language keeps the V terms that at
    least `least_docs` of its rows hold. A group or language gives each of them p = 1 + floor(10^9 (count + 1) / (N + V)), N the sum
    of its counts. f = floor((p - q)^2 / q). Part `pair`: each other source of the language, f summed over all kept terms. Part
    `term`: the `ranks` first kept terms that the group holds with p above the language's q. Rank: value descending, then the item's bytes.

    Nulls in text, lang and source are empty strings, so that they form a group of their own; a group without terms has its pairs, with 0
    where the language keeps no term; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    counts = stored(count_terms(docs, text_col, lang_col, source_col))
    words = counts.where(F.col("term").isNotNull())
    term = words.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("held")).where(F.col("held") >= least_docs).select("lang", "term", "total")
    term = stored(term)
    of_lang = term.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    cells = words.select("lang", "source", "term", "n").join(term, ["lang", "term"])
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = (
        counts.where(F.col("term").isNull()).select("lang", "source").join(of_lang, "lang", "left").join(totals, ["lang", "source"], "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("kept", "lang_total", "group_total")))
        .withColumn("z", share(F.lit(0).cast("bigint"), "group_total", "kept"))
    )
    groups = stored(groups)
    priced = stored(
        cells.join(groups, ["lang", "source"])
        .select("lang", "source", "term", "n", "total", "z", share("n", "group_total", "kept").alias("p"), share("total", "lang_total", "kept").alias("q"))
    )

    rank = lambda by: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc(by)))
    term_part = (
        priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
        .withColumn("rank", rank("item")).where(F.col("rank") <= ranks)
    )

    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zb"))
    both = groups.select("lang", "source", "kept", F.col("z").alias("za")).join(others, "lang").where(F.col("source") != F.col("item"))
    none_held = both.select("lang", "source", "item", (F.col("kept") * gap("za", "zb")).alias("value"))
    levels = priced.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("terms"))
    pair = levels.join(others, "lang").where(F.col("source") != F.col("item"))
    one_held = pair.select("lang", "source", "item", (F.col("terms") * (gap("p", "zb") - gap("z", "zb"))).alias("value"))
    other_held = pair.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * (gap("zb", "p") - gap("zb", "z"))).alias("value"))
    rows = (
        priced.groupBy("lang", "total", "term").agg(F.collect_list(F.struct("source", "n", "p", "z")).alias("cells"))
        .repartitionByRange("lang", "total", "term").sortWithinPartitions("lang", "total", "term").select("lang", "cells")
    )
    both_held = rows.mapInArrow(_product, "lang string, source string, item string, value bigint")
    sums = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (none_held, one_held, other_held, both_held)]
    total = sums[0].union(sums[1]).union(sums[2]).union(sums[3]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair_part = total.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank("item"))
    return pair_part.union(term_part)
