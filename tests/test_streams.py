"""Mergeable latency sketches and the keyed store, on batches and on streams that stop and start again."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from docvet.sources.keyed_store import KeyedStore
from docvet.streaming import jobs

START = dt.datetime(2024, 1, 1)
LOG = "ts timestamp, service string, status string, latency_ms double"


def log_rows(n, seed=1):
    rng = random.Random(seed)
    latency = lambda: rng.choice([None, 0.0, -3.0, rng.lognormvariate(4, 2), rng.uniform(1, 9), 250.0])
    return [(START + dt.timedelta(seconds=rng.randrange(3 * 86400)), f"s{rng.randrange(2)}", "error" if i % 5 == 0 else "ok", latency()) for i in range(n)]


@pytest.mark.parametrize("window,seconds", [("1 hour", 3600), ("1 day", 86400)])
def test_p95_is_within_its_error(spark, window, seconds):
    rows = log_rows(4000)
    log = spark.createDataFrame(rows, LOG).repartition(5)
    got = {(r.window_start, r.service): r for r in jobs.merged_rollup(jobs.latency_sketches(log, "1 hour"), window).collect()}
    groups = {}
    for ts, service, status, latency in rows:
        groups.setdefault((START + dt.timedelta(seconds=(ts - START).total_seconds() // seconds * seconds), service), []).append((status, latency))
    assert set(got) == set(groups)
    for key, own in groups.items():
        real = sorted(max(0.0, x) for _, x in own if x is not None)
        exact = real[math.ceil(0.95 * len(real) - 1e-9) - 1] if real else None
        r = got[key]
        assert r.request_count == len(own) and r.error_count == sum(s == "error" for s, _ in own)
        assert r.p95_latency_ms is None if exact is None else abs(r.p95_latency_ms - exact) <= jobs.QUANTILE_ERROR * exact + 1e-9


def test_stream_of_sketches_and_of_rollups_equals_batch(spark, tmp_path):
    rows = sorted(log_rows(600, 2)) + [(START + dt.timedelta(days=30), "s0", "ok", 1.0)]  # the last one closes all windows
    log = spark.createDataFrame(rows, LOG)
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    read = lambda: spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.awaitTermination(120)
        return spark.table(name)

    close = F.col("window_start") < F.lit(START + dt.timedelta(days=9))
    as_set = lambda df: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()}
    want = as_set(jobs.request_rollup(log, with_p95=True).where(close))
    assert as_set(run(jobs.request_rollup(read(), with_p95=True), "rolled")) == want and len(want) > 50
    assert as_set(jobs.merged_rollup(run(jobs.latency_sketches(read()), "sketched")).where(close)) == want


ROWS = "finding_id string, state string, seen_at bigint"


def latest(rows):
    out = {}
    for f, state, at in rows:
        if f is not None and (f not in out or (at, state) > out[f]):
            out[f] = (at, state)
    return out


def state(store, spark, version=None):
    rows = store.current(spark, version).collect()
    assert len(rows) == len({r.finding_id for r in rows})
    return {r.finding_id: (r.seen_at, r.state) for r in rows}


def test_batches_in_any_order_and_again(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(f"f{rng.randrange(60)}" if rng.random() > 0.02 else None, rng.choice("abc"), rng.randrange(30)) for _ in range(50)] for _ in range(5)]
    for name, order in (("x", [0, 1, 2, 3, 4]), ("y", [4, 2, 0, 3, 1])):
        store = KeyedStore(f"{tmp_path}/{name}", ROWS, "finding_id", "seen_at", buckets=4)
        store.create(spark)
        assert state(store, spark) == {}
        for version, k in enumerate(order):
            for _ in range(2 if version in (0, 3) else 1):  # a batch that is merged again
                store.merge(spark.createDataFrame(batches[k], ROWS), version)
        assert state(store, spark) == latest([r for b in batches for r in b])
        assert state(store, spark, 1) == latest([r for k in order[:2] for r in batches[k]])
        store.merge(spark.createDataFrame([], ROWS), 5)
        assert state(store, spark) == latest([r for b in batches for r in b])
        with pytest.raises(ValueError, match="another checkpoint"):
            store.merge(spark.createDataFrame([], ROWS), 2)


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = KeyedStore(f"{tmp_path}/s", ROWS, "finding_id", "seen_at", buckets=8)
    store.create(spark)
    store.merge(spark.createDataFrame([(f"f{k}", "a", 1) for k in range(100)], ROWS), 0)
    store.merge(spark.createDataFrame([("f7", "b", 2)], ROWS), 1)
    assert len([p for p in (tmp_path / "s/data/batch=0").iterdir() if p.name.startswith("bucket=")]) == 8
    assert len([p for p in (tmp_path / "s/data/batch=1").iterdir() if p.name.startswith("bucket=")]) == 1
    assert state(store, spark)["f7"] == (2, "b")


def test_a_stream_that_fails_after_its_merge_merges_once(spark, tmp_path):
    """The merge of a batch ends, its commit doesn't: the restarted stream merges the same batch again."""
    rng = random.Random(5)
    rows = [(f"f{rng.randrange(40)}", rng.choice("abc"), rng.randrange(50)) for _ in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[100 * k:100 * k + 100], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    store = KeyedStore(f"{tmp_path}/store", ROWS, "finding_id", "seen_at", buckets=4)
    store.create(spark)
    read = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    calls = []

    def fails_once(df, version):
        store.merge(df, version)
        calls.append(version)
        if calls == [0, 1]:
            raise RuntimeError("lost after the merge")

    first = read().writeStream.foreachBatch(fails_once).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after the merge"):
        first.awaitTermination(120)
    second = store.stream(read(), f"{tmp_path}/c").trigger(availableNow=True).start()
    second.awaitTermination(120)
    assert state(store, spark) == latest(rows)
