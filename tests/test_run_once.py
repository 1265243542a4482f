"""Dear expressions that run once a row."""

from pyspark.sql import functions as F

from docvet.functions import vectors as V
from docvet.operators import policy as P
from docvet.plans import inputs as I
from docvet.plans import retrieval_queries as Q
from docvet.plans import risk_queries as R

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_embed_each_chunk_once(spark):
    assert optimized(Q.record_query(spark, SF)).count("ArrowEvalPython [embed(") == 1


def test_non_zero_places(spark):
    rows = spark.createDataFrame([("a", [0.0, 2.5, -0.0, -1.0]), ("b", [0.0]), ("c", []), ("d", None)], "k string, v array<double>")
    assert sorted((r.k, r.dim, r.value) for r in rows.select("k", F.inline(V.non_zero("v"))).collect()) == [("a", 1, 2.5), ("a", 3, -1.0)]


def test_a_variant_is_looked_up_once(spark):
    rows = spark.createDataFrame([('{"a":[1,"x",[2.0,null]],"b":{"c":true},"d":null,"e":1.50}',), ("[1]",), (None,)], "j string").select(F.try_parse_json("j").alias("context"))
    assert optimized(rows.select(P.variant_signal(P.variant_lookup(F.col("context"), "a")).alias("s"))).count("$['a']") == 1
    got = [r.s for r in rows.select(P.variant_signals(F.col("context"), ("a", "b", "b.c", "d", "e", "gone")).alias("s")).collect()]
    assert {k: (v.kind, v["items"]) for k, v in got[0].items()} == {
        "a": ("list", ["1", "x", "2.0", "none"]),
        "b": ("object", ["c"]), "b.c": ("flag", ["true"]), "e": ("number", ["1.5"]),
    }
    assert not got[1] and not got[2]


def test_nested_contexts_are_dealt_to_tasks(spark):
    assert I.table(spark, SF, "part").rdd.getNumPartitions() < I.LEAST_TASKS <= R.nested_contexts(spark, SF).rdd.getNumPartitions()
