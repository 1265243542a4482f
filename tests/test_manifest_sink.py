from docvet.plans import parse_queries as Q
from docvet.sources import stores


def test_manifests_hold_no_text(spark, tmp_path):
    selected, fetched, skipped = Q.crawl_tables(spark, "/root/testdata/sf0.001")
    tables = {"selected": selected, "fetched": fetched.withColumn("text", fetched["path"]), "skipped": skipped}
    stores.write_crawl_manifests(Q.K.crawl_summary(selected, fetched, skipped), tables, f"{tmp_path}/m")
    for name, df in tables.items():
        back = spark.read.json(f"{tmp_path}/m/{name}")
        assert set(back.columns) == {"repo", *stores.MANIFEST_PARTS[name]} and back.count() == df.count()
    assert spark.read.json(f"{tmp_path}/m/summary").count() == selected.select("repo").distinct().count()
