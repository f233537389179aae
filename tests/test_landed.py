"""Landed bodies by source and id."""

from melder.sources.landed import land, landed, lookups


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_sources_and_ids_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/bodies"
    rows = [(p, str(i), f"{p}{i}") for p in ("Deezer", "spotify", "tidal") for i in range(50)]
    bodies = spark.createDataFrame([*rows, ("tidal", None, "no id")], "provider string, native_id string, body string")
    land(bodies, path, 8)
    land(spark.createDataFrame([("deezer", "77", "later")], bodies.schema), path, 8)
    one = landed(spark, path, [" DEEZER "], ["7", "77", "none"], 8)
    assert {(r["provider"], r["native_id"], r["body"]) for r in one.collect()} == {("deezer", "7", "Deezer7"), ("deezer", "77", "later")}
    told = plan(one)
    assert "PartitionFilters: [" in told and "provider" in told.split("PartitionFilters: [")[1].split("]")[0] and "bucket" in told.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in told and "In(native_id" in told
    assert landed(spark, path).count() == 152 and landed(spark, path, []).count() == 0 and landed(spark, path, ids=[]).count() == 0
    asked = spark.createDataFrame([("tidal", "3", 1), ("tidal", None, 2), ("spotify", "x", 3)], "provider string, native_id string, query_id int")
    assert [(r["body"], r["query_id"]) for r in lookups(asked, path, 8).collect()] == [("tidal3", 1)]
