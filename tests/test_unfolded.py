"""Arrays that are unfolded are worked out once."""

from pyspark.sql import functions as F

from melder.queries import QUERIES
from melder.session import unfolded


def filters(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line.split("(")[0]]


def test_unfolding_works_an_array_out_once(spark):
    rows = spark.createDataFrame([(1, [2, 3]), (2, []), (3, None)], "k int, n array<int>")
    made = rows.withColumn("e", F.transform("n", lambda x: F.struct((x * 2).alias("d"))))
    out = unfolded(made, ["k"], "e", "i", "s").select("k", "i", "s.d")
    assert sorted(map(tuple, out.collect())) == [(1, 0, 4), (1, 1, 6)]
    assert sorted(map(tuple, unfolded(made, ["k"], "e", "s").select("k", "s.d").collect())) == [(1, 4), (1, 6)]
    for df in (out, QUERIES["accepted_rows"](spark, "/root/testdata/sf0.001")):
        assert not [line for line in filters(df) if "size(" in line or "lambdafunction(" in line]
