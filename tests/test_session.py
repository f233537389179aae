"""Scans of small tables use all cores."""

from pyspark.sql import functions as F

from melder.session import spread


def test_few_splits_are_dealt_over_all_cores(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).select("id", (F.col("id") % 2).alias("key")).coalesce(1).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    dealt = spread(spark.read.parquet(path))
    used = dealt.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == cores
    assert sorted(r["id"] for r in dealt.collect()) == list(range(100))


def test_enough_splits_do_not_move(spark, tmp_path):
    path = str(tmp_path / "many")
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(3 * cores).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        scan = spark.read.parquet(path)
        assert spread(scan) is scan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_empty_table_stays_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.range(0).write.parquet(path)
    assert spread(spark.read.parquet(path)).count() == 0
