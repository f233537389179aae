"""Landed bodies of sources: one table whose folders are sources and buckets of ids.

A lookup of some sources and ids lists the folders that can hold them and reads nothing else, which the
scan's PartitionFilters show; ids are pushed into the files besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(native_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(native_id.cast("string")), F.lit(buckets)).cast("int")


def land(bodies: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Appends bodies(provider, native_id, body, ...) to the table at path. Rows are spread by source, bucket
    and a part of the id's hash, so that a source with most of the rows isn't written by one task."""
    rows = bodies.withColumns({"provider": F.lower(F.trim("provider")), "bucket": bucket(F.col("native_id"), buckets)})
    rows.repartition("provider", "bucket").write.mode("append").partitionBy("provider", "bucket").parquet(path)


def landed(spark: SparkSession, path: str, sources: list[str] | None = None, ids: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The landed rows of the sources (all by default) and ids (all by default). For many ids join lookups()."""
    rows = spark.read.parquet(path)
    if sources is not None:
        rows = rows.where(F.col("provider").isin(*[s.strip().lower() for s in sources]))
    if ids is not None:
        which = spark.range(1).select(F.array_distinct(F.array(*[bucket(F.lit(i), buckets) for i in ids])).alias("b")).first()["b"] if ids else []
        rows = rows.where(F.col("bucket").isin(*which) & F.col("native_id").isin(*ids))
    return rows.drop("bucket")


def lookups(asked: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """asked(provider, native_id, ...) with the landed rows of the same source and id: a join on the folders'
    columns too, so that a small table of requests prunes them while the plan runs."""
    rows = asked.sparkSession.read.parquet(path)
    keyed = asked.withColumns({"provider": F.lower(F.trim("provider")), "bucket": bucket(F.col("native_id"), buckets)})
    return rows.join(keyed, ["provider", "bucket", "native_id"]).drop("bucket")
