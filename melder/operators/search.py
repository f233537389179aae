"""Search pages, field presence and totals of bulk requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, number: int = 1, limit: int = 10) -> DataFrame:
    """rows(query_id, score, canonical_id, available_on) of one page with place and total: by falling
    score, then id, then the joined platforms. A page past the end is empty."""
    limit = limit if 1 <= limit <= 50 else 10
    number = max(1, number)
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy(F.col("score").desc(), "canonical_id", F.array_join("available_on", ","))).cast("long")
    first = (number - 1) * limit
    return rows.withColumn("total", F.count("*").over(w)).withColumn("place", place).where((F.col("place") > first) & (F.col("place") <= first + limit))


def presence(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with present and missing: the sorted names of filled and unfilled fields."""
    kinds = dict(rows.dtypes)
    filled = {f: F.coalesce(F.size(f) > 0 if kinds[f].startswith(("array", "map")) else F.trim(F.col(f).cast("string")) != "", F.lit(False)) for f in fields}
    pick = lambda want: F.array_sort(F.filter(F.array(*[F.when(c if want else ~c, F.lit(f)) for f, c in filled.items()]), lambda x: x.isNotNull()))
    return rows.withColumns({"present": pick(True), "missing": pick(False)})


def bulk_totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"))
