"""Ordered, completeness-checked collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 1000


def tracklist(tracks: DataFrame, limit: int = MOST) -> DataFrame:
    """tracks(album_id, disc, position, ...) in order of disc and position, the first `limit`."""
    n = F.row_number().over(Window.partitionBy("album_id").orderBy("disc", "position", "track_id")).cast("long")
    return tracks.withColumn("place", n).where(F.col("place") <= min(limit, MOST))


def disc_coverage(tracks: DataFrame, declared: DataFrame) -> DataFrame:
    """album_id, disc, returned, contiguous, declared, complete: complete if positions run from 1
    to the declared total without gap or repeat."""
    got = tracks.groupBy("album_id", "disc").agg(F.count("*").alias("returned"), F.countDistinct("position").alias("d"), F.min("position").alias("low"), F.max("position").alias("high"))
    got = got.select("album_id", "disc", "returned", ((F.col("d") == F.col("returned")) & (F.col("low") == 1) & (F.col("high") == F.col("returned"))).alias("contiguous"))
    out = got.join(declared, ["album_id", "disc"], "left")
    return out.select("album_id", "disc", "returned", "contiguous", "declared", F.coalesce(F.col("contiguous") & (F.col("declared") == F.col("returned")), F.lit(False)).alias("complete"))


def album_total(declared: DataFrame) -> DataFrame:
    """album_id, total: the sum over discs, null if one is unknown."""
    return declared.groupBy("album_id").agg(F.when(F.count(F.when(F.col("declared").isNull(), 1)) == 0, F.sum("declared")).alias("total"))


def completeness(albums: DataFrame) -> DataFrame:
    """albums(album_id, returned, total, valid, limited, failed) with complete and reason."""
    whole = F.col("valid") & (F.col("total") == F.col("returned"))
    reason = F.when(F.coalesce(whole, F.lit(False)), F.lit(None)).when(F.col("failed"), "upstream_error").when(F.col("total").isNull(), "unknown_total").when(F.col("limited"), "limit").otherwise("incomplete_response")
    return albums.withColumns({"complete": F.coalesce(whole, F.lit(False)), "reason": reason})
