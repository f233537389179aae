"""Joins that enrich accepted records, with a check of identity on each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.session import joined

NEAR_MS = 2000


def hydrate(base: DataFrame, detail: DataFrame, fields: list[str]) -> DataFrame:
    """base with fields taken from detail(provider, native_id, ...) where the record agrees, and
    hydration: ok, no_detail or identity_mismatch (then the row stays as it was).

    A detail agrees if ISRCs don't contradict and durations are within NEAR_MS, where both know.
    """
    d = detail.select("provider", "native_id", *[F.col(f).alias(f"d_{f}") for f in dict.fromkeys([*fields, "isrc", "duration_ms"])], F.lit(True).alias("there"))
    out = joined(base, d, ["provider", "native_id"], "left")
    isrc = F.coalesce(F.upper(F.trim("isrc")) == F.upper(F.trim("d_isrc")), F.lit(True))
    near = F.coalesce(F.abs(F.col("duration_ms") - F.col("d_duration_ms")) <= NEAR_MS, F.lit(True))
    agrees = F.col("there") & isrc & near
    state = F.when(F.col("there").isNull(), "no_detail").when(agrees, "ok").otherwise("identity_mismatch")
    filled = [F.when(F.coalesce(agrees, F.lit(False)), F.coalesce(f"d_{f}", f)).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in base.columns]
    return out.select(*filled, state.alias("hydration"))


def with_detail(base: DataFrame, details: DataFrame, fields: list[str]) -> DataFrame:
    """base with the fields of details(provider, native_id, title, artist, isrc, duration_ms, album_id, ...)
    where a record's own page is the same record, and hydration: ok, unavailable or identity_mismatch.

    The page must have the row's ISRC if the row has one, its title and first artist but for case
    and surrounding blanks, a duration within NEAR_MS and the same album id where both know. What the
    page leaves out stays as the row has it (0 is no duration); id, title and artist always stay.
    """
    facts = list(dict.fromkeys(["title", "artist", "isrc", "duration_ms", "album_id", *fields]))
    d = details.select("provider", "native_id", F.struct(*facts).alias("d"))
    out = joined(base, d, ["provider", "native_id"], "left")
    fold = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    text = lambda c: fold(c) != ""
    mine, page = F.col, lambda f: F.col(f"d.{f}")
    timed = (mine("duration_ms") > 0) & (page("duration_ms") > 0)
    same = (
        (~text(mine("isrc")) | (fold(mine("isrc")) == fold(page("isrc"))))
        & ~F.coalesce(timed & (F.abs(mine("duration_ms") - page("duration_ms")) > NEAR_MS), F.lit(False))
        & (~text(mine("album_id")) | ~text(page("album_id")) | (mine("album_id") == page("album_id")))
        & (fold(mine("title")) == fold(page("title"))) & text(mine("artist")) & (fold(mine("artist")) == fold(page("artist")))
    )
    state = F.when(F.col("d").isNull(), "unavailable").when(same, "ok").otherwise("identity_mismatch")
    kinds = dict(base.dtypes)
    there = lambda f: (page(f) > 0) if kinds[f] in ("int", "bigint", "double") else F.size(page(f)) > 0 if kinds[f].startswith(("array", "map")) else page(f).isNotNull() if kinds[f] == "boolean" else text(page(f))
    taken = [F.when((F.col("hydration") == "ok") & F.coalesce(there(f), F.lit(False)), page(f)).otherwise(mine(f)).alias(f) if f in fields else F.col(f) for f in base.columns]
    return out.withColumn("hydration", state).select(*taken, "hydration")


def editions(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows joined with catalogue on folded title, artist and (where both have the column) album, and
    durations within NEAR_MS where both know. Durations are cut into bands of NEAR_MS, and a row
    meets its own and both neighbouring bands alone, so that a hot title isn't joined with itself."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    key = ["title", "artist", *(["album"] if "album" in rows.columns and "album" in catalogue.columns else [])]
    band = F.floor(F.col("duration_ms") / NEAR_MS)
    bands = F.when(band.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(band - 1, band, band + 1))
    a = rows.withColumns({f"_{c}": fold(c) for c in key})
    b = catalogue.select(*[fold(c).alias(f"_{c}") for c in key], "edition_id", F.col("duration_ms").alias("edition_ms"), band.alias("_band"))
    on = [f"_{c}" for c in key]
    near = F.abs(F.col("duration_ms") - F.col("edition_ms")) <= NEAR_MS
    timed = a.where("duration_ms is not null").withColumn("_band", F.explode(bands)).join(b.where("edition_ms is not null"), [*on, "_band"]).where(near).drop("_band")
    free = a.where("duration_ms is null").join(b.drop("_band"), on).unionByName(a.where("duration_ms is not null").join(b.where("edition_ms is null").drop("_band"), on))
    return timed.unionByName(free).drop(*on)


def video_points(videos: DataFrame, points: DataFrame, most: int = 100) -> DataFrame:
    """Points of videos, found by a bucket of the id's hash and then the id itself, in order of time
    and id, the first `most` with whether others were left out."""
    from pyspark.sql import Window

    bucket = lambda c: F.substring(F.sha2(F.col(c).cast("string").cast("binary"), 256), 1, 4)
    j = videos.withColumn("bucket", bucket("video_id")).join(points.withColumn("bucket", bucket("video_id")), ["bucket", "video_id"])
    w = Window.partitionBy("video_id")
    place = F.row_number().over(w.orderBy("time_ms", "point_id"))
    return j.withColumn("place", place).withColumn("truncated", F.count("*").over(w) > most).where(F.col("place") <= most)


def second_pass(queries: DataFrame, status: DataFrame, seeds: DataFrame, sources: list[str]) -> DataFrame:
    """(query_id, provider, title, artist, isrc): sources still without a match, asked with the seed's fields."""
    done = status.where("status = 'matched'").groupBy("query_id").agg(F.collect_set("provider").alias("_done"))
    # a query meets what it has once, not once for each source
    asked = joined(joined(seeds, queries.select("query_id"), "query_id", "left_semi"), done, "query_id", "left")
    left = F.array_except(F.array(*[F.lit(s) for s in sources]), F.coalesce("_done", F.array().cast("array<string>")))
    return asked.withColumn("provider", F.explode(left)).drop("_done")
