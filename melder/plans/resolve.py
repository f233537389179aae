"""Resolution of many requests at once, as one lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.operators import fusion, gates, identity, selection
from melder.session import staged

FIELDS = ["title", "album", "duration_ms", "release_date", "isrc", "label"]


def accepted(candidates: DataFrame, method: str = "full", more: list[str] | None = None, facts: list[str] | None = None) -> DataFrame:
    """query_id, by_isrc, by_id (how it asks) and rows, an array of the scored and gated rows that are fused (so it has as many
    entries as there are sources): the best accepted one of each source without strays of duration,
    or, where none is left, the best of all if it may be reported and passes the gates. Entries carry
    the columns of `more` too, and `facts` (artist and FIELDS, if not given; duration_ms at least)."""
    rows = gates.judge(candidates, method)
    fits = (F.col("score") >= gates.REPORT) & F.col("artist_ok") & F.col("identity_ok")
    entry = F.struct("provider", "rank", "score", "direct", *(facts or ["artist", *FIELDS]), *(more or []), "accepted", fits.alias("fits"))
    # one aggregate serves both cases: a source's best accepted row, or its best one if none is
    order = F.struct((~F.col("accepted")).alias("a"), (-F.col("score")).alias("s"), F.col("rank").alias("r"))
    asked = [F.bool_or(F.coalesce(F.trim("q_isrc"), F.lit("")) != "").alias("by_isrc"), F.bool_or(F.coalesce("q_direct", F.lit(False))).alias("by_id")]
    per = rows.groupBy("query_id", F.lower("provider").alias("p")).agg(F.min_by(entry, order).alias("e"), *asked)
    one = per.groupBy("query_id").agg(F.array_sort(F.collect_list("e")).alias("every"), F.bool_or("by_isrc").alias("by_isrc"), F.bool_or("by_id").alias("by_id"))
    kept = selection.without_strays(one.withColumn("rows", F.filter("every", lambda x: x["accepted"])), "rows", F.col("by_isrc"), F.col("by_id"))
    best = F.array_min(F.transform("every", lambda x: F.struct((-x["score"]).alias("s"), x["provider"].alias("p"), x["rank"].alias("r"), x.alias("e"))))
    return kept.withColumn("_best", F.when(F.size("rows") == 0, best)).select("query_id", "by_isrc", "by_id", F.when(F.col("_best.e.fits"), F.array("_best.e")).otherwise(F.col("rows")).alias("rows"))


def resolve(candidates: DataFrame, policy: fusion.Policy | None = None, method: str = "full") -> DataFrame:
    """query_id, canonical_id, title, artist, album, duration_ms, isrc, n_sources, match_score,
    confidence, identity_status of candidates(query_id, provider, rank, q_*, ...).

    Candidates are scored where they are read; what is left of them is shuffled once by query
    and source and once by query, and fused within the query's row.
    """
    base = policy or fusion.Policy()
    by_source = fusion.Policy(base.mode, {**base.priorities, "artists": base.order("artists")})
    names = {**{f: f for f in FIELDS}, "artists": "artist"}
    there = F.exists("rows", lambda x: reduce(Column.__or__, [fusion.filled(x[name], f) for f, name in names.items()]))
    # written before it is filtered: the filter would be pushed below what makes the arrays
    kept = staged(accepted(candidates, method), "kept").where(there)
    won = fusion.chosen(kept, "rows", by_source, names)
    # the sources that agree on the chosen ISRC vouch for it, others with one of their own don't
    votes = F.coalesce("isrc.n_votes", F.lit(0)).alias("votes")
    out = won.select(
        "query_id", F.size("rows").cast("long").alias("n_sources"), F.array_max(F.transform("rows", lambda x: x["score"])).alias("match_score"),
        F.exists("rows", lambda x: x["provider"] == "musicbrainz").alias("has_mbid"), *[F.col(f)["value"].alias(name) for f, name in names.items()], votes, F.lit(None).cast("string").alias("mbid"),
    )
    has_isrc = F.col("isrc").isNotNull()
    return out.select(
        "query_id", identity.canonical_id("title", "artist", "isrc", "mbid").alias("canonical_id"), "title", "artist", "album", F.col("duration_ms").cast("long").alias("duration_ms"), "isrc", "n_sources", "match_score",
        identity.confidence_level(F.col("match_score"), F.col("votes")).alias("confidence"), identity.identity_status(F.col("match_score"), F.col("votes"), F.col("has_mbid"), has_isrc).alias("identity_status"),
    )
