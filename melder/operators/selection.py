"""Best candidates, fallbacks and duration outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.operators.gates import REPORT


def best_per_source(rows: DataFrame) -> DataFrame:
    """The row with the highest score of each query and source, the first on ties: a partial
    aggregate, so a hot query's rows never meet in one task before they are few. All columns of rows
    are carried along: select what is wanted before. The keys stay outside the carried row, so that
    Spark knows that the result is still dealt by them."""
    key = ["query_id", "provider"]
    row = F.struct(*[c for c in rows.columns if c not in key])
    best = rows.groupBy(*key).agg(F.max_by(row, F.struct("score", (-F.col("rank")).alias("r"))).alias("b"))
    return best.select(*[F.col(c).alias(c) if c in key else F.col("b")[c].alias(c) for c in rows.columns])


def top_per_source(rows: DataFrame, k: int = 10) -> DataFrame:
    """The first k rows of each query and source by rank; Spark limits each window group early."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("query_id", "provider").orderBy("rank"))
    return rows.withColumn("n", n).where(F.col("n") <= k).drop("n")


def global_fallback(rows: DataFrame) -> DataFrame:
    """For queries without an accepted row, their best row, if it may be reported and passes the gates."""
    row = F.struct(*[c for c in rows.columns if c != "query_id"])
    order = F.struct("score", F.expr("transform(split(provider, ''), c -> -ascii(c))").alias("p"), (-F.col("rank")).alias("r"))
    # one aggregate tells both: rows are read once and none of a query with an accepted one is joined away
    best = rows.groupBy("query_id").agg(F.max_by(row, order).alias("b"), F.bool_or("accepted").alias("any")).where("not coalesce(any, false)")
    return best.select(F.col("query_id").alias("query_id"), "b.*").where((F.col("score") >= REPORT) & F.col("artist_ok") & F.col("identity_ok"))


_TOLERANCE = "greatest(10000L, cast(floor({0} / 20) as bigint))"


def _anchor(d: str) -> str:
    """SQL for the anchor of sorted durations d: with three or more, the lower middle of the densest
    run (each within a tolerance of its first) if it is a strict majority of two or more."""
    runs = f"transform(sequence(0, size({d}) - 1), s -> struct(size(filter({d}, (x, i) -> i >= s and x - {d}[s] <= {_TOLERANCE.format(f'{d}[s]')})) as n, -s as s))"
    middle = f"transform(array(array_max({runs})), b -> case when b.n >= 2 and b.n * 2 > size({d}) then {d}[cast(floor((-b.s + (-b.s + b.n) - 1) / 2) as int)] end)[0]"
    return f"case when size({d}) >= 3 then {middle} end"


def duration_outliers(rows: DataFrame) -> DataFrame:
    """query_id, provider, duration_ms, rejected of the first timed row of each source: those farther
    from the anchor than its tolerance. A query has as many entries as there are sources."""
    timed = rows.where("duration_ms > 0").groupBy("query_id", F.lower("provider").alias("provider")).agg(F.min_by("duration_ms", "rank").alias("duration_ms"))
    one = timed.groupBy("query_id").agg(F.collect_list(F.struct("provider", "duration_ms")).alias("e")).withColumn("d", F.expr("array_sort(transform(e, x -> x.duration_ms))"))
    out = one.select("query_id", F.expr(_anchor("d")).alias("anchor"), F.explode("e").alias("e")).select("query_id", "anchor", "e.*")
    far = F.expr(f"abs(duration_ms - anchor) > {_TOLERANCE.format('anchor')}")
    return out.select("query_id", "provider", "duration_ms", F.coalesce(far, F.lit(False)).alias("rejected"))


def without_outliers(rows: DataFrame, column: str) -> DataFrame:
    """rows whose array `column` (one row for each source) loses its outliers of duration."""
    timed = rows.withColumn("_d", F.expr(f"array_sort(transform(filter({column}, x -> x.duration_ms > 0), x -> x.duration_ms))")).withColumn("_a", F.expr(_anchor("_d")))
    near = f"filter({column}, x -> coalesce(x.duration_ms <= 0 or abs(x.duration_ms - _a) <= {_TOLERANCE.format('_a')}, true))"
    return timed.withColumn(column, F.expr(near)).drop("_d", "_a")


def without_strays(rows: DataFrame, column: str, asked_isrc: Column, asked_id: Column) -> DataFrame:
    """without_outliers() as a request has it: one by ISRC loses nothing, one by id loses what is off
    the duration of the row (marked `direct`) that has the id, if that row is timed."""
    seed = F.expr(f"get(filter({column}, x -> x.direct and x.duration_ms > 0), 0).duration_ms")
    near = F.expr(f"filter({column}, x -> coalesce(x.direct, false) or coalesce(x.duration_ms <= 0 or abs(x.duration_ms - _seed) <= {_TOLERANCE.format('_seed')}, true))")
    both = rows.withColumns({"_all": F.col(column), "_seed": seed}).withColumn("_near", near)
    kept = F.when(asked_isrc, F.col("_all")).when(asked_id, F.col("_near")).otherwise(F.col(column))
    return without_outliers(both, column).withColumn(column, kept).drop("_all", "_seed", "_near")


def anchored_durations(rows: DataFrame) -> DataFrame:
    """query_id, provider, rejected: sources off the duration of the row asked for by id."""
    seeds = rows.where("direct and duration_ms > 0").groupBy("query_id").agg(F.min_by("duration_ms", F.struct("provider", "rank")).alias("seed"))
    others = rows.where("not coalesce(direct, false) and duration_ms > 0").join(seeds, "query_id")
    far = F.expr("abs(duration_ms - seed) > greatest(10000L, cast(floor(seed / 20) as bigint))")
    return others.groupBy("query_id", F.lower("provider").alias("provider")).agg(F.bool_or(far).alias("rejected"))


def trusted(rows: DataFrame) -> DataFrame:
    """rows(query_id, provider, native_id, isrc, q_isrc, q_provider, q_id) with trusted and reason.

    Asked by id: the source's own row with that very id, compared with case; asked by ISRC: rows with
    the same one; else every row. An accepted row that isn't trusted is `unverified_candidate`."""
    by_id = F.coalesce(F.trim("q_provider"), F.lit("")) != ""
    by_isrc = F.coalesce(F.trim("q_isrc"), F.lit("")) != ""
    own = F.coalesce((F.lower("provider") == F.lower("q_provider")) & (F.col("native_id") == F.col("q_id")), F.lit(False))
    same = F.coalesce(F.upper(F.trim("isrc")) == F.upper(F.trim("q_isrc")), F.lit(False))
    out = rows.withColumn("trusted", F.when(by_id, own).when(by_isrc, same).otherwise(True))
    return out.withColumn("reason", F.when(F.col("accepted") & ~F.col("trusted"), "unverified_candidate"))


def asked_sources(requests: DataFrame, sources: list[str], more: list[str] | None = None) -> DataFrame:
    """(query_id, provider) and the columns of `more`: the sources asked first. A request by id that has neither title nor ISRC
    asks the id's own source alone."""
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    alone = given("q_provider") & ~given("q_title") & ~given("q_isrc")
    every = requests.withColumn("provider", F.explode(F.array(*[F.lit(s) for s in sources])))
    return every.where(~alone | (F.col("provider") == F.lower("q_provider"))).select("query_id", "provider", *(more or []))


def first_matches(matches: DataFrame) -> DataFrame:
    """The first (by seq) of each query's identity matches with the same source and id."""
    row = F.struct(*matches.columns)
    return matches.groupBy("query_id", "provider", "id").agg(F.min_by(row, "seq").alias("m")).select("m.*")
