"""String similarity and the candidate score."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melder.functions.text import clean_artist, clean_title, round2, token_set_ratio
from melder.session import staged


def jaro(a: bytes, b: bytes) -> float:
    """Over bytes; a half-transposition counts as half, not rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, unused in zip(b, free, strict=True) if not unused]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_bytes(a: bytes, b: bytes) -> float:
    j = jaro(a, b)
    if j < 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of a batch is compared once; no row moves."""
    known: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else jaro_winkler_bytes(pair[0].encode(), pair[1].encode())
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def composite(a: Column, b: Column, method: str = "full") -> Column:
    """0.6 Jaro-Winkler and 0.4 token ratio; `tokens` leaves the first out, for cross-checks."""
    if method == "tokens":
        return token_set_ratio(a, b)
    return 0.6 * jaro_winkler(a, b) + 0.4 * token_set_ratio(a, b)


def _present(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


#: Distinct pairs of texts are broadcast up to this many bytes of text, joined with a shuffle beyond it.
BROADCAST_BYTES = 32 << 20


def with_pairs(rows: DataFrame, facts: dict[tuple[str, str], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """rows with the columns that each facts[(a, b)] adds to the distinct values of columns a and b.

    Sources repeat each other, so a pair of texts is compared once, not once a row. One scan of the
    texts alone writes the distinct pairs; kinds of pairs under BROADCAST_BYTES are dealt over all cores,
    whatever their few bytes, and go to the rows, which then don't move; others meet the rows in a
    shuffle, where AQE splits a pair that many rows share. What the facts add is a few numbers a pair.
    """
    kinds = list(facts)
    spark = rows.sparkSession
    entry = lambda i, a, b: F.struct(F.lit(i).alias("kind"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    every = staged(rows.select(F.explode(F.array(*[entry(i, a, b) for i, (a, b) in enumerate(kinds)])).alias("p")).select("p.*").distinct(), "pairs")
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) + 64
    sizes = {r["kind"]: r["bytes"] for r in every.groupBy("kind").agg(F.sum(size("a") + size("b")).alias("bytes")).collect()}
    out = rows
    for i, (a, b) in enumerate(kinds):
        pairs = every.where(F.col("kind") == i).select(F.col("a").alias(a), F.col("b").alias(b))
        small = sizes.get(i, 0) <= BROADCAST_BYTES
        if small:
            pairs = pairs.repartition(spark.sparkContext.defaultParallelism)
        made = facts[a, b](pairs).withColumnsRenamed({a: "_left", b: "_right"})
        made = F.broadcast(made) if small else made
        out = out.join(made, F.col(a).eqNullSafe(F.col("_left")) & F.col(b).eqNullSafe(F.col("_right")), "left").drop("_left", "_right")
    return out


def _titles(column: str, method: str) -> Callable[[str, str], Callable[[DataFrame], DataFrame]]:
    def facts(a: str, b: str) -> Callable[[DataFrame], DataFrame]:
        def add(pairs: DataFrame) -> DataFrame:
            clean = pairs.withColumns({"_x": clean_title(F.coalesce(a, F.lit(""))), "_y": clean_title(F.coalesce(b, F.lit("")))})
            both = (F.col("_x") != "") & (F.col("_y") != "")
            return clean.withColumn(column, F.when(both, round2(composite(F.col("_x"), F.col("_y"), method)))).drop("_x", "_y")

        return add

    return facts


def _artists(pairs: DataFrame, method: str) -> DataFrame:
    clean = pairs.withColumns({"_x": clean_artist(F.coalesce("q_artist", F.lit(""))), "_y": clean_artist(F.coalesce("artist", F.lit("")))})
    found = F.when(F.col("_x") != "", round2(composite(F.col("_x"), F.col("_y"), method))).otherwise(F.lit(0.8))
    return clean.withColumn("_as", F.when(_present(F.col("artist")), found)).drop("_x", "_y")


def pair_facts(method: str = "full") -> dict[tuple[str, str], Callable[[DataFrame], DataFrame]]:
    """What score() needs of the distinct pairs of titles (_ts), artists (_as) and albums (_bs)."""
    return {
        ("q_title", "title"): _titles("_ts", method)("q_title", "title"),
        ("q_artist", "artist"): lambda pairs: _artists(pairs, method),
        ("q_album", "album"): _titles("_bs", method)("q_album", "album"),
    }


def score(rows: DataFrame, method: str = "full") -> DataFrame:
    """rows with title_score, artist_score, album_score, isrc_score (each null where not
    evaluated) and score.

    rows has q_title, q_artist, q_album, q_isrc, title, artist, album, isrc and direct (whether
    the candidate is the one asked for by id). Parts are rounded before they are weighted.
    """
    return weighted(with_pairs(rows, pair_facts(method))).drop("_ts", "_as", "_bs")


def weighted(rows: DataFrame) -> DataFrame:
    """score() of rows that have the scores of their pairs."""
    both_isrc = _present(F.col("q_isrc")) & _present(F.col("isrc"))
    same_isrc = F.upper(F.trim("q_isrc")) == F.upper(F.trim("isrc"))
    conflict = both_isrc & ~same_isrc
    exact = both_isrc & (F.upper("q_isrc") == F.upper("isrc"))
    direct = F.coalesce(F.col("direct"), F.lit(False))
    zero = F.lit(0.0)
    t, a = F.coalesce("_ts", zero), F.coalesce("_as", zero)
    raw = F.when(F.col("_bs").isNull(), 0.55 * t + 0.45 * a).otherwise(0.50 * t + 0.40 * a + 0.10 * F.col("_bs"))
    raw = F.when((raw >= 0.99) & ~both_isrc, 0.96).otherwise(raw)
    full = direct | exact
    none = F.lit(None).cast("double")
    return rows.withColumns(
        {
            "title_score": F.when(conflict, none).when(full, 1.0).otherwise(F.col("_ts")),
            "artist_score": F.when(conflict, none).when(full, 1.0).otherwise(F.col("_as")),
            "album_score": F.when(conflict | full, none).otherwise(F.col("_bs")),
            "isrc_score": F.when(conflict, 0.0).when(direct, none).when(_present(F.col("isrc")), 1.0),
            "score": F.when(conflict, 0.0).when(full, 1.0).otherwise(round2(raw)),
        }
    )


def artist_score(names: Column, wanted: Column, method: str = "full") -> Column:
    """The best score of the wanted artist against each name and all names joined by blanks; 0.8
    where none is wanted, null without names. With Jaro-Winkler only for a single name (a UDF can't
    run inside an array function): explode the names before."""
    if method != "tokens":
        raise ValueError("explode the names and score each by composite()")
    target = clean_artist(F.coalesce(wanted, F.lit("")))
    every = F.concat(names, F.array(F.array_join(names, " ")))
    best = F.array_max(F.transform(every, lambda n: token_set_ratio(target, clean_artist(n))))
    return F.when(F.size(names) > 0, F.when(target != "", best).otherwise(F.lit(0.8)))
