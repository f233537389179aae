"""State over time in batch: circuits, caches, shared computations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Failures in a row that suspend a source, for how long, and cache times in seconds.
THRESHOLD, COOLDOWN_S = 3, 60
TTL, TTL_DEGRADED, TTL_POINTS, TTL_POINTS_EMPTY = 86_400, 30, 3600, 300


def step(state: tuple[str, int, float, int], at: float, failed: bool, missing: bool = False, threshold: int = THRESHOLD, cooldown: float = COOLDOWN_S) -> tuple[tuple[str, int, float, int], bool]:
    """((name, failures, retry_at, generation), allowed) after one call at a time.

    A suspended source lets no call through before retry_at, then one probe; success or `not
    found` resets it, a failure of the probe suspends it again.
    """
    name, failures, retry_at, generation = state
    if name == "suspended" and at < retry_at:
        return state, False
    if not failed or missing:
        return ("active", 0, 0.0, generation), True
    failures += 1
    if failures >= threshold:
        return ("suspended", failures, at + cooldown, generation + 1), True
    return (name, failures, retry_at, generation), True


def circuit(events: DataFrame, threshold: int = THRESHOLD, cooldown: float = COOLDOWN_S) -> DataFrame:
    """source, calls, allowed, failures, state, generation after all events(source, ts, seq, failed)
    in order of time. A task holds one source's batch at a time: partitions are sorted, and the
    state, not the events, is what is kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, calls, allowed, state = None, 0, 0, ("active", 0, 0.0, 1)
        out: list[tuple] = []
        for f in frames:
            for source, at, failed in zip(f["source"], f["at"], f["failed"], strict=True):
                if source != now:
                    if now is not None:
                        out.append((now, calls, allowed, state[1], state[0], state[3]))
                    now, calls, allowed, state = source, 0, 0, ("active", 0, 0.0, 1)
                calls += 1
                state, ok = step(state, at, bool(failed), False, threshold, cooldown)
                allowed += ok
        if now is not None:
            out.append((now, calls, allowed, state[1], state[0], state[3]))
        yield pd.DataFrame(out, columns=["source", "calls", "allowed", "failures", "state", "generation"])

    rows = events.where("source is not null").select(F.col("source").cast("long").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("seq"), F.col("failed"))
    return rows.repartition("source").sortWithinPartitions("source", "at", "seq").mapInPandas(run, "source long, calls long, allowed long, failures long, state string, generation long")


def states(health: DataFrame) -> DataFrame:
    return health.groupBy("state").agg(F.count("*").alias("n"))


def signature(health: DataFrame, now: float | None = None) -> DataFrame:
    """One row: name:state:mode of all sources of health(source, state) with optional mode, retry_at
    and probing, sorted by name; part of cache keys. A suspended source whose time has come is
    retry_ready, or probing while one call tries it."""
    state = F.col("state")
    if now is not None and "retry_at" in health.columns:
        due = (state == "suspended") & (F.col("retry_at") <= now)
        busy = F.coalesce(F.col("probing"), F.lit(False)) if "probing" in health.columns else F.lit(False)
        state = F.when(due & busy, "probing").when(due, "retry_ready").otherwise(state)
    mode = F.coalesce(F.col("mode"), F.lit("")) if "mode" in health.columns else F.lit("")
    name = F.col("source").cast("string")
    rows = health.select(F.struct(name.alias("n"), F.concat_ws(":", name, state, mode).alias("x")).alias("e"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "|").alias("signature"))


# Calls a second and burst of each source.
LIMITS = {
    "musicbrainz": (1, 1), "deezer": (50, 10), "applemusic": (1 / 3, 1), "applemusic_catalog": (5, 1), "coverartarchive": (3, 1), "sponsorblock": (2, 1), "lastfm": (3, 1), "discogs": (1, 1), "acoustid": (3, 1), "ytmusic": (20, 5),
    "spotify": (10, 3), "soundcloud": (10, 3), "jiosaavn": (5, 2), "qobuz": (5, 2), "tidal": (10, 3), "amazonmusic": (5, 2), "pandora": (5, 2), "bugs": (1, 1), "genie": (1, 1), "melon": (1, 1),
}


def admitted(calls: DataFrame, rate: float, burst: int) -> DataFrame:
    """calls(key, at, seq) with allowed: a token bucket for each key that holds `burst` tokens and gains
    `rate` a second. The fold needs a key's calls in order; keys are dealt to all tasks."""

    def run(frames):
        key = tokens = last = None
        for f in frames:
            out = []
            for k, at in zip(f["key"], f["at"], strict=True):
                if k != key:
                    key, tokens, last = k, float(burst), at
                tokens, last = min(float(burst), tokens + (at - last) * rate), at
                out.append(tokens >= 1)
                tokens -= out[-1]
            yield f.assign(allowed=out)

    rows = calls.select("key", F.col("at").cast("double").alias("at"), "seq").repartition("key").sortWithinPartitions("key", "at", "seq")
    kinds = dict(calls.dtypes)
    return rows.mapInPandas(run, f"key {kinds['key']}, at double, seq {kinds['seq']}, allowed boolean")


def cache_read(cache: DataFrame, now: float) -> DataFrame:
    """key, value: the latest entry of each key, unless it has expired."""
    last = cache.groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), F.struct("written_at", "value")).alias("e"))
    return last.where(F.col("e.expires_at") > now).select("key", F.col("e.value").alias("value"))


def ttl(degraded: Column, has_points: Column, found: Column) -> Column:
    """Seconds to keep a result: short if a source failed, shorter for time points."""
    base = F.when(degraded, TTL_DEGRADED).otherwise(TTL)
    limit = F.when(has_points & found, TTL_POINTS).when(has_points, TTL_POINTS_EMPTY).otherwise(TTL)
    return F.least(base, limit)


def shared(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaders, members): one request for each key is computed, the others wait for it."""
    leaders = requests.groupBy("key").agg(F.min("request_id").alias("leader"), F.count("*").alias("waiting"))
    return leaders, requests.join(leaders, "key").select("request_id", "key", "leader")
