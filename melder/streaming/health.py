"""The circuit of each source over a stream of call outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.operators.state import step

STATE = "state string, failures int, retry_at double, generation int, calls long, allowed long"
OUT = "source long, calls long, allowed long, failures long, state string, generation long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
    name, failures, retry, generation, calls, allowed = group.get if group.exists else ("active", 0, 0.0, 1, 0, 0)
    state = (name, failures, retry, generation)
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["at", "seq"], kind="stable")
    for at, failed in zip(rows["at"], rows["failed"], strict=True):
        calls += 1
        state, ok = step(state, float(at), bool(failed))
        allowed += ok
    group.update((state[0], int(state[1]), float(state[2]), int(state[3]), int(calls), int(allowed)))
    yield pd.DataFrame([(key[0], calls, allowed, state[1], state[0], state[3])], columns=[c.split()[0] for c in OUT.split(", ")])


def circuit_stream(events: DataFrame) -> DataFrame:
    """events(source, ts, seq, failed) as a stream: after each micro-batch, the circuit of each
    source that was called. State is a few numbers a source."""
    rows = events.select(F.col("source").cast("long").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "seq", "failed")
    return rows.groupBy("source").applyInPandasWithState(_advance, OUT, STATE, "update", "NoTimeout")
