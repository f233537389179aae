"""What the corpus operators share: tables in the shared folder, bounded bitmaps, Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and everything runs in one process (tests) a folder of our
    own is used; on a cluster, whose machines don't share such a folder, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="melder-")
    return _own_dir[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/melder-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: this cuts lineage, survives
    lost executors, and gives the planner true sizes for its own broadcast decisions."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches_of(spark: SparkSession, rows: int) -> None:
    """Bounds the rows of an Arrow batch, so that long texts can't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def crc32_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m: the fold of a document."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(m))


def bitmap(slots: DataFrame, col: str, bits: int) -> np.ndarray:
    """The set of the slots in `col` (0 <= slot < 2**bits) as a bit array of 2**bits / 8 bytes.

    The size depends on `bits` alone, never on the data: 2**24 slots are 2 MB. Executors reduce
    the slots to words of 2**10 bits each; the driver gets at most 2**(bits - 10) such words.
    """
    low = 10

    def pack(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            flags = np.zeros((len(g), 1 << low), dtype=np.uint8)
            for i, x in enumerate(g["lows"]):
                flags[i, np.asarray(x, dtype=np.int64)] = 1
            yield pd.DataFrame({"high": g["high"], "word": [r.tobytes() for r in np.packbits(flags, axis=1, bitorder="little")]})

    given = slots.select(F.col(col).cast("long").alias("slot")).where("slot is not null")
    words = given.groupBy(F.expr(f"shiftright(slot, {low})").alias("high")).agg(F.collect_set(F.expr(f"cast(slot & {(1 << low) - 1} as int)")).alias("lows"))
    batches_of(slots.sparkSession, 512)
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    size = (1 << low) // 8
    for row in words.mapInPandas(pack, "high long, word binary").toLocalIterator():
        out[row["high"] * size : (row["high"] + 1) * size] = np.frombuffer(bytes(row["word"]), dtype=np.uint8)
    return out


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """True where the slot is set."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def whole_groups(frames: Iterable[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that never cut a group, from the batches of a partition sorted by `key`.

    Only the last group of a batch is held back, so memory is a batch and one group.
    """
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = np.ones(len(frame), dtype=bool)
        for k in key:
            last &= (frame[k] == frame[k].iloc[-1]).to_numpy()
        start = len(frame) if not last.any() else int(np.argmax(last))
        if held and start == 0 and all(held[-1][k].iloc[-1] == frame[k].iloc[0] for k in key):
            held.append(frame)
            continue
        done = pd.concat([*held, frame.iloc[:start]], ignore_index=True)
        if len(done):
            yield done
        held = [frame.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case and nothing else; meant for single words, most of which are ASCII."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, low))


def small_side(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df, a written table, marked for broadcast if its values take at most `most` bytes; a larger one
    is left to a shuffle join. One job over df counts them."""
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c)) if kind.startswith(("array", "struct")) else F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(size).alias("n")).first()["n"] or 0) <= most else df
