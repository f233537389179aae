"""Session settings shared by the queries, the tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def local_session(cpus: int = 8, app: str = "melder") -> SparkSession:
    """A session for one machine; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan in as many partitions as the cluster has cores, if its files give fewer splits.

    A file is split between its row groups at best, so costly expressions over a small table would
    keep one core busy. Rows are dealt in turn, whatever their keys; a scan of enough splits, as
    any large table is, doesn't move. The argument must be a plain scan: its splits are counted.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def joined(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, by a shuffle.

    Spark takes a table's file size for its size, and columns that repeat themselves (keys in order,
    sources' names) take few bytes in Parquet: left to itself it would send millions of rows through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def unfolded(df: DataFrame, keep: list[str | Column], column: str, *names: str) -> DataFrame:
    """keep and the entries of an array of structs as names[-1], with their places as names[0] if two are given.

    An inner explode makes Spark infer a filter on the array's size and push it below whatever makes the
    array, which is then worked out once more for each time that it is mentioned there. The outer form has
    no such filter; the empty entry that it gives for an empty array is dropped behind it.
    """
    every = (F.posexplode_outer if len(names) == 2 else F.explode_outer)(column).alias(*names)
    return df.select(*keep, every).where(F.col(names[-1]).isNotNull())


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the folder that spark.checkpoint.dir names, read again: a plan's stages
    are computed once, survive lost executors, and show the planner their true sizes.

    Without that setting a folder of our own is taken in local mode; on a cluster, whose machines
    don't share one, it is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        app = spark.sparkContext.applicationId
        folder = _own_dir.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="melder-")
        _own_dir[app] = folder
    path = f"{folder.rstrip('/')}/stage-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
