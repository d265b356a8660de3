"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters that are neither space nor an ASCII control space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side whose size grows with the data may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 300_000

#: Spark's setting by which a query's shuffle files go when the query ends; else they stay until the driver collects garbage.
BRIEF_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a local one of our own if Spark runs in
    this process only, else an error: executors couldn't see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="skeinrisk-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/skeinrisk-{uuid.uuid4().hex}-{tag}"
    _written.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``new_path`` gave."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


class Written:
    """A DataFrame cut from its lineage: written as Parquet to the shared folder and read again."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, tag)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        discard(self.spark, self.path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written to the shared folder and read again; the files stay until the driver ends."""
    return Written(df, tag).df


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each query that is run are deleted when it ends. A frame that is run again shuffles again."""
    before = spark.conf.get(BRIEF_SHUFFLES, None)
    spark.conf.set(BRIEF_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BRIEF_SHUFFLES)
        else:
            spark.conf.set(BRIEF_SHUFFLES, before)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than BROADCAST_ROWS rows (it is counted), else as it is.

    ``df`` should be written already, so that the count is cheap.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z so that no other character turns into an ASCII letter or digit.

    ``lower`` maps one character outside ASCII to a plain ASCII letter, the Kelvin sign; that is hidden from it. Other
    characters outside ASCII stay outside ASCII, so words of ASCII compare as they should.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("Ꝁ")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
