"""Paths in the folder that driver and executors share, for what a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, removed when the driver ends; under a local folder only where that is unset and
    Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='skeinrisk-')}"
    path = f"{base.rstrip('/')}/skeinrisk-{uuid.uuid4().hex}-{tag}"
    _made.append((spark, path))
    return path


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small binary file at ``path``, on any store that Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    out.write(bytearray(data))
    out.close()


@atexit.register
def _discard() -> None:
    for spark, path in _made:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
