"""Sinks: sections as Parquet, one nested JSON document, model caches, and holdings as JSON."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sections(sections: dict[str, DataFrame], folder: str) -> None:
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def document(sections: dict[str, DataFrame], as_of: str) -> DataFrame:
    """One row, ``value``: the sections as a JSON document, each an array of rows. For display-sized sections."""
    out = None
    for name, df in sections.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(F.lit(as_of).alias("as_of"), *sections)).alias("value"))


def write_document(sections: dict[str, DataFrame], as_of: str, path: str) -> None:
    document(sections, as_of).coalesce(1).write.mode("overwrite").text(path)


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions under ``path``, oldest first, on any store that Spark reads."""
    target, fs = _folder(spark, path)
    names = sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []
    return [f"{path}/{n}" for n in names if n.startswith("version-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}", "_SUCCESS"))]


def there(spark: SparkSession, path: str) -> bool:
    """Whether something was published to ``path``."""
    return bool(versions(spark, path))


def publish(df: DataFrame, path: str) -> None:
    """``df`` as the newest version under ``path``. A version counts once it is whole, so a write that fails leaves the one before;
    that one stays, too, for those who still read it, and older ones go."""
    spark = df.sparkSession
    before = versions(spark, path)
    df.write.parquet(f"{path}/version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
    for old in before[:-1]:
        target, fs = _folder(spark, old)
        fs.delete(target, True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version under ``path``."""
    return spark.read.parquet(versions(spark, path)[-1])


def cached(spark: SparkSession, compute, path: str, refresh: bool = False) -> DataFrame:
    """A model's results from ``path``; computed and published where they are missing or ``refresh`` is set."""
    if refresh or not there(spark, path):
        publish(compute(), path)
    return published(spark, path)


class DatedStore:
    """Results by key and date that only grow: each run adds a part of the dates that no part before it has.

    A part counts once it is whole, so a run that fails leaves what was there, and the next one makes up for it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("portfolio", "model")):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def read(self) -> DataFrame:
        parts = versions(self.spark, self.path)
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def last(self) -> DataFrame:
        """(keys, last): the newest date of each key."""
        return self.read().groupBy(*self.keys).agg(F.max("dt").alias("last"))

    def update(self, compute) -> DataFrame:
        """Adds ``compute(last)``, rows of the schema after each key's last date, and returns everything."""
        last = self.last()
        new = compute(last).join(last, list(self.keys), "left").where("last IS NULL OR dt > last").drop("last")
        names = [x.strip().split()[0] for x in self.schema.split(",")]
        new.select(*names).write.parquet(f"{self.path}/version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        return self.read()


def write_holdings(records: DataFrame, path: str) -> None:
    rows = records.groupBy("fund").agg(F.sort_array(F.collect_list(F.struct("rank", "security", "ticker", "symbol", "country", "weight"))).alias("holdings"))
    rows.write.mode("overwrite").json(path)
