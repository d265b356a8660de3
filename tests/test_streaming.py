from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from skeinrisk.streaming import monitor

START = dt.datetime(2024, 1, 1)


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_monitor_equals_the_recursion_over_batches(spark, tmp_path):
    r = np.random.default_rng(1).normal(size=60) * 0.01
    r[40:] -= 0.03
    rows = [("A", START + dt.timedelta(days=k), float(x)) for k, x in enumerate(r)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "ticker string, ts timestamp, r double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("ticker string, ts timestamp, r double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    out = sorted(run(spark, monitor.monitor(source, "100 days"), "monitored"), key=lambda x: x["ts"])
    v = r[0] ** 2
    assert len(out) == 59
    for row, x in zip(out, r[1:], strict=True):
        assert row["var"] == pytest.approx(v**0.5 * 2.3263478740408408 * 100)
        assert row["exception"] == (-x * 100 > row["var"])
        v = 0.06 * x * x + 0.94 * v
    assert any(x["alarm"] for x in out[40:]) and not out[5]["alarm"]


def test_bars_close_with_the_watermark(spark, tmp_path):
    ticks = [("A", START + dt.timedelta(minutes=m), float(m)) for m in (1, 14, 16, 29, 120)]
    spark.createDataFrame(ticks, "ticker string, ts timestamp, px double").write.parquet(f"{tmp_path}/ticks")
    source = spark.readStream.schema("ticker string, ts timestamp, px double").parquet(f"file://{tmp_path}/ticks")
    assert sorted(x["px"] for x in run(spark, monitor.bars(source), "bars")) == [14.0, 29.0]
