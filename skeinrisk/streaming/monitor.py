"""Risk over a stream of returns: EWMA VaR, exceptions and CUSUM as state of constant size for each ticker.

Both recursions need only their last value, so a ticker's state doesn't grow. Rows within a micro-batch are taken in event
order; rows at or before a ticker's last event are late, since the recursions can't be unwound, and are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import Z99
from ..operators.detectors import CUSUM_H, CUSUM_K
from ..operators.risk import LAMBDA

OUTPUT = "ticker string, ts timestamp, r double, var double, exception boolean, cusum_pos double, cusum_neg double, alarm boolean"
STATE = "n long, v double, up double, down double, last timestamp"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, v, up, down, last = state.get if state.exists else (0, 0.0, 0.0, 0.0, None)
    rows, out = pd.concat(list(batches)).sort_values("ts"), []
    for ts, r in zip(rows["ts"], rows["r"], strict=True):
        if last is not None and ts <= pd.Timestamp(last):
            continue
        sigma = math.sqrt(v)
        if n:
            z = r / sigma if sigma > 0 else 0.0
            up, down = max(0.0, up + z - CUSUM_K), min(0.0, down + z + CUSUM_K)
            var = sigma * Z99 * 100
            out.append((key[0], ts, r, var, -r * 100 > var, up, down, up >= CUSUM_H or down <= -CUSUM_H))
            v = (1 - LAMBDA) * r * r + LAMBDA * v
        else:
            v = r * r
        n, last = n + 1, ts
    state.update((n, v, up, down, pd.Timestamp(last).to_pydatetime()))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def monitor(returns: DataFrame, watermark: str = "3 days") -> DataFrame:
    """A stream of (ticker, ts, r) -> a stream of one-step VaR, exceptions and CUSUM alarms; a ticker's first row is its seed."""
    rows = returns.select("ticker", F.col("ts").cast("timestamp").alias("ts"), "r").where("r IS NOT NULL").withWatermark("ts", watermark)
    return rows.groupBy("ticker").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def bars(ticks: DataFrame, width: str = "15 minutes", watermark: str = "30 minutes") -> DataFrame:
    """A stream of (ticker, ts, px) -> closed bars (ticker, ts, px): the last price of each window, late ticks dropped."""
    w = ticks.withWatermark("ts", watermark).groupBy("ticker", F.window("ts", width).alias("w")).agg(F.max_by("px", "ts").alias("px"))
    return w.select("ticker", F.col("w.start").alias("ts"), "px")
