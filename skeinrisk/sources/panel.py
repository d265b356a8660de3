"""Price panels: assembly, forward fill and returns; and the panel that the generated tables stand in for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAMPING = 0.02
MARKET, THEME, BOND = "NO", "RF", "AF"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_date(key: str = "ticker") -> Window:
    return Window.partitionBy(key).orderBy("dt")


def damped(level: Column) -> Column:
    return 100 * F.pow(level / 1000, F.lit(DAMPING))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, dt, px): six assets by return flag and line status, on shipping dates."""
    level = F.sum("l_extendedprice") / F.sum("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").cast("date").alias("dt"), "l_extendedprice", "l_quantity")
    return lines.groupBy("ticker", "dt").agg(damped(level).alias("px"))


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, dt, px): five assets by order priority, on order dates."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt"), "o_totalprice")
    return orders.groupBy("ticker", "dt").agg(damped(F.avg("o_totalprice")).alias("px"))


def fill(panel: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Every ticker on every date of the union calendar, carried forward; dates before a ticker's first price stay null.

    ``tickers``: the requested ones (a column ``ticker``); those without prices come out all null. The calendar, which has a row a
    day whatever the number of tickers, is sent to all tasks; the product has no more rows than the filled panel itself.
    """
    wanted = (panel if tickers is None else tickers).select("ticker").distinct()
    grid = wanted.crossJoin(F.broadcast(panel.select("dt").distinct()))
    carried = F.last("px", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(panel, ["ticker", "dt"], "left").select("ticker", "dt", carried.alias("px"))


def log_returns(panel: DataFrame) -> DataFrame:
    """(ticker, dt, r): log of price over the ticker's price before; rows without one are left out."""
    before = F.lag("px").over(by_date())
    return panel.withColumn("r", F.ln(F.try_divide("px", before))).where("r IS NOT NULL").select("ticker", "dt", "r")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_returns(fill(prices(spark, sf_dir)))


def weekdays(df: DataFrame) -> DataFrame:
    return df.where(F.weekday("dt") < 5)


def tail(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """The last n rows of each key by date."""
    newest = Window.partitionBy(key).orderBy(F.desc("dt"))
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, px): hourly mean of event values by event type."""
    events = table(spark, sf_dir, "events").where("value > 0")
    return events.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("px"))


def coarser(bars_: DataFrame, width: str) -> DataFrame:
    """The last price of each bar of ``width`` (say '4 hours')."""
    out = bars_.groupBy("ticker", F.window("ts", width)["start"].alias("ts2")).agg(F.max_by("px", "ts").alias("px"))
    return out.withColumnRenamed("ts2", "ts")


def volatility_index(market: DataFrame) -> DataFrame:
    """(dt, vix): 21-row standard deviation of the market's returns, annualised, in percent; full windows only."""
    w = Window.partitionBy("ticker").orderBy("dt").rowsBetween(-20, 0)
    v = market.withColumn("vix", F.when(F.count("r").over(w) == 21, F.stddev_samp("r").over(w) * F.sqrt(F.lit(252.0)) * 100))
    return v.where("vix IS NOT NULL").select("dt", "vix")


def smoothed_volatility(vix: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """(dt, vix): the mean of the last ``window`` values, where there are ``least`` of them: on a par with correlations over as many
    rows. One dated series is one partition."""
    w = Window.partitionBy(F.lit(0)).orderBy("dt").rowsBetween(1 - window, 0)
    return vix.select("dt", F.when(F.count("vix").over(w) >= least, F.avg("vix").over(w)).alias("vix")).where("vix IS NOT NULL")


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Dealt out by ``keys`` over a fixed number of partitions, for grouped functions that work long on few rows.

    Left to itself, adaptive execution sizes partitions by bytes and would put all such groups into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


PORTFOLIOS = {
    "A": {"AF": 0.30, "NF": 0.20, "NO": 0.15, "RF": 0.15, "AO": 0.10, "RO": 0.10},
    "B": {t: 1 / 6 for t in ("AF", "NF", "NO", "RF", "AO", "RO")},
}
BENCHMARK = {MARKET: 0.6, BOND: 0.4}


def weights(spark: SparkSession, books: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(portfolio, ticker, w, ord): weights of the books, in the order given."""
    rows = [(p, t, float(w), k) for p, own in (PORTFOLIOS if books is None else books).items() for k, (t, w) in enumerate(own.items())]
    return spark.createDataFrame(rows, "portfolio string, ticker string, w double, ord int")


#: DuckDB definitions of the tables above, for the queries' SQL.
SQL = {
    "prices": "SELECT concat(l_returnflag, l_linestatus) AS ticker, CAST(l_shipdate AS DATE) AS dt, 100 * pow((sum(l_extendedprice) / sum(l_quantity)) / 1000, 0.02) AS px FROM lineitem GROUP BY 1, 2",
    "filled": "SELECT t.ticker, d.dt, last_value(p.px IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.dt) AS px FROM (SELECT DISTINCT dt FROM prices) d CROSS JOIN (SELECT DISTINCT ticker FROM prices) t LEFT JOIN prices p ON p.dt = d.dt AND p.ticker = t.ticker",
    "returns": "SELECT * FROM (SELECT ticker, dt, ln(px / lag(px) OVER (PARTITION BY ticker ORDER BY dt)) AS r FROM filled) WHERE r IS NOT NULL",
    "last1000": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS fwd FROM returns) WHERE back <= 1000",
    "order_px": "SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS dt, 100 * pow(avg(o_totalprice) / 1000, 0.02) AS px FROM orders GROUP BY 1, 2",
    "books": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{t}', {w!r}::DOUBLE, {k})" for p, own in PORTFOLIOS.items() for k, (t, w) in enumerate(own.items())) + ") b(portfolio, ticker, w, ord)",
    "market": f"SELECT dt, r FROM returns WHERE ticker = '{MARKET}'",
    "vix": "SELECT * FROM (SELECT dt, CASE WHEN count(r) OVER w = 21 THEN stddev_samp(r) OVER w * sqrt(252.0) * 100 END AS vix FROM market WINDOW w AS (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE vix IS NOT NULL",
    "bars": "SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, avg(value) AS px FROM events WHERE value > 0 GROUP BY 1, 2",
    "port": "SELECT b.portfolio, r.dt, sum(r.r * b.w) / sum(b.w) AS r FROM returns r JOIN books b USING (ticker) GROUP BY 1, 2 HAVING count(*) = 6",
    "bench": f"SELECT r.dt, sum(r.r * CASE WHEN ticker = '{MARKET}' THEN 0.6 ELSE 0.4 END) AS r FROM returns r WHERE ticker IN ('{MARKET}', '{BOND}') GROUP BY 1 HAVING count(*) = 2",
}
#: Which of them each one needs.
NEEDS = {"filled": ["prices"], "returns": ["filled"], "last1000": ["returns"], "market": ["returns"], "vix": ["market"], "port": ["returns", "books"], "bench": ["returns"]}


def sql(body: str, *names: str, **more: str) -> str:
    """``body`` under a WITH that defines the named tables, what they need, and ``more`` in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
