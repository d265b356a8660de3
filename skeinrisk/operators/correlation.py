"""Correlations over windows, pairs and days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation


def complete_dates(returns: DataFrame) -> DataFrame:
    """Rows of the dates that every ticker has."""
    all_ = returns.agg(F.count_distinct("ticker").alias("_all"))  # one row
    return returns.withColumn("_n", F.count("*").over(Window.partitionBy("dt"))).crossJoin(F.broadcast(all_)).where(F.col("_n") == F.col("_all")).drop("_n", "_all")


def average_pairwise(returns: DataFrame, window: int = 60, every: int = 5) -> DataFrame:
    """(dt, avg_corr): mean correlation of all ticker pairs over the ``window`` rows before dt, every ``every`` rows.

    Pairs aren't made: over a window, the sum of n standardised series has the variance n + n (n - 1) times their mean
    correlation, and that variance is the sum over dates of the squared sum of z. Each date counts in ``window`` windows, so the
    work is linear in tickers; a series that doesn't move in a window has no correlation and leaves its window's pairs.
    """
    days = complete_dates(returns)
    own = Window.partitionBy("ticker").orderBy("dt")
    before = own.rowsBetween(-window, -1)
    rows = days.withColumn("i", F.row_number().over(own) - 1).withColumn("past", F.collect_list("r").over(before))
    kept = rows.where((F.col("i") >= window) & ((F.col("i") - window) % every == 0))
    mean = F.aggregate("past", F.lit(0.0), lambda a, x: a + x) / window
    kept = kept.withColumn("past", F.transform("past", lambda x: x - mean))
    norm = F.sqrt(F.aggregate("past", F.lit(0.0), lambda a, x: a + x * x))
    kept = kept.withColumn("norm", norm).where("norm > 0").select("dt", F.posexplode("past").alias("k", "x"), "norm")
    summed = kept.groupBy("dt", "k").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    whole = summed.groupBy("dt").agg(F.sum(F.col("s") * F.col("s")).alias("v"), F.max("n").alias("n")).where("n > 1")
    return whole.select("dt", ((F.col("v") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("avg_corr"))


def multi_window(returns: DataFrame, a: str, b: str, windows: tuple[int, ...] = (20, 60, 252), every: int = 5) -> DataFrame:
    """(dt, corr_<n> for each window): rolling correlations of two tickers on one grid; only full windows count."""
    x, y = (returns.where(F.col("ticker") == t).select("dt", F.col("r").alias(c)) for t, c in ((a, "x"), (b, "y")))
    rows = x.join(y, "dt").withColumn("pair", F.lit(f"{a}/{b}"))
    own = Window.partitionBy("pair").orderBy("dt")
    rows = rows.withColumn("i", F.row_number().over(own) - 1)
    for n in windows:
        frame = own.rowsBetween(1 - n, 0)
        rows = rows.withColumn(f"corr_{n}", F.when(F.col("i") >= n - 1, correlation(F.col("x"), F.col("y"), frame)))
    first = min(windows) - 1
    return rows.where((F.col("i") >= first) & ((F.col("i") - first) % every == 0)).select("dt", *[f"corr_{n}" for n in windows])


def intensification(windows: DataFrame, short: str = "corr_20", long: str = "corr_252", least: float = 0.15) -> DataFrame:
    """The latest point with both windows: their gap, and whether it is beyond ``least``."""
    last = windows.where(F.col(short).isNotNull() & F.col(long).isNotNull()).agg(F.max("dt").alias("dt"), F.max_by(short, "dt").alias("short_corr"), F.max_by(long, "dt").alias("long_corr"))
    gap = F.col("short_corr") - F.col("long_corr")
    return last.select("dt", "short_corr", "long_corr", gap.alias("gap"), F.when(gap >= least, "rising").when(gap <= -least, "falling").otherwise("stable").alias("flag"))


def paired_bars(bars: DataFrame, a: str, b: str) -> DataFrame:
    """(dt, ts, x, y): two tickers' returns between the bars that both have."""
    one = lambda t, c: bars.where(F.col("ticker") == t).select("ts", F.col("px").alias(c))
    both = one(a, "a").join(one(b, "b"), "ts").withColumn("pair", F.lit(f"{a}/{b}"))
    order = Window.partitionBy("pair").orderBy("ts")
    r = lambda c: F.ln(F.try_divide(c, F.lag(c).over(order)))
    return both.select(F.to_date("ts").alias("dt"), "ts", r("a").alias("x"), r("b").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def daily_correlation(pairs: DataFrame, least: int = 20) -> DataFrame:
    """(dt, n, corr): Pearson's by day, for days of at least ``least`` bars."""
    return pairs.groupBy("dt").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("corr")).where(F.col("n") >= least)


def streak(daily: DataFrame, value: str = "corr") -> DataFrame:
    """The latest run of days of one sign: its length and sign, the share of such days, and the odds of such a run by chance;
    no row without days."""
    days = daily.where(F.col(value).isNotNull()).select("dt", F.when(F.col(value) > 0, 1).otherwise(-1).alias("sign"))
    end = days.agg(F.max_by("sign", "dt").alias("last"), F.max("dt").alias("dt"), F.avg((F.col("sign") > 0).cast("double")).alias("up"), F.count("*").alias("n_days"), F.count_if(F.col("sign") > 0).alias("n_positive")).where("n_days > 0")
    broken = days.crossJoin(F.broadcast(end.select("last"))).where("sign <> last").agg(F.max("dt").alias("since"))  # one row each
    length = days.crossJoin(F.broadcast(broken)).where("since IS NULL OR dt > since").agg(F.count("*").alias("streak"))
    out = end.crossJoin(F.broadcast(length))
    rate = F.when(F.col("last") > 0, F.col("up")).otherwise(1 - F.col("up"))
    return out.select("dt", F.col("last").alias("sign"), "streak", "n_days", "n_positive", rate.alias("rate"), F.pow(rate, F.col("streak")).alias("probability"), F.try_divide(F.lit(1.0), F.pow(rate, F.col("streak"))).alias("odds"))
