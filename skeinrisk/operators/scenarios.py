"""Stress tests: historical windows, and shocks that resolve along a taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources import scratch


def window_returns(prices: DataFrame, scenarios: DataFrame) -> DataFrame:
    """prices(ticker, dt, px), scenarios(id, start, end) -> (id, ticker, ret): last over first price in each window.

    A range join against the scenario list, which is a short dimension; series of fewer than two prices are left out.
    """
    inside = prices.where("px IS NOT NULL").join(F.broadcast(scenarios), (F.col("dt") >= F.col("start")) & (F.col("dt") <= F.col("end")))
    return inside.groupBy("id", "ticker").agg(F.min_by("px", "dt").alias("a"), F.max_by("px", "dt").alias("z"), F.count("*").alias("n")).where("n >= 2").select("id", "ticker", (F.col("z") / F.col("a") - 1).alias("ret"))


def with_proxies(rets: DataFrame, wanted: DataFrame, proxies: DataFrame) -> DataFrame:
    """(id, ticker, ret, proxied): a wanted ticker's own return, else its proxy's; proxied names the proxy where it was used."""
    ids = rets.select("id").distinct()
    own = wanted.select("ticker").distinct().crossJoin(F.broadcast(ids)).join(proxies, "ticker", "left")  # scenarios are few
    a = rets.select("id", "ticker", F.col("ret").alias("own"))
    b = rets.select("id", F.col("ticker").alias("proxy"), F.col("ret").alias("other"))
    out = own.join(a, ["id", "ticker"], "left").join(b, ["id", "proxy"], "left").where("own IS NOT NULL OR other IS NOT NULL")
    return out.select("id", "ticker", F.coalesce("own", "other").alias("ret"), F.when(F.col("own").isNull(), F.col("proxy")).alias("proxied"))


def contributions(moves: DataFrame, weights: DataFrame) -> DataFrame:
    """moves(id, ticker, ret), weights(portfolio, ticker, w) -> (portfolio, id, ticker, ret, w, contribution): weights to 1 over what moved."""
    both = weights.select("portfolio", "ticker", "w").join(moves, "ticker")
    share = ratio(F.col("w"), F.sum("w").over(Window.partitionBy("portfolio", "id")))
    return both.withColumn("contribution", share * F.col("ret") * 100)


def totals(parts: DataFrame) -> DataFrame:
    """(portfolio, id, portfolio_pnl, coverage_pct, n_assets)."""
    return parts.groupBy("portfolio", "id").agg(F.sum("contribution").alias("portfolio_pnl"), (F.sum("w") * 100).alias("coverage_pct"), F.count("*").alias("n_assets"))


def closure(tree: DataFrame) -> DataFrame:
    """tree(class, parent), roots their own parents -> (class, ancestor, depth), a class its own ancestor at 0.

    Reach doubles from round to round: ancestors up to 2, 4, 8, ... steps away are those of the ancestors half as far, so a taxonomy of
    depth n takes log n joins. Each round is written before the next. Classes that are on a circle, or lead to one, reach no root, and
    ValueError names them.
    """
    spark = tree.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch.new_path(spark, "closure")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    up = tree.where("class <> parent")
    reach = written(tree.select("class", F.col("class").alias("ancestor"), F.lit(0).alias("depth")).unionByName(up.select("class", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))).distinct())
    far, n = 1, tree.count()
    while True:
        ends = reach.where(F.col("depth") == far)
        if ends.isEmpty():
            return reach
        if far > n:  # a longer way than there are classes
            odd = [r["class"] for r in ends.select("class").distinct().orderBy("class").limit(20).collect()]
            raise ValueError(f"the taxonomy has a circle above {', '.join(map(str, odd))}")
        on = reach.where("depth > 0").select(F.col("class").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        reach = written(reach.unionByName(ends.join(on, "ancestor").select("class", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))))
        far *= 2


def resolve(securities: DataFrame, tree: DataFrame, shocks: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, ticker, shock, path): override, else sector, else the nearest shocked ancestor of the class.

    securities(ticker, class, sector, blend map<class, weight>): a blend averages the shocks of the sleeves that resolve.
    shocks(id, category, shock), overrides(id, ticker, shock). What resolves nowhere has no row.
    """
    reach = closure(tree).join(shocks, F.col("ancestor") == F.col("category"))
    by_class = reach.groupBy("id", "class").agg(F.min_by("shock", "depth").alias("class_shock"))
    ids = shocks.select("id").union(overrides.select("id")).distinct()
    base = securities.crossJoin(F.broadcast(ids))  # scenarios are few
    out = base.join(overrides.withColumnRenamed("shock", "own"), ["id", "ticker"], "left")
    sectors = shocks.select("id", F.col("category").alias("sector"), F.col("shock").alias("sector_shock"))
    out = out.join(sectors, ["id", "sector"], "left").join(by_class, ["id", "class"], "left")
    sleeves = securities.select("ticker", F.explode("blend").alias("class", "sw")).join(by_class, "class")
    blends = sleeves.groupBy("id", "ticker").agg(ratio(F.sum(F.col("sw") * F.col("class_shock")), F.sum("sw")).alias("blend_shock"))
    out = out.join(blends, ["id", "ticker"], "left")
    plain = F.when(F.col("blend").isNull(), F.coalesce("sector_shock", "class_shock"))
    path = F.when(F.col("own").isNotNull(), "override").when(F.col("blend").isNotNull(), "blend").when(F.col("sector_shock").isNotNull(), "sector").otherwise("class")
    out = out.withColumn("shock", F.coalesce("own", F.when(F.col("blend").isNotNull(), F.col("blend_shock")), plain))
    return out.where("shock IS NOT NULL").select("id", "ticker", "shock", path.alias("path"))


def groups(securities: DataFrame, tree: DataFrame, shocks: DataFrame, class_groups: DataFrame, sector_group: dict[str, str]) -> DataFrame:
    """(id, ticker, grp): the slider group along the path that the shock took; a blend follows its heaviest covered sleeve."""
    reach = closure(tree)
    named = reach.join(class_groups, F.col("ancestor") == F.col("gclass")).groupBy("class").agg(F.min_by("grp", "depth").alias("grp"))
    covered = reach.join(shocks, F.col("ancestor") == F.col("category")).select("id", "class").distinct()
    sleeves = securities.select("ticker", F.explode("blend").alias("class", "sw")).join(covered, "class")
    heaviest = sleeves.groupBy("id", "ticker").agg(F.max_by("class", F.struct("sw", "class")).alias("class"))
    plain = securities.where("blend IS NULL").select("ticker", "class", "sector").crossJoin(F.broadcast(shocks.select("id").distinct()))
    hit = shocks.select("id", F.col("category").alias("sector"), F.lit(True).alias("hit"))
    plain = plain.join(hit, ["id", "sector"], "left")
    own = F.lit(None).cast("string")
    for sector, grp in sector_group.items():
        own = F.when(F.col("hit") & (F.col("sector") == sector), F.lit(grp)).otherwise(own)
    rows = plain.select("id", "ticker", "class", own.alias("own")).unionByName(heaviest.select("id", "ticker", "class", F.lit(None).cast("string").alias("own")))
    return rows.join(named, "class", "left").select("id", "ticker", F.coalesce("own", "grp").alias("grp")).where("grp IS NOT NULL")


def coverage(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio, id, coverage): covered weight over all weight."""
    all_w = weights.groupBy("portfolio").agg(F.sum("w").alias("all_w"))
    return parts.groupBy("portfolio", "id").agg(F.sum("w").alias("w")).join(all_w, "portfolio").select("portfolio", "id", ratio(F.col("w"), F.col("all_w")).alias("coverage"))


def unmapped(weights: DataFrame, securities: DataFrame) -> DataFrame:
    """Holdings that the taxonomy doesn't know, with the books that hold them."""
    missing = weights.join(securities, "ticker", "left_anti")
    return missing.groupBy("ticker").agg(F.concat_ws(",", F.array_sort(F.collect_set("portfolio"))).alias("portfolios"))


def what_if(parts: DataFrame, grouped: DataFrame, multipliers: DataFrame) -> DataFrame:
    """(portfolio, id, pnl, pnl_scaled): every slider group's contributions by its multiplier, summed again."""
    rows = parts.join(grouped, ["id", "ticker"], "left").join(multipliers, "grp", "left")
    return rows.groupBy("portfolio", "id").agg(F.sum("contribution").alias("pnl"), F.sum(F.col("contribution") * F.coalesce("multiplier", F.lit(1.0))).alias("pnl_scaled"))


def anchors(parts: DataFrame, grouped: DataFrame) -> DataFrame:
    """The largest shock in size of each slider group: what a slider shows."""
    rows = parts.join(grouped, ["id", "ticker"])
    return rows.groupBy("portfolio", "id", "grp").agg(F.max_by("ret", F.struct(F.abs("ret"), "ticker")).alias("anchor"))


def compare(totals_: DataFrame) -> DataFrame:
    """Every scenario's result of one portfolio against each other one."""
    a = totals_.select("id", F.col("portfolio").alias("a"), F.col("portfolio_pnl").alias("pnl_a"))
    b = totals_.select("id", F.col("portfolio").alias("b"), F.col("portfolio_pnl").alias("pnl_b"))
    return a.join(b, "id").where("a <> b").withColumn("delta_pp", F.col("pnl_a") - F.col("pnl_b"))
