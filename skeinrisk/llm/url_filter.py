"""URL filters: rules first, and gradient-boosted trees on lexical features for what no rule covers.

The trees are trained here, on the URLs that rules label. Everything is a DataFrame expression: features are columns, a level
of a tree is one aggregation of gradients by (node, feature, bin) whose few sums come to the driver to pick splits, and the
trained trees are conditional expressions that run where the rows are. Gradients are summed as whole numbers and bin edges are exact
quantiles, so the same URLs give the same trees in whatever order and partitions they come.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Rules (verdict by rule string: a host and the start of a path) that the contract fixes.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Boosting: trees, levels of each, bins of a feature, shrinkage, ridge on leaves.
TREES, DEPTH, BINS, RATE, RIDGE = 8, 3, 16, 0.3, 1.0
#: The bound on training: about so many labelled URLs, those with the smallest hashes.
TRAIN_ROWS = 200_000
#: Parts of one in which gradients are summed as whole numbers.
UNIT = 1 << 40
#: Suffixes with fewer labelled URLs count as unseen.
SUFFIX_LEAST = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path then up to ``? #`` or the
    end. Both empty for null and where ``://`` is missing."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that starts with the rule's; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        at = r.index("/") if "/" in r else len(r)
        own = (host == r[:at]) | F.endswith(host, F.lit("." + r[:at]))
        out = F.when(own & F.startswith(path, F.lit(r[at:])), F.lit(r)).otherwise(out)
    return out


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.length(url)
    lacking = lambda pattern: F.length(F.regexp_replace(url, pattern, ""))
    # entropy of characters: each distinct one by what its removal takes off the length
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")), F.lit(0.0),
        lambda acc, c: acc + F.when(c == "", 0.0).otherwise((n - F.length(F.replace(url, c, F.lit("")))) / n * F.ln(n / F.greatest(n - F.length(F.replace(url, c, F.lit(""))), F.lit(1)))),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    out = {
        "length": n, "host_length": F.length(host), "host_labels": F.size(F.split(host, r"\.")),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), "path_length": F.length(path),
        "digit_ratio": (n - lacking("[0-9]")) / F.greatest(n, F.lit(1)), "other_ratio": (n - lacking("[^0-9A-Za-z]")) / F.greatest(n, F.lit(1)),
        "entropy": F.when(n > 0, entropy), "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {"top_label": F.regexp_extract(host, r"([^.]*)\z", 1), "extension": F.regexp_extract(path, r"\.([0-9A-Za-z]{1,8})\z", 1)}


def pick(sums: dict, nodes: list[int], n_features: int) -> dict[int, tuple[int, int]]:
    """The best (feature, last bin of the left side) of each node by gain; nodes without a gain are missing.

    sums: (node, feature, bin) -> (gradients, curvatures).
    """
    worth = lambda g, h: g * g / (h + RIDGE)
    out = {}
    for node in nodes:
        best = 1e-9
        for f in range(n_features):
            bins = sorted((b, g, h) for (m, k, b), (g, h) in sums.items() if m == node and k == f)
            total_g, total_h = sum(x[1] for x in bins), sum(x[2] for x in bins)
            left_g = left_h = 0.0
            for b, g, h in bins[:-1]:
                left_g, left_h = left_g + g, left_h + h
                gain = worth(left_g, left_h) + worth(total_g - left_g, total_h - left_h) - worth(total_g, total_h)
                if gain > best:
                    best, out[node] = gain, (f, b)
    return out


def tree_value(tree: dict, node: int, left_of) -> Column:
    """A tree as a conditional expression; left_of(feature, bin): whether a row goes left."""
    if node in tree["leaves"]:
        return F.lit(tree["leaves"][node])
    f, b = tree["splits"][node]
    return F.when(left_of(f, b), tree_value(tree, 2 * node, left_of)).otherwise(tree_value(tree, 2 * node + 1, left_of))


def node_of(tree: dict, node: int, left_of) -> Column:
    if node not in tree["splits"]:
        return F.lit(node)
    f, b = tree["splits"][node]
    return F.when(left_of(f, b), node_of(tree, 2 * node, left_of)).otherwise(node_of(tree, 2 * node + 1, left_of))


def boost(binned: DataFrame, n_features: int) -> tuple[float, list[dict]]:
    """binned(bins array<int>, y double, n long) -> (start, trees) of a logistic model of y."""
    total, ones = binned.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    if not total:
        return 0.0, []
    start = math.log((ones + 1) / (total - ones + 1))
    trees: list[dict] = []
    left_of = lambda f, b: F.col("bins")[f] <= b
    for _ in range(TREES):
        tree: dict = {"splits": {}, "leaves": {}}
        score = reduce(lambda a, t: a + tree_value(t, 1, left_of), trees, F.lit(start))
        p = 1 / (1 + F.exp(-score))
        whole = lambda x: F.round(x * UNIT).cast("long") * F.col("n")
        rows = binned.select("bins", "n", whole(p - F.col("y")).alias("g"), whole(p * (1 - p)).alias("h"))
        nodes = [1]
        for level in range(DEPTH):
            at = rows.select(node_of(tree, 1, left_of).alias("node"), "g", "h", F.posexplode("bins").alias("f", "b"))
            # nodes x features x bins sums at most
            sums = {(r["node"], r["f"], r["b"]): (r["g"] / UNIT, r["h"] / UNIT) for r in at.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
            found = pick(sums, nodes, n_features)
            for node in nodes:
                own = [(f, b, g, h) for (m, f, b), (g, h) in sums.items() if m == node and f == 0]
                if node in found:
                    f, b = found[node]
                    tree["splits"][node] = found[node]
                    side = {0: [0.0, 0.0], 1: [0.0, 0.0]}
                    for (m, k, c), (g, h) in sums.items():
                        if m == node and k == f:
                            side[int(c > b)][0] += g
                            side[int(c > b)][1] += h
                    for s in (0, 1):
                        tree["leaves"][2 * node + s] = round(-RATE * side[s][0] / (side[s][1] + RIDGE), 9)
                    tree["leaves"].pop(node, None)
                elif node == 1:
                    tree["leaves"][1] = round(-RATE * sum(x[2] for x in own) / (sum(x[3] for x in own) + RIDGE), 9)
            nodes = [2 * m + s for m in found for s in (0, 1)]
            if not nodes:
                break
        trees.append(tree)
    return start, trees


def judge(pages: DataFrame, url_col: str = "url", rules: dict[str, str] = RULES, train_rows: int = TRAIN_ROWS, train_on: Column | None = None) -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule, verdict ('allow' or 'block') and score (of being blocked).

    A null or odd url has empty host and path, no rule, and the trees' verdict. Of rules that fit, the longest wins; two as long
    can't both fit one url unless they are equal. Urls of any length are taken whole; rows that repeat get equal results. Where no
    rule labels any url, all others are allowed; an empty table gives an empty result. ``train_on``: which rows the trees may learn
    from (all), so that others can be held out. Columns of ``pages`` with the names of
    results are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = parts(url)
    seen = pages.withColumn("_u_url", url).withColumn("host", host).withColumn("path", path)
    seen = seen.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    lexical = features(F.col("_u_url"), F.col("host"), F.col("path"))
    ends = suffixes(F.col("host"), F.col("path"))
    blocked = F.col("rule").isin([r for r, v in rules.items() if v == "block"])

    labelled = (pages if train_on is None else pages.where(train_on)).select(url.alias("_u_url"))
    labelled = labelled.select("_u_url", *[c.alias(n) for n, c in zip(("host", "path"), parts(F.col("_u_url")), strict=True)])
    labelled = labelled.withColumn("rule", rule(F.col("host"), F.col("path"), rules)).where("rule IS NOT NULL")
    labelled = labelled.select(blocked.cast("double").alias("y"), F.shiftrightunsigned(F.xxhash64("_u_url"), 1).alias("o"), *[v.alias(k) for k, v in (lexical | ends).items()])
    n = labelled.count()
    if n > train_rows:
        labelled = labelled.where(F.col("o") < int(train_rows / n * 2**63))
    labelled = written(labelled, "urls")
    prior = labelled.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]

    # suffix statistics: the labelled URLs' share of blocked ones, drawn towards the mean
    names = list(lexical)
    for name in ends:
        stats = labelled.groupBy(F.col(name).alias(f"_k_{name}")).agg(F.count("*").alias("_n"), F.sum("y").alias("_s")).where(F.col("_n") >= SUFFIX_LEAST)
        stats = stats.select(f"_k_{name}", ((F.col("_s") + 10 * prior) / (F.col("_n") + 10)).alias(f"_r_{name}"), F.ln(F.col("_n")).alias(f"_c_{name}"))
        stats = small(written(stats, "suffixes"))
        labelled = labelled.join(stats, F.col(name) == F.col(f"_k_{name}"), "left")
        seen = seen.join(stats, ends[name] == F.col(f"_k_{name}"), "left")
        names += [f"_r_{name}", f"_c_{name}"]
    value = {k: F.coalesce(F.col(k), F.lit(prior if k.startswith("_r_") else 0.0)) for k in names}
    # bin edges: quantiles of each feature
    quantiles = [k / BINS for k in range(1, BINS)]
    # a group of at most the training rows' different values for each feature
    listed = labelled.select(F.posexplode(F.array(*[value[k] for k in names])).alias("f", "x"))
    found = {r["f"]: r["q"] for r in listed.groupBy("f").agg(F.percentile("x", quantiles).alias("q")).collect()}
    edges = [sorted(set(found.get(k, []))) for k in range(len(names))]

    def bin_of(x: Column, own: list[float]) -> Column:
        return reduce(lambda a, e: a + (x > e).cast("int"), own, F.lit(0))

    binned = labelled.select(F.array(*[bin_of(value[k], e) for k, e in zip(names, edges, strict=True)]).alias("bins"), "y")
    binned = written(binned.groupBy("bins", "y").agg(F.count("*").alias("n")), "bins")
    start, trees = boost(binned, len(names))

    # the trees on the features themselves: a bin's upper edge is the threshold
    lex = {k: F.col(f"_f_{k}") for k in lexical}
    raw = [lex.get(k, value[k]) for k in names]
    seen = seen.withColumns({f"_f_{k}": v for k, v in lexical.items()})
    left_of = lambda f, b: raw[f] <= edges[f][b] if b < len(edges[f]) else F.lit(True)
    z = reduce(lambda a, t: a + tree_value(t, 1, left_of), trees, F.lit(start))
    score = (1 / (1 + F.exp(-z))) if trees else F.lit(0.0)
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).when(F.col("score") >= 0.5, "block").otherwise("allow")
    out = seen.withColumn("score", score).withColumn("verdict", verdict)
    return out.select(*pages.columns, "host", "path", "rule", "verdict", "score")
