"""Exact regression trees and gradient boosting whose splits are searched by Spark.

A level of a tree is one query: sums by node, feature and value, running sums over the sorted values, and the split with
the largest gain of each node. Only the splits, at most two to the power of the depth, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import logistic


@dataclass
class Tree:
    """Splits (feature, threshold) by node in heap order, root 1; values of all nodes."""

    splits: dict[int, tuple[str, float]]
    values: dict[int, float]

    def node(self) -> Column:
        """The leaf of a row: children of node i are 2 i (value at most the threshold) and 2 i + 1."""

        def of(i: int) -> Column:
            if i not in self.splits:
                return F.lit(i)
            f, t = self.splits[i]
            return F.when(F.col(f) <= t, of(2 * i)).otherwise(of(2 * i + 1))

        return of(1)

    def predict(self) -> Column:
        def of(i: int) -> Column:
            if i not in self.splits:
                return F.lit(float(self.values[i]))
            f, t = self.splits[i]
            return F.when(F.col(f) <= t, of(2 * i)).otherwise(of(2 * i + 1))

        return of(1)


def fit_tree(df: DataFrame, features: list[str], target: str, max_depth: int = 3, min_leaf: int = 1, min_split: int = 2) -> Tree:
    """The tree of least squared error, grown greedily: thresholds are midpoints between different values; of equal gains the first feature and smallest threshold win."""
    tree = Tree({}, {})
    data = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"))
    for depth in range(max_depth + 1):
        at = data.withColumn("_node", tree.node())
        level = [i for i in range(2**depth, 2 ** (depth + 1)) if depth == 0 or i // 2 in tree.splits]
        if not level:
            break
        stats = at.where(F.col("_node").isin(level)).groupBy("_node").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.min("_y").alias("a"), F.max("_y").alias("b")).collect()
        tree.values |= {r["_node"]: r["m"] for r in stats}
        if depth == 0 and not stats:
            tree.values[1] = 0.0
        open_ = [r["_node"] for r in stats if r["n"] >= max(min_split, 2 * min_leaf) and r["a"] < r["b"]]
        if depth == max_depth or not open_:
            continue
        long = at.where(F.col("_node").isin(open_)).select("_node", "_y", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).alias("v")) for k, f in enumerate(features)]))).where("v is not null")
        sums = long.groupBy("_node", "k", "v").agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("_node", "k").orderBy("v")
        whole = Window.partitionBy("_node", "k")
        up = sums.withColumns({"ls": F.sum("s").over(w), "ln": F.sum("n").over(w), "ts": F.sum("s").over(whole), "tn": F.sum("n").over(whole), "nv": F.lead("v").over(w)})
        up = up.where((F.col("nv").isNotNull()) & (F.col("ln") >= min_leaf) & (F.col("tn") - F.col("ln") >= min_leaf))
        gain = F.round(F.col("ls") ** 2 / F.col("ln") + (F.col("ts") - F.col("ls")) ** 2 / (F.col("tn") - F.col("ln")), 9)
        best = up.withColumn("g", gain).withColumn("t", (F.col("v") + F.col("nv")) / 2).groupBy("_node").agg(F.max_by(F.struct("k", "t"), F.struct(F.col("g"), -F.col("k"), -F.col("t"))).alias("b"))
        for r in best.collect():
            tree.splits[r["_node"]] = (features[r["b"]["k"]], r["b"]["t"])
    return tree


@dataclass
class Boosted:
    loss: str
    start: float
    rate: float
    trees: list[Tree]

    def score(self, stages: int | None = None) -> Column:
        return sum((self.rate * t.predict() for t in self.trees[:stages]), F.lit(self.start))

    def predict(self) -> Column:
        return self.score() if self.loss == "squared_error" else (self.score() > 0).cast("int")

    def probability(self) -> Column:
        return logistic(self.score())


def fit_boosted(df: DataFrame, features: list[str], target: str, loss: str = "squared_error", trees: int = 20, rate: float = 0.1, max_depth: int = 3, min_leaf: int = 1, newton: bool = True) -> Boosted:
    """Gradient boosting; for log_loss, leaves are sums of gradients over sums of curvatures unless newton is off. The targets of log_loss are 0 and 1."""
    if loss not in ("squared_error", "log_loss"):
        raise ValueError("loss is squared_error or log_loss")
    y = F.col(target).cast("double")
    data = df.select(*features, y.alias("_target"))
    one = data.agg(F.avg("_target").alias("m"), F.count_if(~F.col("_target").isin(0.0, 1.0)).alias("odd")).first()
    if loss == "log_loss" and one["odd"]:
        raise ValueError("log_loss needs targets of 0 and 1")
    import math

    mean = one["m"] or 0.0
    p = min(max(mean, 1e-12), 1 - 1e-12)
    model = Boosted(loss, mean if loss == "squared_error" else math.log(p / (1 - p)), rate, [])
    for _ in range(trees):
        score = model.score()
        g = F.col("_target") - (score if loss == "squared_error" else logistic(score))
        now = data.withColumn("_g", g)
        tree = fit_tree(now, features, "_g", max_depth, min_leaf)
        if loss == "log_loss" and newton:
            q = logistic(score)
            sums = now.withColumn("_leaf", tree.node()).withColumn("_h", q * (1 - q)).groupBy("_leaf").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
            tree.values |= {r["_leaf"]: r["g"] / r["h"] if r["h"] > 1e-12 else 0.0 for r in sums}
        model.trees.append(tree)
    return model


def log_losses(df: DataFrame, model: Boosted, target: str) -> DataFrame:
    """(stage, loss): the mean log loss after each tree."""
    y = F.col(target).cast("double")
    p = lambda k: F.greatest(F.least(logistic(model.score(k)), F.lit(1 - 1e-12)), F.lit(1e-12))
    one = df.agg(*[F.avg(-(y * F.log(p(k)) + (1 - y) * F.log(1 - p(k)))).alias(f"s{k}") for k in range(1, len(model.trees) + 1)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"s{k}").alias("loss")) for k in range(1, len(model.trees) + 1)])))


def by_correlation(df: DataFrame, features: list[str], target: str, k: int) -> list[str]:
    """The k features that correlate most with the target, by size; one pass over the rows."""
    r = df.agg(*[F.coalesce(F.abs(F.corr(f, target)), F.lit(0.0)).alias(f) for f in features]).first()
    return sorted(features, key=lambda f: (-r[f], features.index(f)))[:k]


def folds(df: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    """df with `fold`, 0 to k - 1, of sizes that differ by one at most."""
    from .sampling import ranked

    return ranked(df, keys, seed).withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank", "_all")


def cross_validated(df: DataFrame, features: list[str], target: str, keys: list[str], k_features: int, k: int = 5, inside: bool = True, seed: int = 0, **model) -> list[float]:
    """Accuracies of the folds, with features selected inside each fold's training rows, or once on all rows (which leaks)."""
    data = folds(df, keys, k, seed).persist()  # each tree passes over it
    try:
        once = None if inside else by_correlation(df, features, target, k_features)
        out = []
        for i in range(k):
            train, test = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
            cols = by_correlation(train, features, target, k_features) if inside else once
            m = fit_boosted(train, cols, target, "log_loss", **{"trees": 5, "max_depth": 2, **model})
            out.append(test.agg(F.avg((m.predict() == F.col(target)).cast("double")).alias("a")).first()["a"])
        return out
    finally:
        data.unpersist()
