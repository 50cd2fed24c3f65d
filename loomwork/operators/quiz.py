"""Comparison quizzes: pairs of named values by their relative gap, drawn evenly over tiers, and scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tiers by least relative gap: fixed values.
TIERS = [("easy", 0.40), ("medium", 0.12), ("hard", 0.02), ("brutal", 0.0)]


def tier_of(gap: Column) -> Column:
    out = None
    for name, least in TIERS:
        out = F.when(gap >= least, name) if out is None else out.when(gap >= least, name)
    return out.otherwise(TIERS[-1][0])


def pool(rows: DataFrame, name: str, value: str, max_rows: int = 10_000) -> DataFrame:
    """(a, b, gap, tier, answer): all pairs of rows with a name and a positive value, but those of equal values; a < b. All pairs are the feature, so more than max_rows rows are an error."""
    r = rows.where((F.length(name) > 0) & (F.col(value) > 0)).select(F.col(name).alias("n"), F.col(value).cast("double").alias("v"))
    if r.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows to pair")
    a, b = r.select(F.col("n").alias("a"), F.col("v").alias("va")), r.select(F.col("n").alias("b"), F.col("v").alias("vb"))
    hi = F.greatest("va", "vb")
    gap = (hi - F.least("va", "vb")) / hi
    return a.join(F.broadcast(b), (F.col("a") < F.col("b")) & (F.col("va") != F.col("vb"))).select("a", "b", gap.alias("gap"), tier_of(gap).alias("tier"), F.when(F.col("va") > F.col("vb"), "a").otherwise("b").alias("answer"))


def draw(pairs: DataFrame, n: int = 10, seed: int = 1) -> DataFrame:
    """n questions, one of each tier in turn while it lasts, in seeded order; sides are swapped by a seeded coin. Fewer only if the pool has fewer."""
    h = F.xxhash64("a", "b", F.lit(seed))
    rank = {name: i for i, (name, _) in enumerate(TIERS)}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("tier")]
    best = pairs.withColumn("_h", h).withColumn("_k", F.row_number().over(Window.partitionBy("tier").orderBy("_h", "a", "b"))).where(F.col("_k") <= n)
    picked = best.withColumn("_t", order).orderBy("_k", "_t").limit(n)
    swap = F.pmod(F.shiftright("_h", 7), F.lit(2)) == 1
    return picked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "gap", "tier", F.when(swap, F.translate("answer", "ab", "ba")).otherwise(F.col("answer")).alias("answer"))


def close_share(pairs: DataFrame, within: float = 0.05) -> DataFrame:
    """One row: the share of pairs closer than `within`; 0 without pairs."""
    return pairs.agg(F.coalesce(F.avg((F.col("gap") < within).cast("double")), F.lit(0.0)).alias("share"))


def summary(log: DataFrame) -> DataFrame:
    """log(tier, confidence, correct) -> one row: n, accuracy and Brier score."""
    c = F.col("correct").cast("double")
    return log.agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("accuracy"), F.avg((F.col("confidence") - c) ** 2).alias("brier"))


def calibration(log: DataFrame) -> DataFrame:
    return log.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("actual"))
