"""Funnels, response times and rates over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """The element at index round(q * (n - 1)) of a sorted array, halves to even; null for an empty array."""
    return F.get(sorted_values, F.bround(F.lit(q) * (F.size(sorted_values) - 1)).cast("int"))


def ranked_percentile(df: DataFrame, value: str, q: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, value): the nearest-rank percentile of each group by counts of distinct values, without gathering a group."""
    keys = keys or []
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    at = F.bround(F.lit(q) * (F.sum("_n").over(w) - 1)).cast("long")
    up = c.withColumn("_up", F.sum("_n").over(w.orderBy("_v"))).withColumn("_at", at)
    return up.where("_up > _at and _up - _n <= _at").select(*keys, F.col("_v").alias(value))


def funnel(events: DataFrame, who: str, stage: str, stages: list[str]) -> DataFrame:
    """For each stage in order, how many ever reached it, and the share of the stage before and of the first; null where that is 0."""
    reached = events.where(F.col(stage).isin(stages)).groupBy(F.col(stage).alias("_s")).agg(F.count_distinct(who).alias("_n"))
    order = events.sparkSession.createDataFrame(list(enumerate(stages)), "position int, stage string")
    t = order.join(reached, F.col("stage") == F.col("_s"), "left").select("position", "stage", F.coalesce("_n", F.lit(0)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("position")  # one row for each stage
    before, top = F.lag("n").over(w), F.first("n").over(w)
    return t.select("stage", "n", F.try_divide("n", before).alias("from_prev"), F.try_divide("n", top).alias("from_top"))


def funnel_now(events: DataFrame, who: str, stage: str, order: list[str], stages: list[str]) -> DataFrame:
    """For each stage, how many are there by their latest event."""
    last = events.groupBy(who).agg(F.max_by(stage, F.struct(*order)).alias("_s")).groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    t = events.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return t.join(last, F.col("stage") == F.col("_s"), "left").select("stage", F.coalesce("_n", F.lit(0)).alias("n"))


def silent_rate(items: DataFrame, replies: DataFrame, key: str, reply_key: str, started: str, today, days: int) -> DataFrame:
    """One row: eligible items (started at least `days` before today), those without any reply, those too recent, and the rate (null without eligible ones)."""
    answered = replies.select(F.col(reply_key).alias("_k")).distinct().withColumn("_a", F.lit(True))
    t = items.join(answered, items[key] == F.col("_k"), "left").withColumn("_old", F.datediff(F.lit(today).cast("date"), F.col(started)) >= days)
    t = t.agg(F.count_if("_old").alias("eligible"), F.count_if(F.col("_old") & F.col("_a").isNull()).alias("silent"), F.count_if(~F.col("_old")).alias("too_recent"))
    return t.withColumn("rate", F.try_divide("silent", "eligible"))
