"""Window operators: densest interval, streaks, sequence gaps, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def densest_window(df: DataFrame, keys: list[str], at: str, seconds: float) -> DataFrame:
    """For each key, the largest number of rows in a half-open interval [t, t + seconds) that starts at a row, and its earliest start."""
    w = Window.partitionBy(*keys).orderBy("_us").rangeBetween(0, int(seconds * 1_000_000) - 1)
    n = df.select(*keys, F.col(at), micros(F.col(at)).alias("_us")).withColumn("n", F.count(F.lit(1)).over(w))
    best = F.max(F.struct(F.col("n"), -F.col("_us"), F.col(at)))
    return n.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.n").alias("n"), F.col(f"b.{at}").alias("start"))


def streaks(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days with at least one row: first_day, last_day and days."""
    days = df.select(*keys, F.col(day).alias("_d")).distinct()
    island = F.date_sub("_d", F.row_number().over(Window.partitionBy(*keys).orderBy("_d")))
    runs = days.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("_d").alias("first_day"), F.max("_d").alias("last_day"), F.count(F.lit(1)).alias("days"))
    return runs.drop("_i")


def gaps(df: DataFrame, keys: list[str], at: str, step_seconds: int) -> DataFrame:
    """Rows whose predecessor is not exactly one step earlier; a contiguous series gives none."""
    prev = F.lag(at).over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(at))
    return df.select(*keys, at, prev.alias("previous")).where(micros(F.col(at)) - micros(F.col("previous")) != step_seconds * 1_000_000)


def min_max_scaled(df: DataFrame, keys: list[str], value: str, name: str = "scaled") -> DataFrame:
    """value between its group's extremes, from 0 to 1; null where they are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.try_divide(F.col(value) - lo, hi - lo))


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """value with nulls filled by the last one before them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
