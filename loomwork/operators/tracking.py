"""Event logs with a current state, session clocks, drifting popularity, and a registry of claims that are recomputed."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def advance(events: DataFrame, moves: DataFrame) -> DataFrame:
    """The log with new events appended; the state is always derived from it, so it cannot disagree."""
    return events.unionByName(moves, allowMissingColumns=True)


def current_state(events: DataFrame, key: str, stage: str, order: list[str], terminal: tuple[str, ...] = ()) -> DataFrame:
    """(key, stage, since, closed): the stage of each key's latest event."""
    last = events.groupBy(key).agg(F.max_by(F.struct(stage, order[0]), F.struct(*order)).alias("s"))
    return last.select(key, F.col(f"s.{stage}").alias("stage"), F.col(f"s.{order[0]}").alias("since"), F.col(f"s.{stage}").isin(*terminal).alias("closed"))


def detail(events: DataFrame, starts: DataFrame, key: str, at: str) -> DataFrame:
    """Events with the days since their key's start."""
    return events.join(starts.select(key, F.col("started").alias("_s")), key).withColumn("days_in", F.datediff(F.col(at), F.col("_s")).cast("long")).drop("_s")


def served(stretches: DataFrame, key: str) -> DataFrame:
    """stretches(key, resumed_at, stopped_at) in milliseconds -> (key, served_ms): time on the clock, pauses left out, never below 0 for a stretch."""
    return stretches.groupBy(key).agg(F.sum(F.greatest(F.col("stopped_at") - F.col("resumed_at"), F.lit(0))).alias("served_ms"))


def tick_error(fires: DataFrame, key: str, at: str, duration_ms: int, interval_ms: int = 1000) -> DataFrame:
    """(key, ticked, clock): what counting timer fires believes has passed, and what the clock says at the last fire."""
    n = fires.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    left = F.greatest(F.ceil(F.lit(duration_ms / interval_ms)), F.lit(0))
    return n.select(key, (F.least("n", left) * interval_ms).cast("long").alias("ticked"), F.least(F.lit(duration_ms), F.greatest("last", F.lit(0))).cast("long").alias("clock"))


def next_phase(phase: Column, completed: Column, every: int = 4) -> Column:
    """What follows a phase: focus after a break; after focus a long break for each fourth completed block, else a short one."""
    return F.when(phase != "focus", "focus").when((completed > 0) & (completed % every == 0), "long break").otherwise("short break")


def item_weight(item: Column, day: Column, drift: float, days: int) -> Column:
    """An item's popularity on a day: a static appeal by rank, and with a drift a smooth rise and fall around the item's own day."""
    base = 1 / F.sqrt(item + 2)
    if drift <= 0:
        return base
    width = days / 6
    peak = F.pmod(item * 7919, F.lit(days))
    return base * (1 + 2 * drift * F.exp(-((day - peak) * (day - peak)) / (2 * width * width)))


def interactions(spark: SparkSession, users: int, items: int, days: int, per_user: int, drift: float = 1.0, seed: int = 0) -> DataFrame:
    """A seeded interaction log (user, item, day) with drifting popularity: each draw takes the item with the largest weighted key of its day."""
    u = F.pmod(F.xxhash64("user", "k", "item", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    t = spark.range(users).withColumnRenamed("id", "user").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_user))))
    t = t.withColumn("day", F.pmod(F.xxhash64("user", "k", F.lit(seed + 1)), F.lit(days))).withColumn("item", F.explode(F.sequence(F.lit(0), F.lit(items - 1))))
    key = F.log(u + 1e-18) / item_weight(F.col("item"), F.col("day"), drift, days)
    best = t.withColumn("_key", key).groupBy("user", "k", "day").agg(F.max_by("item", F.struct("_key", "item")).alias("item"))
    return best.groupBy("user", "item").agg(F.min("day").alias("day"))


def hazard(p: Column, n: int) -> Column:
    """The chance that one of n fields fails, each with chance p."""
    return 1 - F.pow(1 - p, F.lit(n))


def check_claims(claims: list[tuple[str, float, float, Callable[[], float]]], threads: int = 8) -> list[dict]:
    """Recomputes each claim (name, expected, tolerance, how) and says whether it holds; a claim that cannot be computed fails."""

    def one(c):
        name, expected, tolerance, how = c
        try:
            actual = float(how())
        except Exception as e:  # noqa: BLE001  a claim that breaks is a claim that fails
            return {"name": name, "expected": expected, "actual": None, "ok": False, "error": str(e)}
        return {"name": name, "expected": expected, "actual": actual, "ok": not math.isnan(actual) and abs(actual - expected) <= tolerance, "error": ""}

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, claims))
