"""A/B tests: simulated experiments with repeated looks, false positives, calibrated bars, power."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import binomial_cdf, two_proportion_z

RATE, PER_DAY, DAYS = 0.10, 1000, 14


def simulate(spark: SparkSession, trials: int, lift: float = 0.0, rate: float = RATE, per_day: int = PER_DAY, days: int = DAYS, seed: int = 0) -> DataFrame:
    """(trial, day, xa, xb, n): cumulated conversions and users of both arms of each simulated test.

    Days are drawn by inverting the exact distribution at numbers that hang on seed, trial, day and arm only.
    """
    base, treat = np.array(binomial_cdf(per_day, rate)), np.array(binomial_cdf(per_day, rate * (1 + lift)))

    def uniform(trial: np.ndarray, stream: int) -> np.ndarray:
        x = trial.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + stream) % 2**63)
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            xa, xb = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for day in range(1, days + 1):
                xa = xa + np.searchsorted(treat, uniform(ids, 2 * day))
                xb = xb + np.searchsorted(base, uniform(ids, 2 * day + 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), day)), pa.array(xa), pa.array(xb), pa.array(np.full(len(ids), day * per_day))], names=["trial", "day", "xa", "xb", "n"])

    return spark.range(trials).mapInArrow(run, "trial long, day long, xa long, xb long, n long")


def looks_z(tests: DataFrame, looks: list[int]) -> DataFrame:
    return tests.where(F.col("day").isin(looks)).withColumn("z", two_proportion_z(F.col("xa"), F.col("n"), F.col("xb"), F.col("n")))


def stopped(tests: DataFrame, looks: list[int], bar: float) -> DataFrame:
    """(trial, stopped_on, lift): tests that a look finds significant, at the first such look."""
    hit = looks_z(tests, looks).where(F.abs("z") >= bar)
    first = hit.groupBy("trial").agg(F.min_by(F.struct("day", "xa", "xb"), "day").alias("s"))
    return first.select("trial", F.col("s.day").alias("stopped_on"), F.coalesce(F.try_divide(F.col("s.xa") - F.col("s.xb"), F.col("s.xb")), F.lit(0.0)).alias("lift"))


def rejection_rate(tests: DataFrame, looks: list[int], bar: float) -> DataFrame:
    """One row: the share of tests that any look finds significant: false positives without a lift, power with one."""
    top = looks_z(tests, looks).groupBy("trial").agg(F.max(F.abs("z")).alias("z"))
    return top.agg(F.avg((F.col("z") >= bar).cast("double")).alias("rate"), F.count(F.lit(1)).alias("trials"))


def calibrated_bar(tests: DataFrame, looks: list[int], alpha: float = 0.05) -> DataFrame:
    """One row: the bar that a share alpha of the tests passes at some look: a quantile of each test's largest z, with no search."""
    top = looks_z(tests, looks).groupBy("trial").agg(F.max(F.abs("z")).alias("z"))
    return top.agg(F.percentile("z", F.lit(1 - alpha)).alias("bar"))
