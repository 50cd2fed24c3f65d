"""Detectors of unusual points in regular series, injection of known anomalies, and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAD_TO_SIGMA = 1.4826
DETECTORS = ("z_score", "modified_z", "iqr", "seasonal_mad", "per_phase", "poisson")


def flags(series: DataFrame, keys: list[str], period: int = 24, threshold: float = 3.0, k: float = 1.5) -> DataFrame:
    """series(keys, t, y) with a flag for each detector.

    z_score: mean and sample deviation. modified_z: median and MAD; with a MAD of 0, all that differs from the median.
    iqr: fences around the values at the indices n // 4 and 3 * n // 4; none below four points. seasonal_mad: the median of
    each phase and the MAD of all residuals. per_phase: median and MAD of each phase. poisson: the mean of each phase, 1 at
    least, and its root.
    """
    w, phase = Window.partitionBy(*keys), Window.partitionBy(*keys, "_p")
    y = F.col("y")
    s = series.withColumn("_p", F.pmod(F.col("t"), F.lit(period)))
    s = s.withColumns({"_n": F.count("y").over(w), "_mean": F.avg("y").over(w), "_sd": F.stddev_samp("y").over(w), "_med": F.median("y").over(w), "_pmed": F.median("y").over(phase), "_pmean": F.avg("y").over(phase), "_k": F.row_number().over(w.orderBy("y", "t")) - 1})
    s = s.withColumns({"_q1": F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 4), y)).over(w), "_q3": F.max(F.when(F.col("_k") == F.floor(3 * F.col("_n") / 4), y)).over(w), "_mad": F.median(F.abs(y - F.col("_med"))).over(w), "_pmad": F.median(F.abs(y - F.col("_pmed"))).over(phase), "_r": y - F.col("_pmed")})
    s = s.withColumn("_rmed", F.median("_r").over(w)).withColumn("_rmad", F.median(F.abs(F.col("_r") - F.col("_rmed"))).over(w))
    two = F.col("_n") >= 2

    def robust(x: Column, centre: Column, mad: Column, zero: Column) -> Column:
        scale = mad * MAD_TO_SIGMA
        return F.coalesce(F.when(scale == 0, zero).otherwise(F.abs(x - centre) / scale >= threshold), F.lit(False))

    spread, mu = F.col("_q3") - F.col("_q1"), F.greatest(F.col("_pmean"), F.lit(1.0))
    found = {
        "z_score": F.coalesce(F.try_divide(F.abs(y - F.col("_mean")), F.col("_sd")) >= threshold, F.lit(False)),
        "modified_z": robust(y, F.col("_med"), F.col("_mad"), y != F.col("_med")),
        "iqr": (F.col("_n") >= 4) & ((y < F.col("_q1") - k * spread) | (y > F.col("_q3") + k * spread)),
        "seasonal_mad": robust(F.col("_r"), F.col("_rmed"), F.col("_rmad"), F.col("_r") != 0),
        "per_phase": robust(y, F.col("_pmed"), F.col("_pmad"), y != F.col("_pmed")),
        "poisson": F.abs(y - mu) / F.sqrt(mu) >= threshold,
    }
    return s.select(*series.columns, *[(two & c).alias(name) for name, c in found.items()])


def inject(series: DataFrame, keys: list[str], hour: Column, n_each: int = 12, quiet: tuple = (2, 3, 4), busy: tuple = (8, 17, 18), place: Column | None = None) -> DataFrame:
    """series with `kind` and y changed: n_each spikes to 60 anywhere, then to 12 in quiet hours, then drops to 0 in busy hours, at seeded places that are still free."""
    h = place if place is not None else F.xxhash64(*keys, "t")
    s = series.withColumn("_h", h).withColumn("_hour", hour)
    w = Window.partitionBy(*keys)
    s = s.withColumn("_spike", F.row_number().over(w.orderBy("_h", "t")) <= n_each)
    rank = lambda ok: F.row_number().over(w.orderBy(F.when(ok, 0).otherwise(1), "_h", "t"))
    ok = F.col("_hour").isin(*quiet) & ~F.col("_spike")
    s = s.withColumn("_ctx", ok & (rank(ok) <= n_each))
    ok = F.col("_hour").isin(*busy) & ~F.col("_spike") & ~F.col("_ctx")
    s = s.withColumn("_drop", ok & (rank(ok) <= n_each))
    kind = F.when(F.col("_spike"), "global spike").when(F.col("_ctx"), "contextual spike").when(F.col("_drop"), "dropout")
    y = F.when(F.col("_spike"), 60.0).when(F.col("_ctx"), 12.0).when(F.col("_drop"), 0.0).otherwise(F.col("y"))
    return s.select(*[c for c in series.columns if c != "y"], y.alias("y"), kind.alias("kind"))


def _long(flagged: DataFrame, keys: list[str]) -> DataFrame:
    return flagged.select(*keys, "kind", F.inline(F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).alias("flag")) for d in DETECTORS])))


def scores(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, detector, flagged, precision, recall, f1), 0 where undefined."""
    n = _long(flagged, keys).groupBy(*keys, "detector").agg(F.count_if("flag").alias("flagged"), F.count_if(F.col("flag") & F.col("kind").isNotNull()).alias("_hits"), F.count("kind").alias("_true"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    q = n.withColumn("precision", zero(F.col("_hits"), F.col("flagged"))).withColumn("recall", zero(F.col("_hits"), F.col("_true")))
    return q.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("_hits", "_true")


def by_kind(flagged: DataFrame, keys: list[str]) -> DataFrame:
    return _long(flagged, keys).where("kind is not null").groupBy(*keys, "detector", "kind").agg(F.count_if("flag").alias("found"), F.count(F.lit(1)).alias("total"))


def z_of_outliers(n: Column, k: Column) -> Column:
    """The z-score of each of k equal outliers among n points, however far out they are: sqrt((n - k)(n - 1) / (k n))."""
    return F.sqrt((n - k) * (n - 1) / (k * n))


def masking(spark, sizes: int = 400, threshold: float = 3.0) -> DataFrame:
    """(n, ceiling, ceiling_population, z_two, masked) for windows of 3 to `sizes` points; masked: one outlier is flagged and two are not."""
    n = F.col("n")
    t = spark.range(3, sizes).withColumnRenamed("id", "n")
    one, two = z_of_outliers(n, F.lit(1)), z_of_outliers(n, F.lit(2))
    return t.select("n", one.alias("ceiling"), F.sqrt(n - 1).alias("ceiling_population"), two.alias("z_two"), ((one >= threshold) & (two < threshold)).alias("masked"))


def least_window(threshold: float, sample: bool = True) -> int:
    """The smallest window in which one outlier can pass the threshold."""
    n = 3
    while ((n - 1) / math.sqrt(n) if sample else math.sqrt(n - 1)) <= threshold:
        n += 1
    return n


def detectability(series: DataFrame, keys: list[str], hour: Column) -> DataFrame:
    """(keys, hour, rate, sigmas): the mean of each hour of the day, and how far below it, in deviations of a count, an outage lies."""
    m = series.groupBy(*keys, hour.cast("long").alias("hour")).agg(F.avg("y").alias("rate"))
    return m.withColumn("sigmas", F.sqrt(F.greatest("rate", F.lit(0.0))))


def daily_rate(series: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """(keys, rate): the mean of a key's days without its first and last, which may be partial."""
    d = series.groupBy(*keys, day.alias("_d")).agg(F.sum("y").alias("y"))
    w = Window.partitionBy(*keys)
    inner = d.withColumn("_a", F.min("_d").over(w)).withColumn("_b", F.max("_d").over(w)).where("_d > _a and _d < _b")
    return inner.groupBy(*keys).agg(F.avg("y").alias("rate"))
