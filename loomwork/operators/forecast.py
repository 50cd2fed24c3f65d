"""Baseline forecasts, walk-forward evaluation and resampling tests over regular series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEASON, MIN_TRAIN = 7, 14
ALPHAS = [i / 20 for i in range(1, 20)]
HOLT_GRID = [(a, b) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.05, 0.1, 0.3, 0.5)]


def daily_counts(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, day, t, y): rows for each day from a key's first to its last, 0 where there is none; t counts from 0."""
    n = events.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return _filled(n, keys, "day", F.expr("interval 1 day"), F.datediff)


def hourly_counts(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, hour, t, y): rows for each hour from a key's first to its last, 0 where there is none."""
    n = events.groupBy(*keys, F.date_trunc("hour", F.col(at).cast("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return _filled(n, keys, "hour", F.expr("interval 1 hour"), lambda b, a: F.floor((F.unix_seconds(b) - F.unix_seconds(a)) / 3600))


def _filled(n: DataFrame, keys: list[str], at: str, step: Column, since) -> DataFrame:
    ends = n.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    spine = ends.select(*keys, "_a", F.explode(F.sequence("_a", "_b", step)).alias(at))
    out = spine.join(n, [*keys, at], "left")
    return out.select(*keys, at, since(F.col(at), F.col("_a")).cast("long").alias("t"), F.coalesce("n", F.lit(0)).cast("double").alias("y"))


def predictions(series: DataFrame, keys: list[str]) -> DataFrame:
    """series(keys, t, y) with one column for each model that needs only frames before t: naive, seasonal_naive, mean, drift, trend. Each sees rows before its own only."""
    w = Window.partitionBy(*keys).orderBy("t")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.lit(1)).over(past)
    last = F.lag("y").over(w)
    first = F.first("y").over(past)
    drift = F.when(n < 2, last).otherwise(last + F.try_divide(last - first, n - 1))
    slope, base = F.regr_slope("y", F.col("t")).over(past), F.regr_intercept("y", F.col("t")).over(past)
    trend = F.when(n < 2, last).otherwise(base + slope * F.col("t"))
    return series.select(*keys, "t", "y", last.alias("naive"), F.coalesce(F.lag("y", SEASON).over(w), last).alias("seasonal_naive"), F.avg("y").over(past).alias("mean"), drift.alias("drift"), trend.alias("trend"))


def smoothing_predictions(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, y, ses, holt, alpha): exponential smoothing whose parameters are fitted anew at each step on the past only.

    For every parameter of the grid the level, trend and sum of one-step errors are carried on as the series goes by, so a
    series costs one pass. Rows stream through a task in order of key and time; nothing holds a whole series.
    """
    nk = len(keys)
    alphas = np.array(ALPHAS)
    ha, hb = (np.array(x) for x in zip(*HOLT_GRID, strict=True))

    def run(batches):
        import pyarrow as pa

        state, now = None, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(nk + 2)]
            out = []
            for row in zip(*cols, strict=True):
                key, y = row[:nk], row[nk + 1]
                if state is None or key != now:
                    now, state = key, {"n": 0}
                s = state
                if s["n"] == 0:
                    out.append((None, None, None))
                elif s["n"] == 1:
                    out.append((s["last"], s["last"], 1.0))
                else:
                    k = int(np.argmin(s["err"]))
                    j = int(np.argmin(s["herr"]))
                    out.append((float(s["level"][k]) if s["n"] > 2 else s["last"], float(s["hl"][j] + s["ht"][j]) if s["n"] > 3 else s["last"], ALPHAS[k] if s["n"] > 2 else 1.0))
                if s["n"] == 0:
                    s.update(level=np.full(len(alphas), y), err=np.zeros(len(alphas)), first=y)
                else:
                    s["err"] = s["err"] + np.abs(y - s["level"])
                    s["level"] = alphas * y + (1 - alphas) * s["level"]
                    if s["n"] == 1:
                        s["hl"], s["ht"], s["herr"] = np.full(len(ha), s["first"]), np.full(len(ha), y - s["first"]), np.zeros(len(ha))
                    guess = s["hl"] + s["ht"]
                    s["herr"] = s["herr"] + np.abs(y - guess)
                    level = ha * y + (1 - ha) * guess
                    s["ht"] = hb * (level - s["hl"]) + (1 - hb) * s["ht"]
                    s["hl"] = level
                s["last"] = y
                s["n"] += 1
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(nk + 2)], *[pa.array([o[i] for o in out], pa.float64()) for i in range(3)]], names=[*batch.schema.names, "ses", "holt", "alpha"])

    rows = series.select(*keys, "t", F.col("y").cast("double").alias("y"))
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("ses", "holt", "alpha")]])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(run, schema)


def errors(predicted: DataFrame, keys: list[str], models: list[str], min_train: int = MIN_TRAIN) -> DataFrame:
    """(keys, model, mae, rmse, mase, n) of each model from step min_train on; mase is against naive."""
    long = predicted.where(F.col("t") >= min_train).select(*keys, "t", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), (F.col("y") - F.col(m)).alias("e")) for m in models])))
    e = long.groupBy(*keys, "model").agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count("e").alias("n"))
    base = F.max(F.when(F.col("model") == "naive", F.col("mae"))).over(Window.partitionBy(*keys))
    return e.withColumn("mase", F.try_divide("mae", base))


def uniforms(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that hangs on the columns and the seed only."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def paired_bootstrap(diffs: DataFrame, keys: list[str], trials: int = 1000, seed: int = 0) -> DataFrame:
    """diffs(keys, i, d), with i from 0 without gaps -> mean_diff, p_better (share of resamples with a mean below 0), ci_low, ci_high.

    Each resample draws as many numbers i as there are, with return; the draws hang on hashes of trial and place.
    """
    n = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"))
    draws = n.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")).select(*keys, "trial", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("place"))
    draws = draws.withColumn("i", F.floor(uniforms(*[F.col(k) for k in keys], F.col("trial"), F.col("place"), seed=seed) * F.col("n")))
    means = draws.join(diffs.select(*keys, F.col("i").cast("long").alias("i"), "d"), [*keys, "i"]).groupBy(*keys, "trial").agg(F.avg("d").alias("m"))
    at = lambda q: F.get(F.col("ms"), F.lit(int(q * trials)))
    s = means.groupBy(*keys).agg(F.avg((F.col("m") < 0).cast("double")).alias("p_better"), F.sort_array(F.collect_list("m")).alias("ms"))  # one number for each trial
    return s.select(*keys, "p_better", at(0.025).alias("ci_low"), at(0.975).alias("ci_high")).join(n.select(*keys, "mean_diff"), keys)


def permutation_spread(rows: DataFrame, label: str, value: str, row_id: str, trials: int = 500, seed: int = 0) -> DataFrame:
    """One row: the spread of the labels' means, and the share of shuffles of the labels, plus one, that spread at least as far."""
    observed = _spread(rows.withColumn("trial", F.lit(0)), label, value).select(F.col("spread").alias("observed"))
    t = rows.select(row_id, label, value).crossJoin(rows.sparkSession.range(1, trials + 1).withColumnRenamed("id", "trial"))  # a stated number of shuffles
    a = t.select("trial", value, F.row_number().over(Window.partitionBy("trial").orderBy(row_id)).alias("k"))
    b = t.select("trial", label, F.row_number().over(Window.partitionBy("trial").orderBy(F.xxhash64(row_id, "trial", F.lit(seed)), row_id)).alias("k"))
    s = _spread(a.join(b, ["trial", "k"]), label, value).crossJoin(F.broadcast(observed))
    return s.agg(F.first("observed").alias("observed"), ((F.count_if(F.col("spread") >= F.col("observed") - 1e-12) + 1) / (trials + 1)).alias("p_value"))


def _spread(rows: DataFrame, label: str, value: str) -> DataFrame:
    m = rows.groupBy("trial", label).agg(F.avg(value).alias("m"))
    return m.groupBy("trial").agg((F.max("m") - F.min("m")).alias("spread"))


def floor_of_constant(lo: int, hi: int) -> float:
    """Mean absolute error of the best constant forecast of whole numbers drawn evenly from lo to hi."""
    n, mid = hi - lo + 1, (lo + hi) / 2
    return sum(abs(k - mid) for k in range(lo, hi + 1)) / n


def floor_of_naive(lo: int, hi: int) -> float:
    """Mean absolute difference of two such draws: (n * n - 1) / (3 * n)."""
    n = hi - lo + 1
    return (n * n - 1) / (3 * n)
