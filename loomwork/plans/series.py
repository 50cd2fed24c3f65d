"""Forecasts and anomalies over counts of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import anomaly as A
from ..operators import forecast as P
from ..operators import windows as W
from ..tables import load

_DAILY = """c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT event_type, min(day) AS a, max(day) AS b FROM c GROUP BY 1),
    g AS (SELECT event_type, a, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e), s AS (SELECT g.event_type, g.day, CAST(g.day - a AS BIGINT) AS t, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.day = g.day)"""
_HOURLY = """c AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT event_type, min(hour) AS a, max(hour) AS b FROM c GROUP BY 1),
    g AS (SELECT event_type, a, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM e), s AS (SELECT g.event_type, g.hour, CAST(epoch(g.hour) - epoch(a) AS BIGINT) // 3600 AS t, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.hour = g.hour)"""
KEYS = ["event_type"]
MODELS = ["naive", "seasonal_naive", "mean", "drift", "trend"]


def daily(spark, sf):
    return P.daily_counts(load(spark, sf, "events"), KEYS, "ts")


def hourly(spark, sf):
    return P.hourly_counts(load(spark, sf, "events"), KEYS, "ts")


@query("daily_filled", f"WITH {_DAILY} SELECT event_type, day, t, y FROM s")
def daily_filled(spark, sf):
    return daily(spark, sf)


@query("hourly_zero_filled", f"WITH {_HOURLY} SELECT event_type, t, y FROM s")
def hourly_zero_filled(spark, sf):
    return hourly(spark, sf).select("event_type", "t", "y")


_PRED = f"""WITH {_DAILY}, p AS (SELECT event_type, t, y, lag(y) OVER w AS naive, coalesce(lag(y, 7) OVER w, lag(y) OVER w) AS seasonal_naive, avg(y) OVER z AS mean,
    lag(y) OVER w + (lag(y) OVER w - first(y) OVER z) / (count(*) OVER z - 1) AS drift, regr_intercept(y, t) OVER z + regr_slope(y, t) OVER z * t AS trend
    FROM s WINDOW w AS (PARTITION BY event_type ORDER BY t), z AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT event_type, m.model, y - CASE m.model WHEN 'naive' THEN naive WHEN 'seasonal_naive' THEN seasonal_naive WHEN 'mean' THEN mean WHEN 'drift' THEN drift ELSE trend END AS e FROM p, (VALUES ('naive'), ('seasonal_naive'), ('mean'), ('drift'), ('trend')) m(model) WHERE t >= 14),
    a AS (SELECT event_type, model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, count(e) AS n FROM l GROUP BY 1, 2)
    SELECT event_type, model, round(mae, 8) AS mae, round(rmse, 8) AS rmse, n, round(mae / max(CASE WHEN model = 'naive' THEN mae END) OVER (PARTITION BY event_type), 8) AS mase FROM a"""


@query("walkforward_mae", _PRED)
def walkforward_mae(spark, sf):
    e = P.errors(P.predictions(daily(spark, sf), KEYS), KEYS, MODELS)
    return e.select("event_type", "model", F.round("mae", 8).alias("mae"), F.round("rmse", 8).alias("rmse"), "n", F.round("mase", 8).alias("mase"))


@query("walkforward_smoothing")
def walkforward_smoothing(spark, sf):
    p = P.smoothing_predictions(daily(spark, sf), KEYS)
    return P.errors(p.withColumn("naive", F.lag("y").over(_by_key())), KEYS, ["naive", "ses", "holt"])


def _by_key():
    from pyspark.sql.window import Window

    return Window.partitionBy(*KEYS).orderBy("t")


@query("bootstrap")
def bootstrap(spark, sf):
    """Whether the mean forecasts better than naive, by resampled differences of their errors."""
    p = P.predictions(daily(spark, sf), KEYS).where(F.col("t") >= P.MIN_TRAIN)
    d = p.select(*KEYS, (F.col("t") - P.MIN_TRAIN).alias("i"), (F.abs(F.col("y") - F.col("mean")) - F.abs(F.col("y") - F.col("naive"))).alias("d"))
    return P.paired_bootstrap(d, KEYS, trials=400)


@query("permutation")
def permutation(spark, sf):
    """Whether weekdays differ, by shuffled labels."""
    s = daily(spark, sf).groupBy("day").agg(F.sum("y").alias("y")).withColumn("weekday", F.weekday("day")).withColumn("id", F.unix_date("day"))
    return P.permutation_spread(s, "weekday", "y", "id", trials=200)


@query("series_gaps", "SELECT event_type, hour, previous FROM (SELECT event_type, hour, lag(hour) OVER (PARTITION BY event_type ORDER BY hour) AS previous FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events)) WHERE hour - previous <> INTERVAL 1 HOUR")
def series_gaps(spark, sf):
    h = load(spark, sf, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    return W.gaps(h, KEYS, "hour", 3600)


_INJECT = f"""{_HOURLY}, i AS (SELECT *, (t * 7919) % 10007 AS h, hour(hour) AS hh FROM s), i1 AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, t) <= 12 AS spike FROM i),
    i2 AS (SELECT *, hh IN (2, 3, 4) AND NOT spike AND row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN hh IN (2, 3, 4) AND NOT spike THEN 0 ELSE 1 END, h, t) <= 12 AS ctx FROM i1),
    i3 AS (SELECT *, hh IN (8, 17, 18) AND NOT spike AND NOT ctx AND row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN hh IN (8, 17, 18) AND NOT spike AND NOT ctx THEN 0 ELSE 1 END, h, t) <= 12 AS drp FROM i2),
    x AS (SELECT event_type, t, CASE WHEN spike THEN 60.0 WHEN ctx THEN 12.0 WHEN drp THEN 0.0 ELSE y END AS y, CASE WHEN spike THEN 'global spike' WHEN ctx THEN 'contextual spike' WHEN drp THEN 'dropout' END AS kind FROM i3)"""
_FLAGS = f"""{_INJECT}, f1 AS (SELECT *, t % 24 AS p, count(y) OVER w AS n, avg(y) OVER w AS mean, stddev_samp(y) OVER w AS sd, median(y) OVER w AS med, median(y) OVER q AS pmed, avg(y) OVER q AS pmean, row_number() OVER (PARTITION BY event_type ORDER BY y, t) - 1 AS k
      FROM x WINDOW w AS (PARTITION BY event_type), q AS (PARTITION BY event_type, t % 24)),
    f2 AS (SELECT *, max(CASE WHEN k = n // 4 THEN y END) OVER w AS q1, max(CASE WHEN k = 3 * n // 4 THEN y END) OVER w AS q3, median(abs(y - med)) OVER w AS mad, median(abs(y - pmed)) OVER q AS pmad, y - pmed AS r FROM f1 WINDOW w AS (PARTITION BY event_type), q AS (PARTITION BY event_type, p)),
    f3 AS (SELECT *, median(r) OVER (PARTITION BY event_type) AS rmed FROM f2), f4 AS (SELECT *, median(abs(r - rmed)) OVER (PARTITION BY event_type) AS rmad FROM f3),
    f AS (SELECT event_type, t, y, kind, coalesce(abs(y - mean) / nullif(sd, 0) >= 3, false) AS z_score, CASE WHEN mad = 0 THEN y <> med ELSE abs(y - med) / (mad * 1.4826) >= 3 END AS modified_z, n >= 4 AND (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS iqr,
      CASE WHEN rmad = 0 THEN r <> 0 ELSE abs(r - rmed) / (rmad * 1.4826) >= 3 END AS seasonal_mad, CASE WHEN pmad = 0 THEN y <> pmed ELSE abs(y - pmed) / (pmad * 1.4826) >= 3 END AS per_phase, abs(y - greatest(pmean, 1)) / sqrt(greatest(pmean, 1)) >= 3 AS poisson FROM f4)"""


def flagged(spark, sf):
    x = A.inject(hourly(spark, sf), KEYS, F.hour("hour"), place=F.col("t") * 7919 % 10007)
    return A.flags(x.drop("hour"), KEYS)


@query("anomaly_flags", f"WITH {_FLAGS} SELECT event_type, t, z_score, modified_z, iqr, seasonal_mad, per_phase, poisson FROM f WHERE z_score OR modified_z OR iqr OR seasonal_mad OR per_phase OR poisson")
def anomaly_flags(spark, sf):
    f = flagged(spark, sf)
    return f.where(" or ".join(A.DETECTORS)).select("event_type", "t", *A.DETECTORS)


_LONG = f"""{_FLAGS}, l AS (SELECT event_type, kind, d.d AS detector, CASE d.d {' '.join(f"WHEN '{d}' THEN {d}" for d in A.DETECTORS)} END AS flag FROM f, (VALUES {', '.join(f"('{d}')" for d in A.DETECTORS)}) d(d))"""


@query(
    "anomaly_scores",
    f"""WITH {_LONG}, q AS (SELECT event_type, detector, count(*) FILTER (flag) AS flagged, coalesce(count(*) FILTER (flag AND kind IS NOT NULL) / nullif(count(*) FILTER (flag), 0), 0) AS precision, count(*) FILTER (flag AND kind IS NOT NULL) / count(kind) AS recall FROM l GROUP BY 1, 2)
    SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q""",
)
def anomaly_scores(spark, sf):
    return A.scores(flagged(spark, sf), KEYS)


@query("anomaly_by_kind", f"WITH {_LONG} SELECT event_type, detector, kind, count(*) FILTER (flag) AS found, count(*) AS total FROM l WHERE kind IS NOT NULL GROUP BY 1, 2, 3")
def anomaly_by_kind(spark, sf):
    return A.by_kind(flagged(spark, sf), KEYS)


@query("z_ceiling", "SELECT n, sqrt((n - 1) * (n - 1) / n) AS ceiling, sqrt(n - 1) AS ceiling_population, sqrt((n - 2) * (n - 1) / (2 * n)) AS z_two, sqrt((n - 1) * (n - 1) / n) >= 3 AND sqrt((n - 2) * (n - 1) / (2 * n)) < 3 AS masked FROM range(3, 400) r(n)")
def z_ceiling(spark, sf):
    return A.masking(spark)


@query("detectability", f"WITH {_HOURLY} SELECT event_type, hour(hour) AS hour, round(avg(y), 9) AS rate, round(sqrt(avg(y)), 9) AS sigmas FROM s GROUP BY 1, 2")
def detectability(spark, sf):
    return A.detectability(hourly(spark, sf), KEYS, F.hour("hour")).withColumns({"rate": F.round("rate", 9), "sigmas": F.round("sigmas", 9)})


@query("daily_rate", f"WITH {_DAILY} SELECT event_type, round(avg(y), 9) AS rate FROM (SELECT *, min(day) OVER w AS a, max(day) OVER w AS b FROM s WINDOW w AS (PARTITION BY event_type)) WHERE day > a AND day < b GROUP BY 1")
def daily_rate(spark, sf):
    return A.daily_rate(daily(spark, sf), KEYS, F.col("day")).withColumn("rate", F.round("rate", 9))
