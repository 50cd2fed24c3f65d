"""A/B statistics and rate limiters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import stats as S
from ..operators import experiment as E
from ..operators import limiters as L
from ..tables import load

_ARMS = """d AS (SELECT CAST(ts AS DATE) AS day, user_id % 2 AS arm, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS x FROM events GROUP BY 1, 2),
    c AS (SELECT day, sum(x) FILTER (arm = 0) AS xa, sum(n) FILTER (arm = 0) AS na, sum(x) FILTER (arm = 1) AS xb, sum(n) FILTER (arm = 1) AS nb FROM d GROUP BY day),
    r AS (SELECT day, coalesce(sum(xa) OVER w, 0) AS xa, coalesce(sum(na) OVER w, 0) AS na, coalesce(sum(xb) OVER w, 0) AS xb, coalesce(sum(nb) OVER w, 0) AS nb FROM c WINDOW w AS (ORDER BY day)), q AS (SELECT *, (xa + xb) / (na + nb) AS p FROM r)"""


def arms(spark, sf):
    e = load(spark, sf, "events")
    a, buy = F.col("user_id") % 2 == 0, F.col("event_type") == "purchase"
    d = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(a & buy).alias("xa"), F.count_if(a).alias("na"), F.count_if(~a & buy).alias("xb"), F.count_if(~a).alias("nb"))
    w = Window.partitionBy(F.lit(1)).orderBy("day")  # one row for each day
    return d.select("day", *[F.sum(c).over(w).alias(c) for c in ("xa", "na", "xb", "nb")])


@query("ab_ztest", f"WITH {_ARMS} SELECT day, CAST(xa AS BIGINT) AS xa, CAST(na AS BIGINT) AS na, CAST(xb AS BIGINT) AS xb, CAST(nb AS BIGINT) AS nb, round(CASE WHEN p > 0 AND p < 1 THEN (xa / na - xb / nb) / sqrt(p * (1 - p) * (1 / na + 1 / nb)) ELSE 0 END, 9) AS z FROM q")
def ab_ztest(spark, sf):
    return arms(spark, sf).withColumn("z", F.round(S.two_proportion_z(F.col("xa"), F.col("na"), F.col("xb"), F.col("nb")), 9))


@query("ab_pvalues")
def ab_pvalues(spark, sf):
    return ab_ztest(spark, sf).withColumn("p", S.two_sided_p(F.col("z")))


@query("peeking_fpr")
def peeking_fpr(spark, sf):
    """False positives of four ways to look, with the usual bar."""
    tests = E.simulate(spark, 2000)
    ways = {"end": [14], "twice": [7, 14], "every other day": list(range(2, 15, 2)), "daily": list(range(1, 15))}
    out = None
    for name, looks in ways.items():
        r = E.rejection_rate(tests, looks, 1.959964).withColumn("policy", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@query("calibrated_bar")
def calibrated_bar(spark, sf):
    return E.calibrated_bar(E.simulate(spark, 2000, seed=1), list(range(1, 15)))


@query("power")
def power(spark, sf):
    return E.rejection_rate(E.simulate(spark, 2000, lift=0.1, seed=7), list(range(1, 15)), 2.594)


@query("early_stops")
def early_stops(spark, sf):
    return E.stopped(E.simulate(spark, 2000), list(range(1, 15)), 1.959964).groupBy("stopped_on").agg(F.count(F.lit(1)).alias("n"), F.avg("lift").alias("lift"))


@query("limiter_fixed", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def limiter_fixed(spark, sf):
    return L.fixed_window(load(spark, sf, "events"), ["user_id"], "ts", "event_id", 2, 86400).select("event_id", "user_id", "admitted")


def replayed(spark, sf):
    return L.replay(load(spark, sf, "events"), ["user_id"], "ts", "event_id", 2, 86400)


@query("limiter_log")
def limiter_log(spark, sf):
    return replayed(spark, sf).select("user_id", "event_id", "sliding_log")


@query("limiter_counter")
def limiter_counter(spark, sf):
    return replayed(spark, sf).select("user_id", "event_id", "sliding_counter")


@query("limiter_bucket")
def limiter_bucket(spark, sf):
    return replayed(spark, sf).select("user_id", "event_id", "token_bucket")


@query("limiter_worst")
def limiter_worst(spark, sf):
    """The worst 60-second window of each limiter of 100 under adversarial bursts."""
    return L.worst_windows(L.replay(L.adversarial(spark), ["pattern"], "ts", "id", 100, 60), L.KINDS, 60)


@query("limiter_sustained")
def limiter_sustained(spark, sf):
    """Events that each limiter of 100 a minute lets through in a minute, at three times that rate over ten minutes."""
    t = spark.range(3000).select(F.lit("steady").alias("pattern"), "id", F.timestamp_micros((F.col("id") * 200_000).cast("long")).alias("ts"))
    r = L.replay(t, ["pattern"], "ts", "id", 100, 60)
    return r.agg(*[(F.count_if(k) / 10).alias(k) for k in L.KINDS])
