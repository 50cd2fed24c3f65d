"""Quizzes, event-log states, clocks and drifting popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import quiz as Z
from ..operators import tracking as K
from ..tables import load, money

_NATIONS = "n AS (SELECT n_name AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"
_POOL = f"""{_NATIONS}, p AS (SELECT a.n AS a, b.n AS b, (greatest(a.v, b.v) - least(a.v, b.v)) / greatest(a.v, b.v) AS gap, CASE WHEN a.v > b.v THEN 'a' ELSE 'b' END AS answer FROM n a JOIN n b ON a.n < b.n AND a.v <> b.v WHERE a.v > 0 AND b.v > 0)"""


def nations(spark, sf):
    t = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum(money("c_acctbal")).cast("double").alias("v"))
    return t.join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("n"), "v")


@query("quiz_pool", f"WITH {_POOL} SELECT a, b, gap, answer, CASE WHEN gap >= 0.40 THEN 'easy' WHEN gap >= 0.12 THEN 'medium' WHEN gap >= 0.02 THEN 'hard' ELSE 'brutal' END AS tier FROM p")
def quiz_pool(spark, sf):
    return Z.pool(nations(spark, sf), "n", "v")


@query("quiz_close_share", f"WITH {_POOL} SELECT avg(CAST(gap < 0.05 AS DOUBLE)) AS share FROM p")
def quiz_close_share(spark, sf):
    return Z.close_share(quiz_pool(spark, sf))


@query("quiz_draw")
def quiz_draw(spark, sf):
    """Ten questions, spread over the tiers."""
    return Z.draw(quiz_pool(spark, sf))


@query("current_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS since, arg_max(event_type, (ts, event_id)) IN ('purchase', 'error') AS closed FROM events GROUP BY 1")
def current_state(spark, sf):
    return K.current_state(load(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], ("purchase", "error"))


@query("event_detail", "SELECT event_id, user_id, CAST(CAST(ts AS DATE) - min(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS BIGINT) AS days_in FROM events")
def event_detail(spark, sf):
    e = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return K.detail(e, e.groupBy("user_id").agg(F.min("day").alias("started")), "user_id", "day").select("event_id", "user_id", "days_in")


@query("tick_error", "SELECT user_id, CAST(least(count(*), 1500) * 1000 AS BIGINT) AS ticked, CAST(least(1500000, greatest(max(event_id % 2000000), 0)) AS BIGINT) AS clock FROM events GROUP BY 1")
def tick_error(spark, sf):
    return K.tick_error(load(spark, sf, "events").withColumn("at", F.col("event_id") % 2000000), "user_id", "at", 1_500_000)


@query("next_phase", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'focus' WHEN p_size % 9 > 0 AND p_size % 9 % 4 = 0 THEN 'long break' ELSE 'short break' END AS phase FROM part")
def next_phase(spark, sf):
    now = F.when(F.col("p_size") % 3 == 0, "focus").otherwise("break")
    return load(spark, sf, "part").select("p_partkey", K.next_phase(now, F.col("p_size") % 9).alias("phase"))


@query("item_weights", "SELECT p_partkey, round(1 / sqrt(p_partkey + 2) * (1 + 2 * exp(-power(p_size - (p_partkey * 7919) % 120, 2) / (2 * 20.0 * 20.0))), 9) AS weight FROM part")
def item_weights(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.round(K.item_weight(F.col("p_partkey"), F.col("p_size"), 1.0, 120), 9).alias("weight"))


@query("generated_log")
def generated_log(spark, sf):
    """A seeded interaction log whose popular items change."""
    return K.interactions(spark, 60, 40, 30, 8)


@query("hazard", "SELECT n, round(1 - power(1 - 0.05, 8), 9) AS file_hazard FROM range(1, 3) r(n)")
def hazard(spark, sf):
    return spark.range(1, 3).select(F.col("id").alias("n"), F.round(K.hazard(F.lit(0.05), 8), 9).alias("file_hazard"))


@query("claims")
def claims(spark, sf):
    """Published numbers, recomputed."""
    from ..functions import similarity
    from ..operators import forecast, programming

    c, k, u = programming.sizing()
    listed = [
        ("jaro of martha and marhta", 0.944, 5e-4, lambda: similarity.jaro("martha", "marhta")),
        ("best constant error", 15.2459, 1e-4, lambda: forecast.floor_of_constant(70, 130)),
        ("naive error", 20.3279, 1e-4, lambda: forecast.floor_of_naive(70, 130)),
        ("relaxation", 627.5, 0, lambda: programming.relaxation(c, k, u)[0]),
        ("whole optimum", 635, 0, lambda: programming.branch_and_bound(c, k, u)[0]),
    ]
    rows = [(r["name"], float(r["expected"]), r["actual"], r["ok"]) for r in K.check_claims(listed)]
    return spark.createDataFrame(rows, "name string, expected double, actual double, ok boolean")


@query("served_clock", "SELECT user_id, CAST(sum(greatest(event_id % 7 - 2, 0) * 1000) AS BIGINT) AS served_ms FROM events GROUP BY 1")
def served_clock(spark, sf):
    start = F.col("event_id") * 10
    return K.served(load(spark, sf, "events").select("user_id", start.alias("resumed_at"), (start + (F.col("event_id") % 7 - 2) * 1000).alias("stopped_at")), "user_id")
