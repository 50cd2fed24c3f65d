"""Window functions on orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..operators import windows as W
from ..tables import load, money

_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


@query("running_total", f"SELECT o_orderkey, o_custkey, CAST(sum({_PRICE}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DOUBLE) AS running FROM orders")
def running_total(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.sum(money("o_totalprice")).over(w).cast("double").alias("running"))


_TOTALS = f"SELECT o_custkey, sum({_PRICE}) AS total FROM orders GROUP BY o_custkey"


def customer_totals(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("total"))


@query("rank_dense", f"SELECT c_nationkey, o_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY total DESC) AS rnk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY total DESC) AS dense_rnk FROM ({_TOTALS}) JOIN customer ON c_custkey = o_custkey")
def rank_dense(spark, sf):
    t = customer_totals(spark, sf).join(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("total"))
    return t.select("c_nationkey", "o_custkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense_rnk"))


@query("top1_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def top1_per_group(spark, sf):
    # an aggregate instead of a row number: it combines before the shuffle and sorts nothing
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return load(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query(
    "lag_delta",
    "SELECT o_orderkey, lag(o_totalprice) OVER w AS previous, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS delta FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def lag_delta(spark, sf):
    prev = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return load(spark, sf, "orders").select("o_orderkey", prev.alias("previous"), F.round(F.col("o_totalprice") - prev, 2).alias("delta"))


@query(
    "share_of_partition",
    f"SELECT c_mktsegment AS segment, c_nationkey, CAST(sum({_PRICE}) AS DOUBLE) AS total, CAST(sum({_PRICE}) AS DOUBLE) / CAST(sum(sum({_PRICE})) OVER (PARTITION BY c_mktsegment) AS DOUBLE) AS share FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2",
)
def share_of_partition(spark, sf):
    t = customer_totals(spark, sf).join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), "c_nationkey").agg(F.sum("total").alias("t"))
    whole = F.sum("t").over(Window.partitionBy("segment"))
    return t.select("segment", "c_nationkey", F.col("t").cast("double").alias("total"), (F.col("t").cast("double") / whole.cast("double")).alias("share"))


@query("ntile_tiers", f"SELECT c_nationkey, o_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY total DESC, o_custkey) AS tier FROM ({_TOTALS}) JOIN customer ON c_custkey = o_custkey")
def ntile_tiers(spark, sf):
    t = customer_totals(spark, sf).join(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return t.select("c_nationkey", "o_custkey", F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy(F.desc("total"), "o_custkey")).cast("long").alias("tier"))


@query("moving_avg_3", f"SELECT o_orderkey, CAST(sum({_PRICE}) OVER w AS DOUBLE) / count(*) OVER w AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def moving_avg_3(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return load(spark, sf, "orders").select("o_orderkey", (F.sum(money("o_totalprice")).over(w).cast("double") / F.count(F.lit(1)).over(w)).alias("moving"))


@query(
    "densest_window",
    """WITH n AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 3599999999 FOLLOWING) AS n FROM events)
    SELECT user_id, max(n) AS n, arg_min(ts, (-n, ts)) AS start FROM n GROUP BY user_id""",
)
def densest_window(spark, sf):
    return W.densest_window(load(spark, sf, "events"), ["user_id"], "ts", 3600)


@query(
    "streaks",
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS i FROM d)
    SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM g GROUP BY user_id, i""",
)
def streaks(spark, sf):
    return W.streaks(load(spark, sf, "events").withColumn("d", F.to_date("ts")), ["user_id"], "d")


@query("min_max_scaled", "SELECT p_partkey, (p_retailprice - min(p_retailprice) OVER w) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0) AS scaled FROM part WINDOW w AS (PARTITION BY p_brand)")
def min_max_scaled(spark, sf):
    return W.min_max_scaled(load(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_partkey", "scaled")


@query("first_last_gap", "SELECT o_custkey, count(*) AS n, arg_max(o_totalprice, (o_orderdate, o_orderkey)) - arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS gap FROM orders GROUP BY 1")
def first_last_gap(spark, sf):
    at = F.struct("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.max_by("o_totalprice", at) - F.min_by("o_totalprice", at)).alias("gap"))


@query(
    "conversation_turns",
    """SELECT conv_id, count(*) AS turns, CAST(sum(CAST(role = prev AS INT)) AS BIGINT) AS same_role, max(length(text)) AS longest FROM
    (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1""",
)
def conversation_turns(spark, sf):
    c = load(spark, sf, "conversations").withColumn("prev", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    same = F.sum((F.col("role") == F.col("prev")).cast("long"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), same.alias("same_role"), F.max(F.length("text")).cast("long").alias("longest"))
