"""Funnels, first responses, cash flow, shares, bins and other profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..operators import journeys as J
from ..tables import load, money

STAGES = ["view", "click", "signup", "purchase"]
_STAGES = "(VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')) s(position, stage)"


@query(
    "funnel_ever",
    f"""WITH c AS (SELECT s.position, s.stage, count(DISTINCT user_id) AS n FROM {_STAGES} LEFT JOIN events ON event_type = s.stage GROUP BY 1, 2)
    SELECT stage, n, n / nullif(lag(n) OVER (ORDER BY position), 0) AS from_prev, n / nullif(first(n) OVER (ORDER BY position), 0) AS from_top FROM c""",
)
def funnel_ever(spark, sf):
    return J.funnel(load(spark, sf, "events"), "user_id", "event_type", STAGES)


@query("funnel_naive", f"SELECT s.stage, count(user_id) AS n FROM {_STAGES} LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1) e ON e.stage = s.stage GROUP BY 1")
def funnel_naive(spark, sf):
    return J.funnel_now(load(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], STAGES)


@query(
    "ghost_rate",
    """WITH f AS (SELECT user_id, CAST(min(ts) AS DATE) AS started FROM events GROUP BY 1), a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
    SELECT count(*) FILTER (o) AS eligible, count(*) FILTER (o AND a.user_id IS NULL) AS silent, count(*) FILTER (NOT o) AS too_recent, count(*) FILTER (o AND a.user_id IS NULL) / nullif(count(*) FILTER (o), 0) AS rate
    FROM (SELECT *, DATE '2024-01-31' - started >= 30 AS o FROM f) f LEFT JOIN a ON a.user_id = f.user_id""",
)
def ghost_rate(spark, sf):
    e = load(spark, sf, "events")
    return J.silent_rate(e.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("started")), e.where("event_type = 'purchase'"), "user_id", "user_id", "started", "2024-01-31", 30)


_FIRST = """WITH v AS (SELECT user_id, min(epoch_us(ts)) AS v FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT user_id, min(epoch_us(ts)) AS p FROM events WHERE event_type = 'purchase' GROUP BY 1),
    d AS (SELECT (p - v) // 60000000 AS m FROM v JOIN p USING (user_id) WHERE p >= v)"""


def first_minutes(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, sf, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "view", us)).alias("v"), F.min(F.when(F.col("event_type") == "purchase", us)).alias("p"))
    return e.where("p >= v").select(F.floor((F.col("p") - F.col("v")) / 60_000_000).cast("long").alias("m"))


@query("first_response", _FIRST + " SELECT count(*) AS n, median(m) AS median_minutes, avg(m) AS mean_minutes, list_sort(list(m))[1 + CAST(round_even(0.9 * (count(*) - 1), 0) AS INT)] AS p90_minutes FROM d")
def first_response(spark, sf):
    d = first_minutes(spark, sf)
    p90 = J.ranked_percentile(d, "m", 0.9).select(F.col("m").alias("p90_minutes"))
    return d.agg(F.count("m").alias("n"), F.median("m").alias("median_minutes"), F.avg("m").alias("mean_minutes")).join(p90, how="left")


@query(
    "by_source",
    """SELECT props_k, count(*) AS users, CAST(sum(CAST(c AS INT)) AS BIGINT) AS clicked, CAST(sum(CAST(p AS INT)) AS BIGINT) AS bought FROM (SELECT user_id, arg_min(CAST(json_extract_string(props, '$.k') AS INT) % 5, (ts, event_id)) AS props_k, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM events GROUP BY 1) GROUP BY 1""",
)
def by_source(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    u = load(spark, sf, "events").withColumn("k", k).groupBy("user_id").agg(F.min_by("k", F.struct("ts", "event_id")).alias("props_k"), F.bool_or(F.col("event_type") == "click").alias("c"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    return u.groupBy("props_k").agg(F.count(F.lit(1)).alias("users"), F.count_if("c").alias("clicked"), F.count_if("p").alias("bought"))


@query("clicks_by_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'click' GROUP BY 1")
def clicks_by_day(spark, sf):
    return load(spark, sf, "events").where("event_type = 'click'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("referrer_default", "SELECT coalesce(nullif(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0 THEN '' WHEN CAST(json_extract_string(props, '$.k') AS INT) % 3 = 1 THEN 'mail' END, ''), 'direct') AS referrer, count(*) AS n FROM events GROUP BY 1")
def referrer_default(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    raw = F.when(k == 0, "").when(k == 1, "mail")
    return load(spark, sf, "events").groupBy(F.coalesce(F.nullif(raw, F.lit("")), F.lit("direct")).alias("referrer")).agg(F.count(F.lit(1)).alias("n"))


_SIGNED = "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS category, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders"


def signed(spark, sf):
    a = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1) * money("o_totalprice")
    return load(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("category"), a.cast("decimal(18,2)").alias("amount"))


@query(
    "cashflow",
    f"""SELECT month, CAST(income AS DOUBLE) AS income, CAST(expense AS DOUBLE) AS expense, CAST(income - expense AS DOUBLE) AS net, round(100 * CAST(income - expense AS DOUBLE) / nullif(CAST(income AS DOUBLE), 0), 2) AS savings_rate
    FROM (SELECT month, coalesce(sum(amount) FILTER (amount > 0), 0) AS income, -coalesce(sum(amount) FILTER (amount <= 0), 0) AS expense FROM ({_SIGNED}) GROUP BY month)""",
)
def cashflow(spark, sf):
    a = F.col("amount")
    t = signed(spark, sf).groupBy("month").agg(F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0)).alias("i"), (-F.coalesce(F.sum(F.when(a <= 0, a)), F.lit(0))).alias("e"))
    i, net = F.col("i").cast("double"), (F.col("i") - F.col("e")).cast("double")
    return t.select("month", i.alias("income"), F.col("e").cast("double").alias("expense"), net.alias("net"), F.round(F.try_divide(100 * net, i), 2).alias("savings_rate"))


@query("expense_by_category", f"SELECT category, CAST(-sum(amount) AS DOUBLE) AS spent, CASE WHEN -sum(amount) > 200000000 THEN 'over' WHEN -sum(amount) > 150000000 THEN 'near' ELSE 'under' END AS status FROM ({_SIGNED}) WHERE amount <= 0 GROUP BY 1")
def expense_by_category(spark, sf):
    t = signed(spark, sf).where("amount <= 0").groupBy("category").agg((-F.sum("amount")).alias("s"))
    return t.select("category", F.col("s").cast("double").alias("spent"), F.when(F.col("s") > 200_000_000, "over").when(F.col("s") > 150_000_000, "near").otherwise("under").alias("status"))


@query("pearson_log", "SELECT l_returnflag, round(corr(log10(l_extendedprice), log10(l_quantity)), 9) AS r FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def pearson_log(spark, sf):
    return load(spark, sf, "lineitem").where("l_quantity > 0 and l_extendedprice > 0").groupBy("l_returnflag").agg(F.round(F.corr(F.log10("l_extendedprice"), F.log10("l_quantity")), 9).alias("r"))


@query(
    "weighted_mean",
    """SELECT coalesce(p_brand, 'All') AS brand, CAST(sum(CAST(p_retailprice AS DECIMAL(12,2)) * p_size) AS DOUBLE) / sum(p_size) AS mean_price FROM part GROUP BY ROLLUP (p_brand)""",
)
def weighted_mean(spark, sf):
    from ..operators.relational import with_total

    p = load(spark, sf, "part").withColumn("brand", F.col("p_brand"))
    m = F.sum(F.col("p_retailprice").cast("decimal(12,2)") * F.col("p_size")).cast("double") / F.sum("p_size")
    return with_total(p, ["brand"], [m.alias("mean_price")])


@query(
    "quantile_bins",
    """WITH s AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
    c AS (SELECT list(c_acctbal) AS cuts FROM s WHERE i IN (n // 6, 2 * n // 6, 3 * n // 6, 4 * n // 6, 5 * n // 6)) SELECT c_custkey, CAST(len(list_filter(cuts, lambda x: x <= c_acctbal)) AS BIGINT) AS bin FROM s, c""",
)
def quantile_bins(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return c.crossJoin(F.broadcast(cut_points(c, "c_acctbal", 6))).select("c_custkey", F.size(F.filter("cuts", lambda x: x <= F.col("c_acctbal"))).cast("long").alias("bin"))


def cut_points(df, value, bins):
    """One row with the sorted values at the indices floor(i * n / bins), found over counts of distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))
    up = c.withColumn("up", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w)).select("v", "n", "up", F.explode(F.array(*[F.floor(i * F.col("all") / bins) for i in range(1, bins)])).alias("at"))
    return up.where("up > at and up - n <= at").agg(F.sort_array(F.collect_list("v")).alias("cuts"))


@query(
    "histogram_hours",
    """SELECT h.h AS hour, count(event_id) AS n, count(event_id) / (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS per_day FROM (SELECT unnest(range(24)) AS h) h LEFT JOIN events ON hour(ts) = h.h GROUP BY 1""",
)
def histogram_hours(spark, sf):
    e = load(spark, sf, "events")
    n = e.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    days = e.agg(F.count_distinct(F.to_date("ts")).alias("days"))
    t = spark.range(24).withColumnRenamed("id", "hour").join(n, "hour", "left").crossJoin(F.broadcast(days))
    return t.select("hour", F.coalesce("c", F.lit(0)).alias("n"), (F.coalesce("c", F.lit(0)) / F.col("days")).alias("per_day"))


@query("histogram_bins", "SELECT CAST(floor(l_quantity / 2) * 2 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_bins(spark, sf):
    return load(spark, sf, "lineitem").groupBy((F.floor(F.col("l_quantity") / 2) * 2).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_CONF = "CASE WHEN n_chars >= 2000 THEN 0.9 WHEN n_chars >= 500 THEN 0.7 ELSE 0.5 END"


@query(
    "calibration_brier",
    f"SELECT conf AS confidence, count(*) AS n, round(avg(quality), 6) AS accuracy, round(avg((conf - quality) * (conf - quality)), 6) AS brier FROM (SELECT CAST({_CONF} AS DOUBLE) AS conf, quality FROM labels JOIN documents USING (doc_id)) GROUP BY 1",
)
def calibration_brier(spark, sf):
    conf = F.when(F.col("n_chars") >= 2000, 0.9).when(F.col("n_chars") >= 500, 0.7).otherwise(0.5)
    t = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("c", conf)
    return t.groupBy(F.col("c").alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg((F.col("c") - F.col("quality")) ** 2), 6).alias("brier"))


@query(
    "wide_funnel",
    """WITH t AS (SELECT c_mktsegment AS channel, count(DISTINCT c_custkey) AS visitors, count(DISTINCT o_custkey) AS leads, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O') AS qualified, count(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT') AS won FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT *, round(100 * leads / visitors, 2) AS r1, round(100 * qualified / leads, 2) AS r2, round(100 * won / qualified, 2) AS r3,
    CASE WHEN leads / visitors <= least(qualified / leads, won / qualified) THEN 'leads' WHEN qualified / leads <= won / qualified THEN 'qualified' ELSE 'won' END AS worst FROM t""",
)
def wide_funnel(spark, sf):
    flags = load(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("q"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("w"))
    t = load(spark, sf, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_mktsegment").alias("channel"))
    t = t.agg(F.count(F.lit(1)).alias("visitors"), F.count("o_custkey").alias("leads"), F.count_if("q").alias("qualified"), F.count_if("w").alias("won"))
    steps = [("leads", "visitors"), ("qualified", "leads"), ("won", "qualified")]
    rates = [F.try_divide(a, b) for a, b in steps]
    worst = F.array_min(F.array(*[F.struct(r.alias("r"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, (r, (s, _)) in enumerate(zip(rates, steps, strict=True))]))
    return t.select("*", *[F.round(F.try_divide(100 * F.col(a), b), 2).alias(f"r{i + 1}") for i, (a, b) in enumerate(steps)], worst["s"].alias("worst"))


@query(
    "channel_shares",
    """WITH t AS (SELECT c_mktsegment AS channel, count(DISTINCT c_custkey) AS n, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT channel, n / sum(n) OVER () AS traffic_share, CAST(r AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE) AS revenue_share FROM t""",
)
def channel_shares(spark, sf):
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("s"))
    t = load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_mktsegment").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("r"))
    w = Window.partitionBy(F.lit(1))  # one row for each segment
    return t.select("channel", (F.col("n") / F.sum("n").over(w)).alias("traffic_share"), (F.col("r").cast("double") / F.sum("r").over(w).cast("double")).alias("revenue_share"))


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total_k, max(CAST(json_extract_string(props, '$.k') AS INT)) AS max_k FROM events GROUP BY 1")
def json_props(spark, sf):
    e = load(spark, sf, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total_k"), F.max("p.k").alias("max_k"))


@query(
    "session_summary",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, max(ts) - min(ts) AS len, count(*) AS n, hour(min(ts)) AS h FROM events GROUP BY 1, 2)
    SELECT h AS start_hour, count(*) AS sessions, CAST(sum(CAST(n >= 3 AS INT)) AS BIGINT) AS long_sessions, CAST(sum(epoch_us(TIMESTAMP '1970-01-01' + len)) // 60000000 AS BIGINT) AS minutes FROM s GROUP BY 1""",
)
def session_summary(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg((F.max(us) - F.min(us)).alias("len"), F.count(F.lit(1)).alias("n"), F.hour(F.min("ts")).cast("long").alias("start_hour"))
    return s.groupBy("start_hour").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("n") >= 3).alias("long_sessions"), F.floor(F.sum("len") / 60_000_000).cast("long").alias("minutes"))


@query("tenure_months", "SELECT c_custkey, (year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) OR (day(b) = day(a) AND CAST(b AS TIME) < CAST(a AS TIME)) THEN 1 ELSE 0 END AS months FROM (SELECT o_custkey AS c_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)")
def tenure_months(spark, sf):
    t = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return t.select("c_custkey", F.expr("timestampdiff(MONTH, a, b)").alias("months"))
