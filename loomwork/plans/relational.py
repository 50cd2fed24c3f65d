"""Selections, joins, subqueries and aggregates on orders, customers, parts and suppliers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import relational as R
from ..tables import load, money

#: An order line's revenue as an exact decimal with four places.
_LINE = "CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(6,2))"


def line_amount():
    return F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount")).cast("decimal(6,2)")


def line_units():
    """The same amount in ten-thousandths, as a whole number: prices and discounts have two places."""
    return F.round(F.col("l_extendedprice") * 100).cast("long") * F.round((1 - F.col("l_discount")) * 100).cast("long")


def from_units(units):
    """The sum of sums of line_units() as a double. Whole numbers are summed for one order or one part, decimals beyond, which cannot overflow."""
    return (F.sum(F.col(units).cast("decimal(20,0)")) * F.lit(Decimal("0.0001"))).cast("double")


def revenue():
    return F.sum(line_amount()).cast("double")


@query(
    "revenue_by_month",
    f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum({_LINE}) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def revenue_by_month(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    # lines are summed by order first, so the join carries one row for each order
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(line_units()).alias("amount"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("month").agg(from_units("amount").alias("revenue"), F.count(F.lit(1)).alias("orders"))


@query(
    "aov_kpis",
    f"""SELECT CAST(sum(line) AS DOUBLE) AS revenue, count(DISTINCT l_orderkey) AS paid_orders, round(CAST(sum(line) AS DOUBLE) / count(DISTINCT l_orderkey), 2) AS aov
    FROM (SELECT l_orderkey, {_LINE} AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')""",
)
def aov_kpis(spark, sf):
    paid = load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    t = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(line_units()).alias("line")).join(paid, F.col("o_orderkey") == F.col("l_orderkey"))
    return t.agg(from_units("line").alias("revenue"), F.count("line").alias("paid_orders")).withColumn("aov", F.round(F.try_divide("revenue", "paid_orders"), 2))


@query(
    "revenue_by_segment_ranked",
    f"""SELECT c_mktsegment AS segment, CAST(sum({_LINE}) AS DOUBLE) AS revenue, rank() OVER (ORDER BY sum({_LINE}) DESC) AS rnk
    FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment""",
)
def revenue_by_segment_ranked(spark, sf):
    from pyspark.sql.window import Window

    c, o = load(spark, sf, "customer"), load(spark, sf, "orders").where("o_orderstatus = 'F'")
    by = load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum(line_amount()).alias("r"))
    return by.select("segment", F.col("r").cast("double").alias("revenue"), F.rank().over(Window.orderBy(F.desc("r"))).cast("long").alias("rnk"))


@query(
    "top_parts_by_units",
    f"""SELECT p_partkey, p_name, CAST(sum(l_quantity) AS BIGINT) AS units, CAST(sum({_LINE}) AS DOUBLE) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
    GROUP BY p_partkey, p_name ORDER BY units DESC, p_partkey LIMIT 10""",
)
def top_parts_by_units(spark, sf):
    by = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("units"), F.sum(line_units().cast("decimal(18,0)")).alias("amount"))
    p = load(spark, sf, "part").select("p_partkey", "p_name")
    return by.join(p, F.col("l_partkey") == F.col("p_partkey")).orderBy(F.desc("units"), "p_partkey").limit(10).select("p_partkey", "p_name", "units", (F.col("amount") * F.lit(Decimal("0.0001"))).cast("double").alias("revenue"))


@query(
    "top_customers_by_spend",
    f"""SELECT c_custkey, c_name, n_name, CAST(sum({_LINE}) AS DOUBLE) AS spend FROM customer JOIN nation ON n_nationkey = c_nationkey
    JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3 ORDER BY spend DESC, c_custkey LIMIT 20""",
)
def top_customers_by_spend(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    spend = load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(revenue().alias("spend"))
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return spend.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "n_name", "spend").orderBy(F.desc("spend"), "c_custkey").limit(20)


@query("status_share", "SELECT o_orderstatus AS status, count(*) AS orders, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM orders GROUP BY o_orderstatus")
def status_share(spark, sf):
    by = load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"))
    from pyspark.sql.window import Window

    total = F.sum("orders").over(Window.partitionBy(F.lit(1)))  # over one row for each status
    return by.withColumn("pct", F.round(F.lit(100.0) * F.col("orders") / total, 1))


@query("repeat_customers", "SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS paid_orders FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1, 2 HAVING paid_orders > 5")
def repeat_customers(spark, sf):
    many = load(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("paid_orders")).where("paid_orders > 5")
    return load(spark, sf, "customer").join(many, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "paid_orders")


@query("customers_without_orders", "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def customers_without_orders(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "semi_high_value_customers",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(CAST(o_totalprice AS DECIMAL(18,2))) > 2000000)",
)
def semi_high_value_customers(spark, sf):
    rich = load(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("s")).where("s > 2000000").select("o_custkey")
    return load(spark, sf, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("not_in_parts", "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def not_in_parts(spark, sf):
    return R.not_in(load(spark, sf, "part"), "p_partkey", load(spark, sf, "lineitem").where("l_quantity >= 45"), "l_partkey").select("p_partkey", "p_brand")


@query("not_in_with_null", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity < 50 THEN l_partkey END FROM lineitem)")
def not_in_with_null(spark, sf):
    values = load(spark, sf, "lineitem").select(F.when(F.col("l_quantity") < 50, F.col("l_partkey")).alias("v"))
    return R.not_in(load(spark, sf, "part"), "p_partkey", values, "v").select("p_partkey")


@query("scalar_subquery_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer")
def scalar_subquery_counts(spark, sf):
    by = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    c = load(spark, sf, "customer").select("c_custkey").join(by, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("o", F.lit(0)).alias("open_orders"))


@query(
    "exists_case_by_segment",
    """SELECT c_mktsegment AS segment, count(*) AS customers, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 1 ELSE 0 END) AS BIGINT) AS with_f,
    CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 1 ELSE 0 END) AS BIGINT) AS with_urgent FROM customer GROUP BY 1""",
)
def exists_case_by_segment(spark, sf):
    flags = load(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    c = load(spark, sf, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"), F.count_if("f").alias("with_f"), F.count_if("u").alias("with_urgent"))


@query(
    "bool_sum_punctuality",
    """SELECT l_suppkey, CAST(sum(CAST(l_shipdate <= o_orderdate + INTERVAL 30 DAY AS INT)) AS BIGINT) AS on_time, CAST(sum(CAST(l_shipdate > o_orderdate + INTERVAL 30 DAY AS INT)) AS BIGINT) AS late,
    CAST(sum(CAST(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AS INT)) AS BIGINT) AS large FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def bool_sum_punctuality(spark, sf):
    large = load(spark, sf, "part").where("p_size > 40").select("p_partkey", F.lit(True).alias("large"))
    t = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(large, F.col("l_partkey") == F.col("p_partkey"), "left")
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")
    return t.groupBy("l_suppkey").agg(F.count_if(~late).alias("on_time"), F.count_if(late).alias("late"), F.count_if("large").alias("large"))


@query("left_join_zero_clicks", "SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2")
def left_join_zero_clicks(spark, sf):
    recent = load(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '1997-01-01 00:00:00'")
    return R.counted_left(load(spark, sf, "customer").select("c_custkey", "c_name"), recent, "c_custkey", "o_custkey", "orders")


@query(
    "fan_out_distinct",
    """SELECT p_partkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) + count(DISTINCT l_suppkey) AS engagement,
    rank() OVER (ORDER BY count(DISTINCT l_orderkey) + count(DISTINCT l_suppkey) DESC) AS rnk FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
)
def fan_out_distinct(spark, sf):
    from pyspark.sql.window import Window

    p = load(spark, sf, "part").select("p_partkey").distinct()
    lines = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))
    t = p.join(lines, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("orders", "suppliers")])
    t = t.withColumn("engagement", F.col("orders") + F.col("suppliers"))
    # a rank is one more than all parts with more engagement; the window is over different numbers, not over parts
    n = t.groupBy("engagement").agg(F.count(F.lit(1)).alias("_n"))
    ranks = n.select("engagement", (F.sum("_n").over(Window.orderBy(F.desc("engagement"))) - F.col("_n") + 1).alias("rnk"))
    return t.join(ranks, "engagement").select("p_partkey", "orders", "suppliers", "engagement", "rnk")


_EDGES = "SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events"


def user_edges(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    return load(spark, sf, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))


@query("reciprocal_pairs", f"WITH e AS (SELECT DISTINCT src, dst FROM ({_EDGES}) WHERE src <> dst) SELECT e.src AS a, e.dst AS b FROM e JOIN e f ON e.src = f.dst AND e.dst = f.src WHERE e.src < e.dst")
def reciprocal_pairs(spark, sf):
    return R.reciprocal_pairs(user_edges(spark, sf).where("dst is not null"), "src", "dst")


@query(
    "supplier_hierarchy_self_join",
    """SELECT m.s_suppkey AS manager, m.s_name AS manager_name, count(e.s_suppkey) AS reports, CAST(sum(CAST(e.s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM supplier m JOIN supplier e ON e.s_suppkey <> m.s_suppkey AND e.s_suppkey // 10 = m.s_suppkey GROUP BY 1, 2""",
)
def supplier_hierarchy_self_join(spark, sf):
    s = load(spark, sf, "supplier")
    e = s.select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 10).cast("long").alias("boss"), money("s_acctbal").alias("b")).where("k <> boss")
    by = e.groupBy("boss").agg(F.count("k").alias("reports"), F.sum("b").cast("double").alias("balance"))
    return by.join(s, F.col("boss") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("manager"), F.col("s_name").alias("manager_name"), "reports", "balance")


@query(
    "five_way_view",
    f"""SELECT r_name, n_name, c_mktsegment AS segment, count(*) AS n_lines, CAST(sum({_LINE}) AS DOUBLE) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
)
def five_way_view(spark, sf):
    places = load(spark, sf, "region").join(load(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name", "n_name")
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(line_amount()).alias("r"), F.count(F.lit(1)).alias("n"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    by = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name", F.col("c_mktsegment").alias("segment"))
    return by.agg(F.sum("n").alias("n_lines"), F.sum("r").cast("double").alias("revenue"))


_SCD = "SELECT o_custkey, d AS valid_from, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) - 1 AS valid_to, price FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)"


def order_versions(spark, sf):
    o = load(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("price"))
    return R.open_intervals(o, ["o_custkey"], "d", "price")


@query(
    "scd2_asof",
    f"""WITH v AS ({_SCD}), f AS (SELECT c_custkey AS o_custkey, CAST(d AS DATE) AS at FROM customer, (SELECT unnest(['1994-06-30', '1996-06-30', '1998-01-31']) AS d))
    SELECT f.o_custkey, f.at, v.valid_from, v.valid_to, v.price FROM f LEFT JOIN v ON v.o_custkey = f.o_custkey AND f.at >= v.valid_from AND (v.valid_to IS NULL OR f.at <= v.valid_to)""",
)
def scd2_asof(spark, sf):
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in ("1994-06-30", "1996-06-30", "1998-01-31")]))
    facts = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), days.alias("at"))
    return R.as_of(facts, order_versions(spark, sf), ["o_custkey"], "at")


@query(
    "current_vs_closed",
    f"""WITH v AS ({_SCD}) SELECT c.o_custkey, o.valid_from AS old_from, o.price AS previous, c.price AS current_price, round(100 * (c.price - o.price) / o.price, 1) AS pct
    FROM v c JOIN v o ON o.o_custkey = c.o_custkey AND o.valid_to IS NOT NULL WHERE c.valid_to IS NULL""",
)
def current_vs_closed(spark, sf):
    v = order_versions(spark, sf)
    cur = v.where("valid_to is null").select("o_custkey", F.col("price").alias("current_price"))
    old = v.where("valid_to is not null").select("o_custkey", F.col("valid_from").alias("old_from"), F.col("price").alias("previous"))
    return old.join(cur, "o_custkey").withColumn("pct", F.round(100 * (F.col("current_price") - F.col("previous")) / F.col("previous"), 1))


@query("dedupe_keep_first", "SELECT text, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_keep_first(spark, sf):
    return R.keep_first(load(spark, sf, "documents").select("text", "doc_id", "lang"), ["text"], ["doc_id"])


@query("normalise_decompose", "SELECT CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra")
def normalise_decompose(spark, sf):
    flat = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flat = flat.select("c_custkey", "c_name", "n_nationkey", "n_name", "r_regionkey", "r_name")
    parts = R.decompose(flat, {"c": ["c_custkey", "c_name", "n_nationkey"], "n": ["n_nationkey", "n_name", "r_regionkey"], "r": ["r_regionkey", "r_name"]})
    return R.lossless(flat, parts["c"].join(parts["n"], "n_nationkey").join(parts["r"], "r_regionkey"))


@query("fd_violations", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_values FROM customer GROUP BY 1 HAVING n_values > 1")
def fd_violations(spark, sf):
    return R.fd_violations(load(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@query(
    "rollup_segments",
    """SELECT coalesce(c_mktsegment, 'All') AS segment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment)""",
)
def rollup_segments(spark, sf):
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("t"))
    t = load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).withColumnRenamed("c_mktsegment", "segment")
    return R.with_total(t, ["segment"], [F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"), F.sum("t").cast("double").alias("total")])


@query("orders_in_a_quarter", "SELECT count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '1996-04-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def orders_in_a_quarter(spark, sf):
    return load(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '1996-04-01 00:00:00' and o_orderdate < timestamp_ntz '1996-07-01 00:00:00'").agg(F.count(F.lit(1)).alias("orders"))


@query("one_customers_orders", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey = 42")
def one_customers_orders(spark, sf):
    return load(spark, sf, "orders").where("o_custkey = 42").select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("all_open_orders", "SELECT count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'O'")
def all_open_orders(spark, sf):
    return load(spark, sf, "orders").where("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("optional_filters", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%')")
def optional_filters(spark, sf):
    return R.optional_filters(load(spark, sf, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": None}, {("c_name", "c_mktsegment"): "1"}).select("c_custkey", "c_name")


@query(
    "group_stats",
    """SELECT p_brand, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi, round(avg(p_size), 4) AS mean, median(p_size) AS med, min_by(p_partkey, p_size * 1000000 + p_partkey) AS smallest
    FROM part GROUP BY 1""",
)
def group_stats(spark, sf):
    p = load(spark, sf, "part")
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.round(F.avg("p_size"), 4).alias("mean"), F.median("p_size").alias("med"), F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("smallest"))


@query(
    "excel_kpis",
    """SELECT count(o_totalprice) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS average, max(o_totalprice) AS highest, min(o_totalprice) AS lowest,
    count(*) FILTER (o_orderstatus = 'O') AS open_orders, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O'), 0) AS DOUBLE) AS open_total FROM orders""",
)
def excel_kpis(spark, sf):
    price = money("o_totalprice")
    t = load(spark, sf, "orders").agg(F.count("o_totalprice").alias("n"), F.sum(price).cast("double").alias("total"), F.max("o_totalprice").alias("highest"), F.min("o_totalprice").alias("lowest"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "O", price)), F.lit(0)).cast("double").alias("open_total"))
    return t.withColumn("average", F.round(F.try_divide("total", "n"), 2))


@query("update_anomaly", "SELECT c_nationkey, count(DISTINCT n_name) AS before, count(DISTINCT CASE WHEN c_custkey % 100 = 1 THEN 'renamed' ELSE n_name END) AS after FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def update_anomaly(spark, sf):
    flat = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.update_anomaly(flat, "c_nationkey", "n_name", F.col("c_custkey") % 100 == 1, F.lit("renamed"))


@query("delete_anomaly", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'R') = 0")
def delete_anomaly(spark, sf):
    return R.delete_anomaly(load(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@query("insert_anomaly", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def insert_anomaly(spark, sf):
    return R.insert_anomaly(load(spark, sf, "customer").select("c_custkey", "c_name"), load(spark, sf, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
