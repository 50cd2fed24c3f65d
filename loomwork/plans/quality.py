"""The quality gate on a damaged copy of orders, and the cleaning pipeline on trips derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import cleaning as C
from ..operators import quality as Q
from ..tables import load

#: orders as text cells with damage at fixed keys, in both dialects.
_PRICE = """CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 89 = 0 THEN '-5' WHEN o_orderkey % 101 = 0 THEN '$1,000.50' WHEN o_orderkey % 103 = 0 THEN '12x' WHEN o_orderkey % 107 = 0 THEN '1d' ELSE '100.25' END"""
_STATUS = """CASE WHEN o_orderkey % 83 = 0 THEN concat(' ', o_orderstatus) WHEN o_orderkey % 79 = 0 THEN 'x' WHEN o_orderkey % 73 = 0 THEN '-' ELSE lower(o_orderstatus) END"""
_CODE = "concat(CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 400 AS STRING))"
_FROM = "CASE WHEN o_orderkey % 3 = 0 THEN '2024-02-03 04:05:06' WHEN o_orderkey % 3 = 1 THEN '2/4/2024' ELSE '05-Feb-2024 10:00' END"
_TO = "CASE WHEN o_orderkey % 71 = 0 THEN '2024-02-01' WHEN o_orderkey % 67 = 0 THEN 'soon' ELSE '2024-02-06' END"

RULES = Q.suite(
    [
        {"id": "price_given", "kind": "not_null", "column": "price"},
        {"id": "price_positive", "kind": "range", "column": "price", "min": 0, "max": 100000},
        {"id": "price_number", "kind": "is_type", "column": "price", "type": "number"},
        {"id": "price_whole", "kind": "is_type", "column": "price", "type": "int", "severity": "warn"},
        {"id": "status_known", "kind": "in_set", "column": "status", "allowed": ["F", "O", "P"]},
        {"id": "status_padding", "kind": "no_padding", "column": "status", "severity": "warn"},
        {"id": "code_shape", "kind": "matches", "column": "code", "pattern": "[0-9]+-[0-9]{1,2}"},
        {"id": "code_unique", "kind": "unique", "columns": ["code", "status"]},
        {"id": "from_before_to", "kind": "compare", "columns": ["start", "stop"], "op": "<"},
        {"id": "customer_known", "kind": "foreign_key", "column": "customer", "ref": "customers", "ref_column": "id"},
        {"id": "rows_enough", "kind": "row_count", "min": 10},
        {"id": "price_total", "kind": "control_total", "column": "price", "stat": "mean", "expected": 100, "tolerance": 0.01},
        {"id": "has_columns", "kind": "columns_exist", "columns": ["price", "colour"], "severity": "warn"},
    ]
)


def messy(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey AS row_id", f"{_PRICE} AS price", f"{_STATUS} AS status", f"{_CODE} AS code", f"{_FROM} AS start", f"{_TO} AS stop", "CAST(o_custkey AS STRING) AS customer")


def references(spark, sf):
    """Customers as a reference that lacks some, so that the rule has something to find."""
    return {"customers": load(spark, sf, "customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").cast("string").alias("id"))}


_MESSY = f"SELECT o_orderkey AS row_id, {_PRICE} AS price, {_STATUS} AS status, {_CODE} AS code, {_FROM} AS start, {_TO} AS stop, CAST(o_custkey AS VARCHAR) AS customer FROM orders"
_NULLISH = "trim(lower({0})) IN ('', 'na', 'n/a', 'null', 'none', 'nan', '-', '--')"
_NUM = "TRY_CAST(replace(replace(replace(price, ',', ''), '$', ''), '%', '') AS DOUBLE)"
_FOUND = f"""m AS ({_MESSY}), v AS (
  SELECT 'price_given' AS rule, row_id FROM m WHERE {_NULLISH.format('price')}
  UNION ALL SELECT 'price_positive', row_id FROM m WHERE NOT {_NULLISH.format('price')} AND ({_NUM} IS NULL OR {_NUM} < 0 OR {_NUM} > 100000)
  UNION ALL SELECT 'price_number', row_id FROM m WHERE NOT {_NULLISH.format('price')} AND {_NUM} IS NULL
  UNION ALL SELECT 'price_whole', row_id FROM m WHERE NOT {_NULLISH.format('price')} AND ({_NUM} IS NULL OR {_NUM} <> floor({_NUM}))
  UNION ALL SELECT 'status_known', row_id FROM m WHERE NOT {_NULLISH.format('status')} AND lower(trim(status)) NOT IN ('f', 'o', 'p')
  UNION ALL SELECT 'status_padding', row_id FROM m WHERE status <> trim(status)
  UNION ALL SELECT 'code_shape', row_id FROM m WHERE NOT regexp_full_match(code, '[0-9]+-[0-9]{{1,2}}')
  UNION ALL SELECT 'code_unique', row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY trim(code), trim(status) ORDER BY row_id) AS n FROM m) WHERE n > 1
  UNION ALL SELECT 'from_before_to', row_id FROM m WHERE stop IN ('2024-02-01', 'soon')
  UNION ALL SELECT 'customer_known', row_id FROM m WHERE customer NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 50 <> 0)
  UNION ALL SELECT 'price_total', NULL FROM (SELECT avg({_NUM}) AS a FROM m WHERE NOT {_NULLISH.format('price')}) WHERE abs(a - 100) > 1
  UNION ALL SELECT 'has_columns', NULL)"""
_IDS = ", ".join(f"('{r.id}', '{r.severity}')" for r in RULES)


@query("dq_violations", f"WITH {_FOUND.replace('STRING', 'VARCHAR')} SELECT r.rule, r.severity, count(v.rule) AS violations FROM (VALUES {_IDS}) r(rule, severity) LEFT JOIN v ON v.rule = r.rule GROUP BY 1, 2")
def dq_violations(spark, sf):
    return Q.counts(messy(spark, sf), RULES, refs=references(spark, sf))


_ERRORS = ", ".join(f"'{r.id}'" for r in RULES if r.severity == Q.ERROR)


@query("dq_split", f"WITH {_FOUND.replace('STRING', 'VARCHAR')} SELECT row_id, code FROM m WHERE row_id NOT IN (SELECT row_id FROM v WHERE row_id IS NOT NULL AND rule IN ({_ERRORS}))")
def dq_split(spark, sf):
    return Q.split(messy(spark, sf), RULES, refs=references(spark, sf))[0].select("row_id", "code")


@query("dq_fk", "SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS value, 'no matching reference row' AS detail FROM orders WHERE o_custkey % 50 = 0")
def dq_fk(spark, sf):
    return Q.violations(messy(spark, sf), [r for r in RULES if r.kind == "foreign_key"], refs=references(spark, sf)).select("row_id", "value", "detail")


@query("dq_control_total", f"WITH m AS ({_MESSY.replace('STRING', 'VARCHAR')}) SELECT 'price_total' AS rule, CAST(count(*) AS BIGINT) AS violations FROM (SELECT avg({_NUM}) AS a FROM m WHERE price <> 'n/a') WHERE abs(a - 100) > 1")
def dq_control_total(spark, sf):
    return Q.counts(messy(spark, sf), [r for r in RULES if r.kind == "control_total"]).select("rule", "violations")


@query("dq_audit")
def dq_audit(spark, sf):
    """Which mutations of the damaged orders the error rules notice; the rows that are changed hang on hashes."""
    return Q.audit(messy(spark, sf), RULES, Q.default_mutations(messy(spark, sf)), refs=references(spark, sf))


@query("dq_report", f"WITH {_FOUND.replace('STRING', 'VARCHAR')} SELECT r.rule, count(v.rule) AS violations, count(v.rule) / (SELECT count(*) FROM m) AS rate, least(count(v.rule), 5) AS shown FROM (VALUES {_IDS}) r(rule, severity) LEFT JOIN v ON v.rule = r.rule GROUP BY 1")
def dq_report(spark, sf):
    r = Q.report(messy(spark, sf), RULES, refs=references(spark, sf))
    return r.select("rule", "violations", "rate", F.coalesce(F.size("examples"), F.lit(0)).cast("long").alias("shown"))


def trips(spark, sf):
    """Trips as an export would have them: text only, three date layouts, repeated ids, odd names, missing values."""
    k = F.col("event_id")
    stop = F.col("ts") + F.make_dt_interval(mins=(k % 1500 - 20).cast("int"))
    start = F.when(k % 31 == 0, F.lit("bad")).when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k % 3 == 1, F.date_format("ts", "MM/dd/yyyy HH:mm")).otherwise(F.date_format("ts", "dd-MMM-yyyy HH:mm"))
    return load(spark, sf, "events").select(
        k.alias("row_id"),
        F.when(k % 40 == 0, k - 1).otherwise(k).cast("string").alias("ride_id"),
        start.alias("started_at"),
        F.date_format(stop, "yyyy-MM-dd HH:mm:ss").alias("ended_at"),
        F.when(k % 2 == 0, "  main   st. ").when(k % 5 == 0, "MARTA pk").otherwise("o'hare pk").alias("start_station"),
        F.when(k % 17 == 0, "").otherwise("marta main").alias("end_station"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 4 == 0, "casual").otherwise("member").alias("user_type"),
    )


_TRIPS = """t AS (SELECT event_id AS k, CASE WHEN event_id % 40 = 0 THEN event_id - 1 ELSE event_id END AS ride_id,
    CASE WHEN event_id % 31 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END END AS a, date_trunc('second', ts + to_minutes(event_id % 1500 - 20)) AS b,
    event_id % 17 = 0 AS no_end, event_id % 23 = 0 AS no_user FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY k) > 1 AS again, epoch(b) / 60 - epoch(a) / 60 AS m, epoch(b) - epoch(a) AS s FROM t),
    g AS (SELECT *, CASE WHEN again THEN 'duplicate ride_id' WHEN a IS NULL THEN 'unparseable timestamps' WHEN s < 0 THEN 'negative duration' WHEN s < 60 THEN 'under a minute' WHEN s > 86400 THEN 'over 24 hours' END AS w FROM d)"""


@query(
    "clean_audit",
    f"""WITH {_TRIPS} SELECT 'rows read' AS step, count(*) AS n FROM g UNION ALL SELECT x, (SELECT count(*) FROM g WHERE w = x) FROM (VALUES ('duplicate ride_id'), ('unparseable timestamps'), ('negative duration'), ('under a minute'), ('over 24 hours')) v(x)
    UNION ALL SELECT 'end stations labelled', count(*) FROM g WHERE w IS NULL AND no_end UNION ALL SELECT 'user types labelled', count(*) FROM g WHERE w IS NULL AND no_user UNION ALL SELECT 'rows kept', count(*) FROM g WHERE w IS NULL""",
)
def clean_audit(spark, sf):
    return C.audit(C.tagged(trips(spark, sf)))


@query(
    "clean_trips",
    f"""WITH {_TRIPS} SELECT k AS row_id, CASE WHEN k % 2 = 0 THEN 'Main Street' WHEN k % 5 = 0 THEN 'MARTA Park' ELSE 'O''Hare Park' END AS start_station, CASE WHEN no_end THEN 'Unknown' ELSE 'MARTA Main' END AS end_station,
    CASE WHEN no_user THEN 'unknown' WHEN k % 4 = 0 THEN 'casual' ELSE 'member' END AS user_type, CAST(hour(a) AS BIGINT) AS hour, CAST((dayofweek(a) + 6) % 7 AS BIGINT) AS dow, s AS seconds FROM (SELECT *, CAST(s AS BIGINT) AS s FROM (SELECT * EXCLUDE s, CAST(s AS BIGINT) AS s FROM g)) WHERE w IS NULL""",
)
def clean_trips(spark, sf):
    t = C.kept(C.tagged(trips(spark, sf)))
    return t.select("row_id", "start_station", "end_station", "user_type", F.col("hour").cast("long").alias("hour"), F.col("dow").cast("long").alias("dow"), F.round(F.col("duration_min") * 60).cast("long").alias("seconds"))


@query("trip_findings")
def trip_findings(spark, sf):
    return C.findings(C.kept(C.tagged(trips(spark, sf))))
