"""Sources and scalar functions: CSV grammar, JSON, regular expressions, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import query
from ..functions import links as K
from ..functions import nfa as N
from ..functions import parsing as P
from ..functions import stats as S
from ..sources import json_text as J
from ..sources.csv_text import export_expenses, failure_cause, import_expenses, naive, parse, positional
from ..tables import load

#: Whole CSV texts and the number of their rows and fields.
CSV_TEXTS = ['a,b\n1,"x,y"\n', 'a\r\n"q""q"\r\n', '"ab"c,d', 'a\n\nb', '"line\nbreak",2\n', "a,,\n", '""', "", '"open,\nend', "\ufeffh,i\rj,k"]


@query("csv_grammar")
def csv_grammar(spark, sf):
    """Rows of awkward CSV texts, one text in a cell."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def rows(x):
        import pyarrow as pa

        return pa.array([list(parse(t)) for t in x.to_pylist()], pa.list_(pa.list_(pa.string())))

    t = spark.createDataFrame(list(enumerate(CSV_TEXTS)), "id int, text string")
    return t.select("id", F.posexplode(rows("text")).alias("row", "fields"))


@query("json_parallel_arrays", "SELECT event_id, i - 1 AS position, 'h' || CAST(i - 1 AS VARCHAR) AS time, CAST(event_id % 10 + i - 1 AS DOUBLE) AS temperature_2m FROM events, range(1, 4) r(i) WHERE i >= 2")
def json_parallel_arrays(spark, sf):
    e = load(spark, sf, "events")
    body = F.to_json(F.struct(F.struct(F.array(*[F.lit(f"h{i}") for i in range(3)]).alias("time"), F.array(*[(F.col("event_id") % 10 + i).cast("double") for i in range(3)]).alias("temperature_2m")).alias("hourly")))
    z = J.zipped(J.parsed(e.select("event_id", body.alias("j")), "j"), ["event_id"], "j.hourly", ["time", "temperature_2m"], since=F.lit("h1"))
    return z.select("event_id", F.substring("time", 2, 9).cast("long").alias("position"), "time", "temperature_2m")


@query("code_lookup", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'mainly clear' WHEN 2 THEN 'partly cloudy' WHEN 3 THEN 'overcast' WHEN 45 THEN 'fog' WHEN 48 THEN 'rime fog' ELSE 'unknown' END AS text FROM part")
def code_lookup(spark, sf):
    return load(spark, sf, "part").select("p_partkey", J.code_text(F.col("p_size")).alias("text"))


@query("regex_nfa", "SELECT p_partkey, regexp_full_match(p_name, '[a-m].*(e|o)[n-z]?') AS hit FROM part")
def regex_nfa(spark, sf):
    return load(spark, sf, "part").select("p_partkey", N.full_match(F.col("p_name"), "[a-m].*(e|o)[n-z]?").alias("hit"))


@query("number_parsing", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN NULL WHEN 2 THEN 12.0 WHEN 3 THEN NULL WHEN 4 THEN -0.5 ELSE 1000.0 END::DOUBLE AS n FROM customer")
def number_parsing(spark, sf):
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, "$1,234.5").when(k == 1, "1d").when(k == 2, " 12% ").when(k == 3, "N/A").when(k == 4, "-.5").otherwise("1_000")
    return load(spark, sf, "customer").select("c_custkey", P.as_number(text).alias("n"))


@query("date_parsing", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN TIMESTAMP '2024-02-03 04:05:06' WHEN 1 THEN TIMESTAMP '2024-03-04' WHEN 2 THEN TIMESTAMP '2024-02-25' WHEN 3 THEN NULL ELSE TIMESTAMP '2024-02-05 10:00:00' END AS t FROM customer")
def date_parsing(spark, sf):
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, "2024-02-03 04:05:06").when(k == 1, "3/4/2024").when(k == 2, "25/2/2024").when(k == 3, "soon").otherwise("05-Feb-2024 10:00")
    return load(spark, sf, "customer").select("c_custkey", P.as_datetime(text).cast("timestamp_ntz").alias("t"))


@query("rounding_modes", "SELECT x / 1000.0 AS v, floor(x / 1000.0 * 100 + 0.5) / 100 AS browser, CAST(round_even(CAST(x / 1000.0 AS DECIMAL(10,3)), 2) AS DOUBLE) AS even FROM range(-50, 51) r(x)")
def rounding_modes(spark, sf):
    v = F.col("id") / 1000.0
    return spark.range(-50, 51).select(v.alias("v"), S.half_up(v).alias("browser"), S.half_even(v.cast("decimal(10,3)")).cast("double").alias("even"))


@query("url_normalise", "SELECT page_id, regexp_replace(url, '^(https?)://', '\\1://') AS url FROM pages")
def url_normalise(spark, sf):
    return load(spark, sf, "pages").select("page_id", K.normalised_url(F.col("url")).alias("url"))


@query("short_codes", "SELECT count(*) AS links, count(*) AS codes FROM (SELECT DISTINCT url FROM pages)")
def short_codes(spark, sf):
    u = load(spark, sf, "pages").select("url").distinct()
    return u.agg(F.count("url").alias("links"), F.count_distinct(K.code_of(F.col("url"))).alias("codes"))


@query("first_match_category", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') OR contains(lower(p_type), 'copper') THEN 'metal' WHEN contains(lower(p_type), 'plated') THEN 'plated' ELSE 'other' END AS category FROM part")
def first_match_category(spark, sf):
    rules = [("metal", ("steel", "brass", "copper")), ("plated", ("plated",))]
    return load(spark, sf, "part").select("p_partkey", P.first_match(F.col("p_type"), rules, "other").alias("category"))


@query("alias_check", "SELECT p_partkey, regexp_full_match(a, '[A-Za-z0-9_-]{3,32}') AND lower(a) NOT IN ('api', 'admin', 'static', 'stats') AS ok FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Stats' WHEN 1 THEN p_name WHEN 2 THEN 'ab' WHEN 3 THEN replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS a FROM part)")
def alias_check(spark, sf):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    a = F.when(k == 0, "Stats").when(k == 1, name).when(k == 2, "ab").when(k == 3, F.translate(name, " ", "-")).otherwise(F.concat(F.translate(name, " ", "_"), F.lit("_"), "p_partkey"))
    return load(spark, sf, "part").select("p_partkey", K.valid_alias(a).alias("ok"))


@query("json_report", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS report FROM nation""")
def json_report(spark, sf):
    return J.report_rows(load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query(
    "failure_causes",
    "SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'comma in quotes' WHEN 2 THEN 'newline in quotes' WHEN 3 THEN 'quotes kept' WHEN 4 THEN 'doubled quote' WHEN 5 THEN 'blank line' END AS cause FROM part",
)
def failure_causes(spark, sf):
    """Why lines split at commas differ from the right rows, for texts made of part names."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def right(x):
        import pyarrow as pa

        return pa.array([list(parse(t)) for t in x.to_pylist()], pa.list_(pa.list_(pa.string())))

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def split(x):
        import pyarrow as pa

        return pa.array([naive(t) for t in x.to_pylist()], pa.list_(pa.list_(pa.string())))

    k = F.col("p_partkey") % 7
    shape = F.when(k == 0, "%s,x\n").when(k == 1, '"%s,x",y\n').when(k == 2, '"%s\nx",y\n').when(k == 3, '"%s",x\n').when(k == 4, '"%s ""x"""\n').when(k == 5, "%s\n\nx\n").otherwise("%s\nx,y")
    t = load(spark, sf, "part").select("p_partkey", F.replace(shape, F.lit("%s"), F.col("p_name")).alias("text"))
    return t.withColumns({"got": split("text"), "want": right("text")}).select("p_partkey", failure_cause(F.col("got"), F.col("want")).alias("cause"))


@query(
    "line_arity",
    "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS size FROM part WHERE p_partkey % 4 <> 3",
)
def line_arity(spark, sf):
    """Cells by position: surplus ones dropped, missing ones null, blank lines left out."""
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(",", "p_name", "p_size")).when(k == 2, F.concat_ws(",", "p_name", "p_size", F.lit("more"))).otherwise("  ")
    return positional(load(spark, sf, "part").select("p_partkey", line.alias("line")), ["name", "size"])[0].drop("line")


@query("line_arity_refused", "SELECT p_partkey, p_name || CASE WHEN p_partkey % 4 = 2 THEN ',' || p_size || ',more' ELSE '' END AS line FROM part WHERE p_partkey % 4 IN (0, 2)")
def line_arity_refused(spark, sf):
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(",", "p_name", "p_size")).when(k == 2, F.concat_ws(",", "p_name", "p_size", F.lit("more"))).otherwise("  ")
    return positional(load(spark, sf, "part").select("p_partkey", line.alias("line")), ["name", "size"])[1]


_EXPENSE = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2024-02-30' WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE o_orderkey % 7 WHEN 0 THEN ' ' ELSE o_orderstatus END AS category, CASE o_orderkey % 11 WHEN 0 THEN '-5' WHEN 1 THEN 'free' WHEN 2 THEN '0' ELSE '$' || o_orderkey END AS amount FROM orders"
_FAILS = "o_orderkey % 5 < 2 OR o_orderkey % 7 = 0 OR o_orderkey % 11 < 3"


def _expenses(spark, sf):
    k = F.col("o_orderkey")
    date = F.when(k % 5 == 0, "2024-02-30").when(k % 5 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    amount = F.when(k % 11 == 0, "-5").when(k % 11 == 1, "free").when(k % 11 == 2, "0").otherwise(F.concat(F.lit("$"), k))
    return load(spark, sf, "orders").select("o_orderkey", date.alias("date"), F.when(k % 7 == 0, " ").otherwise(F.col("o_orderstatus")).alias("category"), amount.alias("amount"))


@query("expenses_taken", f"SELECT o_orderkey, CAST(date AS DATE) AS date, category, CAST(o_orderkey AS DOUBLE) AS amount FROM ({_EXPENSE}) WHERE NOT ({_FAILS})")
def expenses_taken(spark, sf):
    return import_expenses(_expenses(spark, sf))[0]


@query("expenses_refused", f"SELECT * FROM ({_EXPENSE}) WHERE {_FAILS}")
def expenses_refused(spark, sf):
    return import_expenses(_expenses(spark, sf))[1]


@query("expenses_exported", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS description, '-' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS amount FROM orders")
def expenses_exported(spark, sf):
    return export_expenses(load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("description"), F.col("o_totalprice").alias("amount")))


@query("year_months", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN strftime(o_orderdate, '%Y-%m') ELSE NULL END AS month FROM orders")
def year_months(spark, sf):
    k, month = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM")
    text = F.when(k == 0, "2024-13").when(k == 1, F.substring(month, 1, 6)).when(k == 2, month)
    return load(spark, sf, "orders").select("o_orderkey", P.year_month(text).alias("month"))
