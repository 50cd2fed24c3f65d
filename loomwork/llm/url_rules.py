"""URL rules by expansion and short hash prefixes.

Each distinct URL is expanded into the expressions host suffix + path prefix that a rule could equal. The expressions
are joined with the rules on the first four bytes of their SHA-256 digest, the full digests confirm, and the longest
confirmed rule decides. All steps are DataFrame operations, and no side is broadcast by a hint: Spark does so only if the
rules are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az, table

#: The contract's rules: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
PREFIX_DIGITS = 8


def _after_scheme(url: Column) -> Column:
    """What follows the first "://", without query and fragment; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"\A[^?#]*", 0))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_az(F.substring_index(_after_scheme(url), "/", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _after_scheme(url)
    slash = F.locate("/", rest)
    return F.coalesce(F.when(slash > 0, F.substr(rest, slash)), F.lit(""))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Per row: page_id, host, path, rule and verdict.

    rules(host, path, verdict): a rule fits its host and all subdomains if the URL's path starts with the rule's path. The
    longest rule (host and path) wins; of equal ones, block. rule is null and verdict is `default` where none fits, as for
    a null URL or one without "://", whose host and path are empty. Rules with a null host or path count as empty there.
    Repeated rows are judged alike, since each distinct URL is judged once; empty tables give an empty result or default
    verdicts. Other columns are ignored.
    """
    rules = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    # what shapes a rule can have: numbers of labels and lengths of paths, one row however many rules there are
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    digest = lambda host, path: F.sha2(F.concat(host, path), 256)
    known = rules.withColumn("digest", digest("host", "path")).select(F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"), "digest", F.concat("host", "path").alias("rule"), "verdict")

    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"] or 1))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    ends = F.filter(F.array(*[F.lit(n) for n in shape["lengths"] or [0]]), lambda n: n <= F.length("path"))
    spread = urls.select("url", "path", F.explode(hosts).alias("host")).select("url", "path", "host", F.explode(ends).alias("end"))
    spread = spread.select("url", digest(F.col("host"), F.substr("path", F.lit(1), F.col("end"))).alias("full")).withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    hits = spread.join(known, "prefix").where("full = digest")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "block", "rule")).alias("best"))

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    out = rows.where("url is not null").join(best, "url", "left")
    none = rows.where("url is null").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))  # apart, or they would all meet in one task
    return out.unionByName(none).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP6_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
p AS (SELECT r, page_id, coalesce(translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
k(host, path, verdict) AS (VALUES {_VALUES}),
f AS (SELECT p.r, k.host || k.path AS rule, k.verdict, row_number() OVER (PARTITION BY p.r ORDER BY length(k.host || k.path) DESC) AS n
      FROM p JOIN k ON (p.host = k.host OR ends_with(p.host, '.' || k.host)) AND starts_with(p.path, k.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN f ON p.r = f.r AND f.n = 1
"""
