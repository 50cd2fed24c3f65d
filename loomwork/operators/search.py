"""Ranked text search: BM25, a substring baseline, and retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words without discriminating power: fixed values.
STOP = "a an and are as at be by for from has have if in into is it its of on or that the to with will this these those was were been".split()
K1, B = 1.5, 0.25


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of two characters or more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) > 1) & ~t.isin(*STOP))


def indexed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, length): the searchable terms of each document, its id included."""
    text = F.concat_ws(" ", F.coalesce(F.col(text_col), F.lit("")), F.replace(F.col(id_col).cast("string"), F.lit("."), F.lit(" ")))
    return docs.select(F.col(id_col).alias("id"), tokens(text).alias("terms")).withColumn("length", F.size("terms"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """queries(query_id, query) -> (query_id, rank, id, score): the k best documents of each query."""
    return bm25_grid(docs, queries, id_col, text_col, [(k1, b)], k).drop("k1", "b")


def bm25_grid(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, grid: list[tuple[float, float]], k: int = 10) -> DataFrame:
    """(k1, b, query_id, rank, id, score): bm25 for each pair of parameters; the documents are read once for all of them.

    Scores are rounded to nine places and ties go by id. A query term that occurs twice counts twice; a term that no
    document has adds nothing. Only occurrences of query terms leave the documents: the full postings are never built.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    docs = indexed(docs, id_col, text_col)
    whole = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))
    wanted = asked.select("term").distinct()
    found = docs.select("id", "length", F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(whole))  # one row
    idf = F.greatest(F.lit(1e-9), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = asked.join(df.withColumn("idf", idf), "term")
    k1, b = F.col("k1"), F.col("b")
    norm = 1 - b + b * F.col("length") / F.col("avgdl")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    settings = F.array(*[F.struct(F.lit(float(x)).alias("k1"), F.lit(float(y)).alias("b")) for x, y in grid])
    each = found.join(weights, "term").select("*", F.inline(settings))
    scores = each.groupBy("k1", "b", "query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
    return top_k(scores, ["k1", "b", "query_id"], [F.desc("score"), F.col("id")], k)


def substring_search(docs: DataFrame, queries: list[tuple[str, str]], id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """The baseline: the number of query terms that occur anywhere in the text or id, as substrings. queries are few, each one column of the pass."""
    spark = docs.sparkSession
    terms = spark.createDataFrame(queries, "query_id string, query string").select("query_id", tokens(F.col("query")).alias("t")).collect()  # the caller's own few queries
    blob = F.lower(F.concat_ws(" ", F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")))
    hits = [F.struct(F.lit(r["query_id"]).alias("query_id"), reduce(lambda a, c: a + c, [F.contains(F.col("_blob"), F.lit(t)).cast("int") for t in r["t"]], F.lit(0)).cast("double").alias("score")) for r in terms]
    s = docs.select(F.col(id_col).alias("id"), blob.alias("_blob")).select("id", F.inline(F.filter(F.array(*hits), lambda h: h["score"] > 0)))
    return top_k(s, ["query_id"], [F.desc("score"), F.col("id")], k)


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key by `order`, with their rank from 1; each task keeps k rows of a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def per_query(results: DataFrame, judgments: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """judgments(query_id, id) -> (query_id, relevant, hits, first_rank): for every judged query, also without results."""
    r = results.join(judgments.distinct(), [*by, "id"]).groupBy(*by).agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"))
    return judgments.groupBy(*by).agg(F.count_distinct("id").alias("relevant")).join(r, list(by), "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def metrics(results: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """One row: precision and recall at k and the mean reciprocal rank over all judged queries."""
    return _means(per_query(results, judgments).groupBy(), k)


def _means(q, k: int) -> DataFrame:
    return q.agg(F.avg(F.col("hits") / k).alias("p_at_k"), F.avg(F.col("hits") / F.col("relevant")).alias("r_at_k"), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def sweep(docs: DataFrame, queries: DataFrame, judgments: DataFrame, id_col: str, text_col: str, grid: list[tuple[float, float]]) -> DataFrame:
    """(k1, b, p_at_k, r_at_k, mrr) for each pair of parameters."""
    settings = F.array(*[F.struct(F.lit(float(x)).alias("k1"), F.lit(float(y)).alias("b")) for x, y in grid])
    each = per_query(bm25_grid(docs, queries, id_col, text_col, grid), judgments.select("*", F.inline(settings)), ("k1", "b", "query_id"))
    return _means(each.groupBy("k1", "b"), 10)


def unjudged(judgments: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Judgments of documents that do not exist."""
    return judgments.join(docs.select(F.col(id_col).alias("id")), "id", "left_anti")
