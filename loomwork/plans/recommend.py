"""Recommendation on customers and the parts they ordered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import recommend as R
from ..scratch import kept
from ..tables import load

_LOG = "SELECT o_custkey AS user, l_partkey AS item, CAST(max(1 + l_quantity % 5) AS INTEGER) AS score, CAST(min(CAST(o_orderdate AS DATE) - DATE '1990-01-01') AS INTEGER) AS day FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


def ratings(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("d"))
    t = load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return t.groupBy("user", F.col("l_partkey").alias("item")).agg(F.max(1 + F.col("l_quantity") % 5).cast("int").alias("score"), F.min("d").alias("day"))


def log(spark, sf):
    return ratings(spark, sf).select("user", "item", "day")


@query("also_liked", f"WITH r AS ({_LOG}) SELECT b.item, count(*) AS co_likes, round(avg(b.score), 2) AS avg_score FROM r a JOIN r b ON b.user = a.user AND b.item <> a.item WHERE a.item = 7 AND a.score >= 4 AND b.score >= 4 GROUP BY 1")
def also_liked(spark, sf):
    return R.also_liked(ratings(spark, sf), 7)


@query("similar_users", f"WITH r AS ({_LOG}) SELECT b.user, count(*) AS shared_likes FROM r a JOIN r b ON b.item = a.item AND b.user <> a.user WHERE a.user = 7 AND a.score >= 4 AND b.score >= 4 GROUP BY 1")
def similar_users(spark, sf):
    return R.similar_users(ratings(spark, sf), 7)


@query(
    "personal_picks",
    f"""WITH r AS ({_LOG}) SELECT item, count(*) AS endorsements, round(avg(score), 2) AS avg_score FROM r WHERE score >= 4 AND user IN (SELECT b.user FROM r a JOIN r b ON b.item = a.item AND b.user <> a.user WHERE a.user = 7 AND a.score >= 4 AND b.score >= 4 GROUP BY 1 HAVING count(*) >= 2)
    AND item NOT IN (SELECT item FROM r WHERE user = 7) GROUP BY 1""",
)
def personal_picks(spark, sf):
    return R.personal_picks(ratings(spark, sf), 7)


@query("group_avg", f"WITH r AS ({_LOG}) SELECT p_brand AS brand, count(*) AS ratings, round(avg(score), 2) AS avg_score FROM r JOIN part ON p_partkey = item GROUP BY 1")
def group_avg(spark, sf):
    return ratings(spark, sf).join(load(spark, sf, "part"), F.col("item") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("ratings"), F.round(F.avg("score"), 2).alias("avg_score"))


@query("active_raters", f"WITH r AS ({_LOG}) SELECT user, count(*) AS ratings_given, round(avg(score), 2) AS avg_given FROM r GROUP BY 1 ORDER BY ratings_given DESC, user LIMIT 20")
def active_raters(spark, sf):
    return ratings(spark, sf).groupBy("user").agg(F.count(F.lit(1)).alias("ratings_given"), F.round(F.avg("score"), 2).alias("avg_given")).orderBy(F.desc("ratings_given"), "user").limit(20)


_T = f"l AS (SELECT user, item, day FROM ({_LOG})), z AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM l), cut AS (SELECT day AS c FROM z WHERE i = CAST(floor(n * 0.8) AS BIGINT)), tr AS (SELECT l.* FROM l, cut WHERE day < c), te AS (SELECT l.* FROM l, cut WHERE day >= c)"


@query("temporal_split", f"WITH {_T} SELECT (SELECT count(*) FROM tr) AS train, (SELECT count(*) FROM te) AS test, (SELECT max(day) FROM tr) AS last_train, (SELECT min(day) FROM te) AS first_test")
def temporal_split(spark, sf):
    tr, te = R.temporal_split(log(spark, sf))
    return tr.agg(F.count(F.lit(1)).alias("train"), F.max("day").alias("last_train")).crossJoin(te.agg(F.count(F.lit(1)).alias("test"), F.min("day").alias("first_test")))


@query("leave_last_out", f"WITH l AS (SELECT user, item, day FROM ({_LOG})) SELECT user, item, day FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY day DESC, item DESC) AS k, count(*) OVER (PARTITION BY user) AS n FROM l) WHERE k = 1 AND n > 1")
def leave_last_out(spark, sf):
    return R.leave_last_out(log(spark, sf))[1]


@query("random_split_sizes", f"SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) AS test FROM ({_LOG})")
def random_split_sizes(spark, sf):
    tr, te = R.random_split(log(spark, sf))
    return tr.agg(F.count(F.lit(1)).alias("train")).crossJoin(te.agg(F.count(F.lit(1)).alias("test")))


_POP = "pop AS (SELECT item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM tr GROUP BY 1)"


@query("popularity_recent", f"WITH {_T} SELECT item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM tr WHERE day > (SELECT max(day) FROM tr) - 14 GROUP BY 1")
def popularity_recent(spark, sf):
    return R.popularity(R.temporal_split(log(spark, sf))[0], 14)


_KNN = """sz AS (SELECT item, count(*) AS n FROM tr GROUP BY 1), co AS (SELECT a.item, b.item AS other, count(*) AS c FROM tr a JOIN tr b ON a.user = b.user AND a.item <> b.item GROUP BY 1, 2),
    sim AS (SELECT co.item, co.other, round(c / sqrt(x.n * y.n), 9) AS similarity FROM co JOIN sz x ON x.item = co.item JOIN sz y ON y.item = co.other), nb AS (SELECT item, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, other) AS k FROM sim) WHERE k <= 50)"""


@query("item_knn", f"WITH {_T}, {_KNN} SELECT item, other, similarity FROM nb")
def item_knn(spark, sf):
    return R.item_neighbours(R.temporal_split(kept(log(spark, sf), "log"))[0])


@query(
    "recall_at_10",
    f"""WITH {_T}, {_POP}, u AS (SELECT DISTINCT user FROM te), o AS (SELECT u.user, pop.item, row_number() OVER (PARTITION BY u.user ORDER BY rank) AS k FROM u, pop WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user = u.user AND tr.item = pop.item)),
    h AS (SELECT te.user, count(o.item) AS h, count(*) AS n FROM te LEFT JOIN (SELECT * FROM o WHERE k <= 10) o ON o.user = te.user AND o.item = te.item GROUP BY 1) SELECT round(avg(h / n), 12) AS recall, count(*) AS users FROM h""",
)
def recall_at_10(spark, sf):
    tr, te = R.temporal_split(kept(log(spark, sf), "log"))
    return R.recall_at_k(R.recommend_popular(R.popularity(tr), te, tr), te).withColumn("recall", F.round("recall", 12))


@query("recall_neighbours")
def recall_neighbours(spark, sf):
    tr, te = R.temporal_split(kept(log(spark, sf), "log"))
    return R.recall_at_k(R.recommend_neighbours(tr, R.popularity(tr), te), te)


@query("leakage")
def leakage(spark, sf):
    """Recall of global popularity with honest and leaky training on one test, and the inflation."""
    test, honest, leaky = R.honest_and_leaky(kept(log(spark, sf), "log"))
    test, leaky = kept(test, "test"), kept(leaky, "leaky")
    r = lambda train, name: R.recall_at_k(R.recommend_popular(R.popularity(train), test, train), test).select(F.col("recall").alias(name))
    return r(honest, "honest").crossJoin(r(leaky, "leaky")).withColumn("inflation", F.try_divide("leaky", "honest"))


@query("log_profile", f"WITH l AS ({_LOG}) SELECT count(*) AS interactions, count(DISTINCT user) AS users, count(DISTINCT item) AS items, count(DISTINCT day) AS days, count(*) / (count(DISTINCT user) * count(DISTINCT item)) AS density FROM l")
def log_profile(spark, sf):
    return R.profile(log(spark, sf))


@query("protocol_profile", f"WITH {_T}, p AS (SELECT user, count(DISTINCT item) AS n FROM te GROUP BY 1) SELECT avg(n) AS relevant, avg(CAST(p.user NOT IN (SELECT user FROM tr) AS INT)) AS cold FROM p")
def protocol_profile(spark, sf):
    return R.protocol_profile(*R.temporal_split(log(spark, sf)))
