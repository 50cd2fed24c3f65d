"""Mixing sources to target weights by Sainte-Laguë apportionment.

All steps are DataFrame operations:

1. Each source gets a target: its weight's share of all words, at most three times its own size; what is cut off is
   shared again by weight among the others until no target is above its limit.
2. A source is laid out in shards, its documents dealt by a seeded hash and, in each shard, put in seeded hash order; a
   shard is cut into blocks of equal numbers of words (its last block may be shorter). No source sits in one task: a
   shard holds about `shard_words`.
3. Seats (blocks) go by highest quotients size / (2 * seats + 1): first all blocks to the sources, by target, then each
   source's blocks to its shards, by size, so every shard has an integer quota. What rounding to blocks leaves or gives
   too much, less than a block for each shard, is evened out in words, so a source gets its target to the word.
4. A shard whose quota is a multiple of its words takes them all so often; for the rest its blocks stand in seeded order
   and are taken one by one until the rest is reached, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, beside, table, unpacked, whole_row

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
BLOCK_WORDS = 1024
SHARD_WORDS = 250_000
MAX_SHARDS = 65_536  #: Of one source. Beyond it, shards grow instead: their words are summed in a sort that spills.


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    edges = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+")) - edges).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = MAX_REPEATS) -> DataFrame:
    """sizes(source, source_size) -> with weight and target (double). One row for each source.

    Sources by code point, null last, weigh as the weights repeat. In order of limit * size / weight, a source is held at
    its limit if its share of what the held ones before it leave is at least that; the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (limit * F.col("source_size")).cast("double")
    by = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    all_ = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    out = sizes.withColumn("weight", pick).withColumn("_left", F.sum("source_size").over(all_) - F.coalesce(F.sum(limit * F.col("source_size")).over(before), F.lit(0)))
    out = out.withColumn("_w", F.sum("weight").over(onward)).withColumn("_held", cap <= F.col("_left") * F.col("weight") / F.col("_w"))
    free = out.withColumn("_rest", F.sum("source_size").over(all_) - F.coalesce(F.sum(F.when(F.col("_held"), limit * F.col("source_size"))).over(all_), F.lit(0)))
    free = free.withColumn("_fw", F.sum(F.when(~F.col("_held"), F.col("weight"))).over(all_))
    target = F.when(F.col("_held"), cap).otherwise(F.col("_rest") * F.col("weight") / F.col("_fw"))
    return free.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, groups: list[str], votes: str, seats: str, tie: list) -> DataFrame:
    """parties with quota (long): the group's `seats` (a column that is equal in a group) go one by one to the party with the highest quotient votes / (2 * quota + 1).

    Only quotients near the last seat are listed: with V votes and S seats in a group, a party's quota differs from
    round(votes * S / V) by at most half the number of parties times its share of the votes, and two. Ties go by `tie`.
    Parties without votes get nothing.
    """
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    p = parties.withColumn("_all", F.sum(v).over(own)).withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_share", F.coalesce(F.try_divide(v, F.col("_all")), F.lit(0.0)))
    slack = F.ceil(F.col("_share") * F.col("_n") / 2) + 2
    p = p.withColumn("_low", F.when(v > 0, F.greatest(F.round(F.col("_share") * s).cast("long") - slack, F.lit(0))).otherwise(F.lit(0)).cast("long")).withColumn("_wide", 2 * slack)
    p = p.withColumn("_open", F.col(seats) - F.sum("_low").over(own))
    listed = p.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_low") + F.col("_wide")))).where(v > 0)
    rank = own.orderBy((v / (2 * F.col("_k") + 1)).desc(), *tie)
    won = listed.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= F.col("_open"))
    keys = [c for c in parties.columns]
    counted = won.groupBy(*[F.col(c).alias(f"_g_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("_won"))
    same = None
    for c in keys:
        x = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        same = x if same is None else same & x
    return p.join(counted, same, "left").select(*keys, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _place(id_col: Column, text: Column, seed: str) -> Column:
    """A seeded hash of a document that every engine computes alike: hex digits of md5 over the id, else over the text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("t"), text), F.lit(""))).cast("binary"))


def number_of(hexdigits: Column) -> Column:
    return F.conv(hexdigits, 16, 10).cast("long")


_KEY = ["has_source", "source_key"]  #: A source as two columns that are never null, so that joins and windows on it share one shuffle.


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("has_source", F.col("source").isNotNull()).withColumn("source_key", F.coalesce("source", F.lit("")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, whole: bool) -> DataFrame:
    """(doc_id, source, its key, size, place, tie, and with `whole` all columns of docs as one struct) of each row."""
    text = F.col(text_col)
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        _place(F.col(id_col), text, seed).alias("place"),
        F.xxhash64(text).alias("tie"),
        *([whole_row(docs).alias("row")] if whole else []),
    )
    return _keyed(out)


def shard_quotas(shards: DataFrame, sources: DataFrame, limit: int, block_words: int) -> DataFrame:
    """shards(source, shard, words), sources(source, target) -> (source, shard, words, quota): words that the mix takes of each shard, repeats counted.

    Blocks go by highest quotients to sources and then to their shards; base is what a shard's blocks hold, at most its
    limit. The difference to the source's target is then spread, in words, over what the shards have left up to their
    limits, or over what they have where it is negative, by cumulative rounding: the sum is the rounded target.
    """
    blocks = F.ceil(F.col("words") / block_words).cast("long")
    totals = _keyed(shards).groupBy(*_KEY).agg(F.sum(blocks).alias("all_blocks"))
    every = _keyed(sources).join(totals, _KEY)
    seats = every.crossJoin(every.agg(F.round(F.sum("target") / block_words).cast("long").alias("seats"))).select("source", "target", "all_blocks", "seats")  # one row
    by_source = sainte_lague(seats, [], "target", "seats", [F.col("source").asc_nulls_last()])
    by_source = _keyed(by_source).select(*_KEY, "target", F.least("quota", limit * F.col("all_blocks")).alias("seats"))
    parties = _keyed(shards).join(by_source, _KEY).select("source", "shard", "words", "target", "seats")
    got = _keyed(sainte_lague(parties, ["source"], "words", "seats", [F.col("shard")]))
    most = limit * F.col("words")
    own = Window.partitionBy(*_KEY)
    got = got.withColumn("base", F.least(F.col("quota") * block_words, most))
    got = got.withColumn("d", F.floor(F.col("target") + 0.5).cast("long") - F.sum("base").over(own))
    got = got.withColumn("part", F.when(F.col("d") >= 0, most - F.col("base")).otherwise(F.col("base")))
    upto = F.sum("part").over(own.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("upto", upto).withColumn("parts", F.sum("part").over(own))
    share = lambda x: F.floor(F.col("d") * F.coalesce(F.try_divide(x, F.col("parts")), F.lit(0.0))).cast("long")
    return got.select("source", "shard", "words", (F.col("base") + share(F.col("upto")) - share(F.col("upto") - F.col("part"))).alias("quota"))


def _cuts(quotas: DataFrame, seed: str, block_words: int) -> DataFrame:
    """quotas with full (whole passes) and cuts: for each block of the shard, how many of its first words one more pass takes."""
    words, n = F.col("words"), F.ceil(F.col("words") / block_words).cast("int")
    out = quotas.withColumn("full", F.coalesce(F.floor(F.try_divide("quota", "words")), F.lit(0)).cast("long")).withColumn("rest", F.col("quota") - F.col("full") * words)
    name = lambda i: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")), F.lit(":"), F.col("shard").cast("string"), F.lit(":"), i.cast("string")).cast("binary"))
    listed = F.when(words > 0, F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(name(i).alias("k"), i.alias("i"))))).otherwise(F.array().cast("array<struct<k:string,i:int>>"))
    out = out.withColumn("order", F.transform(listed, lambda x: x["i"]))
    short, at_last = n * block_words - words, F.array_position("order", n - 1) - 1  # the last block lacks `short` words and stands there in the order
    cut = lambda i, k: F.greatest(F.least(F.col("rest") - (k * block_words - F.when(k > at_last, short).otherwise(0)), F.least(F.lit(block_words), words - i * block_words)), F.lit(0)).cast("int")
    cuts = F.array_sort(F.transform("order", lambda i, k: F.struct(i.alias("i"), cut(i.cast("long"), k.cast("long")).alias("cut"))))
    return out.withColumn("cuts", F.transform(cuts, lambda x: x["cut"])).drop("order", "rest", "quota", "words")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, limit: int, seed: str, block_words: int, shard_words: int, max_shards: int, whole: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = scratch.keep(_sized(docs, id_col, text_col, source_col, seed, False), "sized")
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    sources = sources.withColumn("shards", F.least(F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)), F.lit(max_shards)).cast("long"))
    sources = scratch.keep(sources, "sources")
    named = beside(_keyed(sources).select(*_KEY, "source_size", "target", "shards"))
    shard = F.pmod(number_of(F.substring("place", 1, 8)), F.col("shards")).alias("shard")
    shards = scratch.keep(narrow.join(named, _KEY).select("source", shard, "size").groupBy("source", "shard").agg(F.sum("size").alias("words")), "shards")
    quotas = scratch.keep(_cuts(scratch.keep(shard_quotas(shards, sources.select("source", "target"), limit, block_words), "quotas"), seed, block_words), "cuts")
    scratch.only(sources, quotas, *([] if whole else [narrow]))
    quotas = beside(_keyed(quotas).drop("source"), 4_000_000 // max(1, shard_words // block_words))  # four million numbers at most

    # a document without words is never taken
    rows = _sized(docs, id_col, text_col, source_col, seed, True).where("size > 0") if whole else narrow
    dealt = rows.join(named, _KEY).select(*rows.columns, "source_size", "target", shard)
    upto = F.sum("size").over(Window.partitionBy(*_KEY, "shard").orderBy("place", "size", "tie").rowsBetween(Window.unboundedPreceding, 0))
    laid = dealt.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("size")).join(quotas, [*_KEY, "shard"])
    of = F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))
    low = lambda i: F.greatest(F.col("begin"), i * block_words)
    high = lambda i: F.greatest(F.least(F.col("end"), i * block_words + F.get("cuts", i.cast("int"))), low(i))
    ranges = F.filter(F.transform(of, lambda i: F.struct((low(i) - F.col("begin")).alias("low"), (high(i) - F.col("begin")).alias("high"))), lambda r: r["high"] > r["low"])
    out = laid.withColumn("ranges", F.when(F.col("size") > 0, ranges).otherwise(F.array().cast("array<struct<low:bigint,high:bigint>>")))
    part = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["high"] - r["low"])
    out = out.withColumn("part", part)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"), "full", "part", "ranges", *(["row"] if whole else []))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, limit: int = MAX_REPEATS, seed: str = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, and what is taken: full (whole passes), part (words of one more pass) and ranges (their places: low, high).

    size is the number of words; a null text has none, and a null source is a source like others, last in order. A source
    without words has target 0. Rows that repeat an id are separate documents that lie side by side; rows that repeat id
    and text are interchangeable. The sum of `taken` of a source is its target, rounded; no document exceeds
    limit * size. Reruns agree, since places hang on the seed, the id and the text only. An empty table gives an empty
    result; other columns are ignored, whatever their names. Texts of any length are counted whole. One row for each
    source, and one for each shard of a source, is sorted in one task.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, limit, seed, block_words, shard_words, max_shards, False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, limit: int = MAX_REPEATS, seed: str = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """The mix as rows with the columns of docs, whatever their names: each document once for each whole pass, and once more with the words of a partial pass; see mixture().

    A partial pass that covers the whole text has it unchanged; a part of a text is its words joined by single spaces.
    Documents without words are in no mix.
    """
    mix = _mixed(docs, id_col, text_col, source_col, weights, limit, seed, block_words, shard_words, max_shards, True).where("taken > 0")
    text = F.col("row")[text_col]
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(words, (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int")))), " ")
    once_more = F.when(F.col("part") >= F.col("size"), F.array(text)).when(F.col("part") > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))
    passes = mix.select("row", F.explode(F.concat(F.array_repeat(text, F.col("full").cast("int")), once_more)).alias("text"))
    return passes.select(*unpacked(docs, **{text_col: F.col("text")}))


_W = r"[^\x20\x09-\x0D]+"
OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS BIGINT) AS size,
      md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 't' || text, '')) AS place FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, CAST([{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS weight FROM s0),
-- targets: in each round the sources whose share would exceed their limit are held at it
f(n, source, source_size, weight, held) AS (SELECT 0, source, source_size, weight, false FROM s
  UNION ALL SELECT n + 1, source, source_size, weight, held OR {MAX_REPEATS} * source_size <=
    (sum(source_size) OVER () - sum(CASE WHEN held THEN {MAX_REPEATS} * source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN held THEN 0 ELSE weight END) OVER () FROM f WHERE n < 40),
g AS (SELECT source, source_size, weight, CASE WHEN held THEN CAST({MAX_REPEATS} * source_size AS DOUBLE) ELSE
    (sum(source_size) OVER () - sum(CASE WHEN held THEN {MAX_REPEATS} * source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN held THEN 0 ELSE weight END) OVER () END AS target FROM f WHERE n = 40),
h AS (SELECT *, least(greatest(CAST(ceil(source_size / {SHARD_WORDS}) AS BIGINT), 1), {MAX_SHARDS}) AS shards FROM g),
e AS (SELECT d.*, h.source_size, h.target, CAST('0x' || substr(place, 1, 8) AS BIGINT) % h.shards AS shard FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
k AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / {BLOCK_WORDS}) AS BIGINT) AS blocks FROM e GROUP BY ALL),
-- seats by highest quotients, each listed
q1 AS (SELECT source, target / (2 * i + 1) AS q FROM (SELECT source, target, unnest(range(0, CAST(target / {BLOCK_WORDS} AS BIGINT) + 40)) AS i FROM g WHERE target > 0)),
q2 AS (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST) AS n FROM q1),
q3 AS (SELECT source, count(*) AS seats FROM q2 WHERE n <= (SELECT CAST(round(sum(target) / {BLOCK_WORDS}) AS BIGINT) FROM g) GROUP BY source),
q4 AS (SELECT k.source, k.shard, k.words, k.blocks, least(coalesce(seats, 0), {MAX_REPEATS} * sum(k.blocks) OVER (PARTITION BY k.source)) AS seats, sum(k.words) OVER (PARTITION BY k.source) AS all_words
       FROM k LEFT JOIN q3 ON k.source IS NOT DISTINCT FROM q3.source),
q5 AS (SELECT source, shard, seats, words / (2 * i + 1) AS q FROM (SELECT source, shard, seats, words, unnest(range(0, CAST(words * seats / all_words AS BIGINT) + 40)) AS i FROM q4 WHERE words > 0)),
q6 AS (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS n FROM q5),
q7 AS (SELECT source, shard, count(*) AS quota FROM q6 WHERE n <= seats GROUP BY source, shard),
-- a shard's words: those of its blocks, and its part of what the source's target differs from its blocks
a AS (SELECT k.source, k.shard, CAST(k.words AS BIGINT) AS words, CAST(floor(g.target + 0.5) AS BIGINT) AS want, CAST(least(coalesce(quota, 0) * {BLOCK_WORDS}, {MAX_REPEATS} * k.words) AS BIGINT) AS base
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source LEFT JOIN q7 ON k.source IS NOT DISTINCT FROM q7.source AND k.shard = q7.shard),
a2 AS (SELECT *, CAST(want - sum(base) OVER (PARTITION BY source) AS BIGINT) AS d FROM a),
a3 AS (SELECT *, CASE WHEN d >= 0 THEN {MAX_REPEATS} * words - base ELSE base END AS part FROM a2),
a4 AS (SELECT *, CAST(sum(part) OVER (PARTITION BY source ORDER BY shard ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto, CAST(sum(part) OVER (PARTITION BY source) AS DOUBLE) AS parts FROM a3),
a5 AS (SELECT source, shard, words, base + CASE WHEN parts > 0 THEN CAST(floor(d * (upto / parts)) AS BIGINT) - CAST(floor(d * ((upto - part) / parts)) AS BIGINT) ELSE 0 END AS quota FROM a4),
b AS (SELECT source, shard, words, CASE WHEN words > 0 THEN quota // words ELSE 0 END AS passes, CASE WHEN words > 0 THEN quota % words ELSE 0 END AS rest FROM a5),
-- the shard's blocks in seeded order, and how many of its first words each gives
c1 AS (SELECT source, shard, rest, i, least({BLOCK_WORDS}, words - i * {BLOCK_WORDS}) AS size, md5('{SEED}:' || coalesce(source, '') || ':' || CAST(shard AS VARCHAR) || ':' || CAST(i AS VARCHAR)) AS k
       FROM (SELECT *, unnest(range(0, (words + {BLOCK_WORDS} - 1) // {BLOCK_WORDS})) AS i FROM b)),
c2 AS (SELECT source, shard, i, greatest(least(rest - (sum(size) OVER (PARTITION BY source, shard ORDER BY k, i ROWS UNBOUNDED PRECEDING) - size), size), 0) AS cut FROM c1),
l AS (SELECT e.*, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY place, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM e),
m AS (SELECT l.*, stop - size AS start, unnest(range((stop - size) // {BLOCK_WORDS}, CASE WHEN size > 0 THEN (stop - 1) // {BLOCK_WORDS} + 1 ELSE (stop - size) // {BLOCK_WORDS} END)) AS i FROM l),
n AS (SELECT m.r, sum(greatest(least(m.stop, m.i * {BLOCK_WORDS} + c2.cut) - greatest(m.start, m.i * {BLOCK_WORDS}), 0)) AS part
      FROM m JOIN c2 ON m.source IS NOT DISTINCT FROM c2.source AND m.shard = c2.shard AND m.i = c2.i GROUP BY m.r)
SELECT l.doc_id, l.size, l.source_size, l.target, CAST(b.passes * l.size + coalesce(n.part, 0) AS BIGINT) AS taken
FROM l JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.shard = b.shard LEFT JOIN n ON l.r = n.r
"""
