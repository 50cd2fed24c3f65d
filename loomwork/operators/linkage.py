"""Record linkage: normalisation, blocking schemes, scored pairs, quality of blocks and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import trimmed
from ..functions.similarity import jaro_winkler_column

#: Abbreviations and their words: fixed values.
ABBREVIATIONS = {"pk": "park", "st": "street", "ave": "avenue", "rd": "road"}


def words(c: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.lower(trimmed(c)), "[.,]", " "), r"\s+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.transform(parts, lambda w: F.coalesce(table[w], w))


def normalised(c: Column) -> Column:
    """Lower case, single spaces, no full stops or commas, abbreviations written out wherever they stand."""
    return F.array_join(words(c), " ")


#: Blocking keys by name; records are compared only with records of the same key.
SCHEMES = {
    "none": lambda c: F.lit(""),
    "first_letter_raw": lambda c: F.substring(c, 1, 1),
    "first_letter": lambda c: F.substring(normalised(c), 1, 1),
    "first_three": lambda c: F.substring(normalised(c), 1, 3),
    "token_initials": lambda c: F.array_join(F.sort_array(F.transform(words(c), lambda w: F.substring(w, 1, 1))), ""),
    "length": lambda c: F.floor(F.length(normalised(c)) / 4).cast("string"),
}


def candidates(records: DataFrame, scheme: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(a, b) with a < b of one block. A block of n records gives n * (n - 1) / 2 pairs: choose keys that keep blocks small."""
    k = records.select(F.col(id_col).alias("id"), SCHEMES[scheme](F.col(text_col)).alias("key"))
    a, b = k.select(F.col("id").alias("a"), "key"), k.select(F.col("id").alias("b"), "key")
    return a.join(b, "key").where("a < b").select("a", "b")


def truth_pairs(records: DataFrame, id_col: str = "id", entity_col: str = "entity") -> DataFrame:
    a, b = (records.select(F.col(id_col).alias(n), F.col(entity_col).alias("entity")) for n in "ab")
    return a.join(b, "entity").where("a < b").select("a", "b")


def assess(records: DataFrame, truth: DataFrame, scheme: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row: candidates, reduction of all pairs, and the share of true pairs that the blocks keep (1 without true pairs)."""
    c = candidates(records, scheme, id_col, text_col)
    t = truth.agg(F.count(F.lit(1)).alias("true_pairs"))
    kept = c.join(truth, ["a", "b"]).agg(F.count(F.lit(1)).alias("kept"))
    n = records.agg(F.count(F.lit(1)).alias("n"))
    one = c.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(kept).crossJoin(t).crossJoin(n)  # four rows of one
    return one.select(F.lit(scheme).alias("scheme"), "candidates", (1 - F.col("candidates") / F.floor(F.col("n") * (F.col("n") - 1) / 2)).alias("reduction"), F.coalesce(F.try_divide("kept", "true_pairs"), F.lit(1.0)).alias("completeness"))


def scored(records: DataFrame, scheme: str = "first_three", id_col: str = "id", text_col: str = "text", normalise: bool = True) -> DataFrame:
    """(a, b, score): the candidates with their Jaro-Winkler similarity, each pair scored once whatever thresholds follow."""
    text = normalised(F.col(text_col)) if normalise else F.col(text_col)
    t = records.select(F.col(id_col).alias("id"), text.alias("t"))
    c = candidates(records, scheme, id_col, text_col).join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return c.select("a", "b", jaro_winkler_column(F.col("ta"), F.col("tb")).alias("score"))


def link_quality(pairs: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, predicted, precision, recall, f1) of the scored pairs at each threshold; 0 where undefined."""
    t = truth.withColumn("_true", F.lit(True))
    total = truth.agg(F.count(F.lit(1)).alias("_all"))
    at = pairs.join(t, ["a", "b"], "left").withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(x) for x in thresholds]), lambda x: x <= F.col("score"))))
    n = at.groupBy("threshold").agg(F.count(F.lit(1)).alias("predicted"), F.count("_true").alias("hits"))
    every = pairs.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double").join(n, "threshold", "left").crossJoin(F.broadcast(total))
    p, r = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), "_all"), F.lit(0.0))
    q = every.select("threshold", F.coalesce("predicted", F.lit(0)).alias("predicted"), p.alias("precision"), r.alias("recall"))
    return q.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def unlabelled(records: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Spellings that no label covers."""
    return records.select(text_col).distinct().join(labels, text_col, "left_anti")


def typos(names: DataFrame, variants: int = 4, seed: int = 0, name_col: str = "name") -> DataFrame:
    """(text, entity): each name and `variants` damaged copies of it, one of substitution, deletion, insertion and transposition each, at a seeded place."""
    n = names.select(F.col(name_col).alias("name")).withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    h = F.xxhash64("name", "v", F.lit(seed))
    n = n.withColumn("i", 2 + F.pmod(h, F.greatest(F.length("name") - 2, F.lit(1))).cast("int")).withColumn("k", F.pmod(F.shiftright(h, 20), F.lit(4))).withColumn("c", F.chr(F.lit(97) + F.pmod(F.shiftright(h, 33), F.lit(26))))
    s, i = F.col("name"), F.col("i")
    head, rest = F.substring(s, F.lit(1), i - 1), lambda x: F.substr(s, x)
    damaged = F.when(F.length(s) < 4, s).when(F.col("k") == 0, F.concat(head, "c", rest(i + 1))).when(F.col("k") == 1, F.concat(head, rest(i + 1))).when(F.col("k") == 2, F.concat(head, "c", rest(i))).otherwise(F.concat(head, F.substring(s, i + 1, F.lit(1)), F.substring(s, i, F.lit(1)), rest(i + 2)))
    both = names.select(F.col(name_col).alias("text"), F.col(name_col).alias("entity")).unionByName(n.select(damaged.alias("text"), F.col("name").alias("entity")))
    return both.groupBy("text").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("_n")).where("_n = 1").drop("_n")
