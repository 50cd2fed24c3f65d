"""Samples of an exact size that hang on hashes of the rows' ids only, so reruns and repartitions agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 4096


def place(keys: list[str], seed: int) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def ranked(df: DataFrame, keys: list[str], seed: int, name: str = "_rank") -> DataFrame:
    """df with each row's rank (from 0) in the order of its seeded hash, and the number of rows as _all.

    Hash buckets are counted and their counts summed up, so only the rows of one bucket are ordered in one task.
    """
    h = df.withColumn("_h", place(keys, seed)).withColumn("_b", F.shiftrightunsigned("_h", 52))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(1)).orderBy("_b")  # at most 4096 rows
    base = counts.select("_b", (F.sum("_n").over(w) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    out = h.join(F.broadcast(base), "_b")  # one row for each bucket
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys)) - 1
    return out.withColumn(name, F.col("_base") + inside).drop("_h", "_b", "_base")


def split_exact(df: DataFrame, keys: list[str], share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the first int(n * share) rows in seeded order, the rest)."""
    r = ranked(df, keys, seed)
    cut = F.floor(F.col("_all") * share)
    return r.where(F.col("_rank") < cut).drop("_rank", "_all"), r.where(F.col("_rank") >= cut).drop("_rank", "_all")


def cut_of(df: DataFrame, keys: list[str], share: float, seed: int, least: int = 0) -> DataFrame:
    """One row with _last, the place of the last of the first max(least, int(n * share)) rows in seeded order; null if there is none.

    Hash buckets are counted, and only the rows of the bucket that holds the cut are ordered; the rest is not shuffled.
    """
    h = df.select(F.shiftrightunsigned(place(keys, seed), 52).alias("_b"), _spot(keys, seed).alias("_last"))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(1))  # at most 4096 rows
    up = counts.withColumns({"_up": F.sum("_n").over(w.orderBy("_b")), "_cut": F.greatest(F.floor(F.sum("_n").over(w) * share), F.lit(least))})
    edge = up.where("_up - _n < _cut and _cut <= _up").select("_b", (F.col("_cut") - F.col("_up") + F.col("_n")).alias("_left"))
    inside = h.join(F.broadcast(edge), "_b").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_last")))
    return inside.where("_r = _left").agg(F.max("_last").alias("_last"))


def _spot(keys: list[str], seed: int) -> Column:
    h = place(keys, seed)
    return F.struct(F.shiftrightunsigned(h, 52).alias("b"), h.alias("h"), *keys)


def before_cut(keys: list[str], seed: int) -> Column:
    """Whether a row, beside the _last of cut_of, is among the first."""
    return F.coalesce(_spot(keys, seed) <= F.col("_last"), F.lit(False))


def chosen(df: DataFrame, keys: list[str], share: float, seed: int, least: int = 1) -> DataFrame:
    """df with the flag _chosen on max(least, int(n * share)) rows; keys tell rows apart."""
    return df.crossJoin(F.broadcast(cut_of(df, keys, share, seed, least))).withColumn("_chosen", before_cut(keys, seed)).drop("_last")
