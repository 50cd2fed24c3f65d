"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation several times, each time with more turns. A rolling hash over the turns gives every
prefix of a conversation a digest; a conversation whose digest is that of a proper prefix of another is a snapshot of it,
and an anti-join drops it. Of equal conversations the one with the smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): of each conversation that no longer one continues, the turns in order, as structs of turn, role, text.

    Turns stand in the order of turn, then role, then text, nulls first; equal rows are turns of their own. A null role
    or text is a value of its own. A row without a conversation id is a conversation of its own, so such rows never meet
    in one task. Of equal conversations the smallest id stands, a null only if none has an id. An empty table gives an
    empty result; other columns are ignored. Conversations are compared by a 256-bit digest of the chain of their turns.
    A conversation is one record and is gathered in one row; numbers of conversations that share turns, or are equal, do
    not matter: digests are made distinct, and counted, on the map side.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    named = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = named.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    mark = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    chain = F.aggregate("turns", F.array().cast("array<string>"), lambda a, t: F.concat(a, F.array(F.sha2(F.concat(F.coalesce(F.get(a, F.size(a) - 1), F.lit("")), mark(t["role"]), mark(t["text"])).cast("binary"), 256))))
    whole = scratch.keep(whole.withColumn("chain", chain), "conversations")
    prefixes = whole.select(F.explode(F.slice("chain", 1, F.size("chain") - 1)).alias("digest")).distinct()
    ends = whole.select("conv_id", F.element_at("chain", -1).alias("digest")).groupBy("digest").agg(F.min("conv_id").alias("conv_id"))
    kept = scratch.keep(ends.join(prefixes, "digest", "left_anti"), "kept")
    ids = kept.where("conv_id is not null").select("conv_id")
    # conversations of one turn whose rows have no id: one stands for each digest
    lost = whole.where("conv_id is null").select("conv_id", "turns", F.element_at("chain", -1).alias("digest")).join(kept.where("conv_id is null").select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    return whole.where("conv_id is not null").join(ids, "conv_id", "left_semi").select("conv_id", "turns").unionByName(lost.select("conv_id", "turns"))


def rendered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): each turn as opening mark, role, line end, text, closing mark and line end. Marks inside a role or text get a space, so they cannot end a turn; nulls are empty."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(CLOSE + "\n"))), "")
    return conversations.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(maximal_conversations(table(spark, sf_dir, "conversations")))


OP5_SQL = f"""
WITH r AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations),
c AS (SELECT conv_id, own, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t FROM r GROUP BY conv_id, own),
k AS (SELECT conv_id, own, t, CAST(to_json(t) AS VARCHAR) AS k FROM c),
p AS (SELECT DISTINCT CAST(to_json(t[1:i]) AS VARCHAR) AS k FROM (SELECT t, unnest(range(1, len(t))) AS i FROM c)),
m AS (SELECT k, min(conv_id) AS conv_id, CASE WHEN min(conv_id) IS NULL THEN min(own) END AS own FROM k WHERE k NOT IN (SELECT k FROM p) GROUP BY k)
SELECT c.conv_id, CAST(len(t) AS BIGINT) AS n_turns, array_to_string(list_transform(t, lambda x: '{OPEN}' || replace(replace(coalesce(x.role, ''), '{OPEN}', '< |im_start|>'), '{CLOSE}', '< |im_end|>')
  || chr(10) || replace(replace(coalesce(x.text, ''), '{OPEN}', '< |im_start|>'), '{CLOSE}', '< |im_end|>') || '{CLOSE}' || chr(10)), '') AS text
FROM c JOIN m ON c.conv_id IS NOT DISTINCT FROM m.conv_id AND c.own IS NOT DISTINCT FROM m.own
"""
