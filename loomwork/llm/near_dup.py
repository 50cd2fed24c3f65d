"""MinHash near-duplicate detection with odd sketches.

Stages, all over whole texts and all rows:

1. One Arrow pass gives each text its shingle-set fingerprint, MinHash bands and odd sketch (MinHash samples folded into
   a parity bitmap).
2. Texts with equal shingle sets become one class (counted on the map side), so groups of exact copies of any size are
   one node from here on.
3. Band buckets link class and smallest class of the bucket; their connected components are coarse candidate groups.
4. Inside a group, blocks of a bounded number of classes are compared: pairs that share a band and whose odd sketches'
   XOR population count estimates a similarity not far below the threshold are confirmed on full shingle sets, most
   similar first, skipping pairs that are connected already. A block gives a spanning forest, never all pairs.
5. Groups of more than one block compare each block with itself and a hub block. What then is outside the group's
   largest component (its rest) is grouped anew by rare shingles: two sets that are similar enough share one of the
   rarest few of each (see _refined), which members of a family with one template and different contents do not. Fine
   groups of one block are compared there; of larger ones, the rest meets every block. Every pair that shares a band is
   so either connected, or compared, or shown to be apart by its rare shingles.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SQL_SPACED_WORDS, Scratch, binary_texts, frees, mix64, table, unpacked, whole_row, word_hashes
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 40, 8  #: A pair of similarity 0.85 shares no band with probability (1 - 0.85**8)**40 = 3e-6.
MISS = 3e-6  #: A pair just at the threshold shares no band with this probability at most.
SKETCH_BITS = 512
SKETCH_MARGIN = 0.15  #: The sketch rejects a pair only if it estimates this much below the threshold: about 6 standard errors.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000
COUNTERS = 2**20  #: Of shingles by hash, to tell rare from frequent ones; two that share a counter are only ordered worse.
_P = np.uint64(0x9E3779B97F4A7C15)


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(20240229)
    return rng.randint(0, 2**32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.randint(0, 2**32, k, dtype=np.uint64).astype(np.uint32)


def banding(percent: int) -> tuple[int, int]:
    """How many bands of how many rows miss no more than MISS of the pairs just at the threshold: 40 of 8 for 85, 55 of 7 for 80."""
    rows = min(ROWS, max(1, percent // 5 - 9))
    return max(BANDS, math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** rows)))), rows


def shingle_set(text: bytes, hashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; fewer words than the width are one shingle; no word, none."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < width:
        x = np.uint64(n)
        for v in h:
            x = np.uint64((int(x) * int(_P) + int(v)) & 0xFFFFFFFFFFFFFFFF)
        return mix64(np.array([x], np.uint64) + np.uint64(1))
    x = h[: n - width + 1].copy()
    for j in range(1, width):
        x = x * _P + h[j : n - width + 1 + j]
    return np.unique(mix64(x))


def min_hashes(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        v = x[i : i + 256, None] * a
        v += b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(axis=0), out=out)
    return out


def band_keys(sample: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    for column in sample.reshape(bands, rows).astype(np.uint64).T:
        x = mix64(x * _P + column)
    return x.view(np.int64)


def odd_sketch(sample: np.ndarray, bits: int) -> np.ndarray:
    """Each sample, with its number, flips one bit: the bitmap holds parities, so equal samples of two texts cancel in the XOR."""
    at = mix64(sample.astype(np.uint64) + (np.arange(len(sample), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def sketch_similarity(differing: np.ndarray, bits: int, samples: int) -> np.ndarray:
    """The similarity that a XOR population count stands for; beyond half of the bits, 0."""
    d = -bits / 2 * np.log(np.maximum(1 - 2 * differing / bits, 1e-9))
    return np.clip(1 - d / (2 * samples), 0, 1)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, fp, bands, sketch) of each row; fp is null for texts without a word."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        import pyarrow as pa

        hashes, (a, b) = word_hashes(), _multipliers(bands * rows)
        for batch in batches:
            ns, fps, keys, sketches = [], [], [], []
            for text in binary_texts(batch):
                items = shingle_set(text, hashes)
                ns.append(len(items))
                if not len(items):
                    fps.append(None), keys.append(None), sketches.append(None)
                    continue
                sample = min_hashes(items, a, b)
                fps.append(xxhash.xxh3_128_digest(items.tobytes()))
                keys.append(band_keys(sample, bands, rows))
                sketches.append(odd_sketch(sample, bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "fp", "bands", "sketch"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frees(run), schema)


def _forest(members, percent: int, bits: int, samples: int, margin: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the members: dicts of cid, label, bands, sketch and text. Members of one label count as connected."""
    m, hashes = len(members), word_hashes(50_000)
    if m < 2:
        return []
    sets = [shingle_set(x["text"], hashes) for x in members]
    size = np.array([len(s) for s in sets], np.int64)
    keys = np.stack([np.asarray(x["bands"], np.int64) for x in members])
    bitmap = np.frombuffer(b"".join(x["sketch"] for x in members), np.uint64).reshape(m, -1)
    parent = list(range(m))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    for i, x in enumerate(members):
        if (label := x.get("label")) is not None:
            parent[find(i)] = find(seen.setdefault(label, i))
    shared = np.zeros((m, m), bool)
    for band in keys.T:
        shared |= band[:, None] == band
    apart = np.zeros((m, m), np.uint16)
    for word in bitmap.T:
        apart += np.bitwise_count(word[:, None] ^ word)
    likely = sketch_similarity(apart, bits, samples)
    shared &= likely >= percent / 100 - margin
    shared &= 100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)
    left, right = np.nonzero(np.triu(shared, 1))
    order = np.argsort(-likely[left, right], kind="stable")
    out = []
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        if (x := find(i)) == (y := find(j)):
            continue
        a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
        if 100 * both >= percent * (len(a) + len(b) - both):
            parent[x] = y
            out.append((members[i]["cid"], members[j]["cid"]))
    return out


def _block_edges(blocks: DataFrame, percent: int, bits: int, samples: int, margin: float) -> DataFrame:
    """blocks(block string, cid, label, bands, sketch, text): one spanning forest for each block, whose size is bounded."""

    def run(piece):
        import pyarrow as pa

        rows = {x["cid"]: x for x in piece.to_pylist()}  # the hub block meets itself once
        edges = _forest([rows[k] for k in sorted(rows)], percent, bits, samples, margin)
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    return blocks.groupBy("block").applyInArrow(run, "a long, b long")


def _counter_of(items: np.ndarray, gid: int) -> np.ndarray:
    return (mix64(items ^ np.uint64(gid & 0xFFFFFFFFFFFFFFFF)) % np.uint64(COUNTERS)).astype(np.int64)


def _shingle_counts(members: DataFrame) -> np.ndarray:
    """members(gid, text): how many members of its group have the shingles of each counter; at most COUNTERS numbers reach the driver."""

    def run(batches):
        import pyarrow as pa

        hashes, total = word_hashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for gid, text in zip(batch.column("gid").to_pylist(), binary_texts(batch), strict=True):
                np.add.at(total, _counter_of(shingle_set(text, hashes), gid), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(total[at[i : i + 100_000]])], names=["at", "n"])

    got = members.select("gid", "text").mapInArrow(frees(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _refined(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """members(gid, cid, label, rest, text) -> (cid, fine): finer groups that keep every link of a rest member with another label together.

    In each group the shingles have one order, from rare to frequent. Sets of a and b shingles that are linked share at
    least (a + b) * percent / (100 + percent), so the first one that they share, the i-th of one and the j-th of the
    other, has at least so many shingles from there on in both: it is among the first a - a * percent / 100 of its set,
    and in one of the two sets, the smaller, among the first a - 2 a * percent / (100 + percent), called early here. Only
    shingles that a rest member, an early one and two labels have can be it; whoever has such a one is in one fine group.
    """
    counts = scratch.spark.sparkContext.broadcast(_shingle_counts(members))

    def run(batches):
        import pyarrow as pa

        hashes, often = word_hashes(), counts.value
        for batch in batches:
            for gid, cid, label, rest, text in zip(*[batch.column(c).to_pylist() for c in ("gid", "cid", "label", "rest")], binary_texts(batch), strict=True):
                items = shingle_set(text, hashes)
                n = len(items)
                items = items[np.lexsort((items, often[_counter_of(items, gid)]))][: n - -(-n * percent // 100) + 1]
                early = np.arange(len(items)) <= n - -(-2 * n * percent // (100 + percent))
                one = lambda x, kind, k=len(items): pa.array([x] * k, kind)
                yield pa.RecordBatch.from_arrays([one(gid, pa.int64()), pa.array(items.view(np.int64)), one(cid, pa.int64()), one(label, pa.int64()), one(rest, pa.bool_()), pa.array(early)], names=["gid", "h", "cid", "label", "rest", "early"])

    rare = scratch.keep(members.select("gid", "cid", "label", "rest", "text").mapInArrow(frees(run), "gid long, h long, cid long, label long, rest boolean, early boolean"), "rare")
    heads = rare.groupBy("gid", "h").agg(F.min("cid").alias("head"), F.bool_or("rest").alias("r"), F.bool_or("early").alias("e"), (F.min("label") < F.max("label")).alias("l")).where("r and e and l").select("gid", "h", "head")
    fine = connected_components(rare.join(heads, ["gid", "h"]).where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")), scratch)
    scratch.drop(rare)
    return fine.select(F.col("node").alias("cid"), F.col("label").alias("fine"))


def _chunk(count: str, block_docs: int, block_shingles: int) -> Column:
    """Number of blocks of a group, from its members and the sizes of their sets (column n)."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n") / block_shingles)).alias(count)


def _rest_blocks(ready: DataFrame, labels: DataFrame, percent: int, scratch: Scratch, block_docs: int, block_shingles: int) -> DataFrame | None:
    """Blocks (block, cid, label, bands, sketch, text) in which what is outside its group's largest component meets all that it may be linked to; None if nothing is outside."""
    large = scratch.keep(ready.where("chunks > 1").select("cid", "gid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "large")
    main = large.groupBy("gid", "label").count().groupBy("gid").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    marked = scratch.keep(large.join(main, "gid").select("gid", "cid", "label", (F.col("label") != F.col("main")).alias("rest")), "marked")
    open_ = marked.where("rest").select("gid").distinct()
    if open_.isEmpty():
        return None
    members = ready.drop("gid").join(marked.join(open_, "gid", "left_semi"), "cid").select("gid", "cid", "label", "rest", "n", "bands", "sketch", "text")
    members = scratch.keep(members, "open")
    fine = scratch.keep(_refined(members, percent, scratch), "fine")
    members = members.drop("gid").join(fine, "cid")
    sizes = scratch.keep(members.groupBy("fine").agg(_chunk("chunks", block_docs, block_shingles), F.ceil(F.count(F.when(F.col("rest"), 1)) / block_docs).alias("parts")), "sizes")
    members = scratch.keep(members.join(sizes, "fine").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks"))).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("parts"))), "fine-members")
    columns = ["cid", "label", "bands", "sketch", "text"]
    name = F.concat_ws(":", "fine", "part", "chunk").alias("block")
    small = members.where("chunks = 1").select(F.col("fine").cast("string").alias("block"), *columns)
    many = members.where("chunks > 1")
    every = lambda c, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(c)
    own = many.where("rest").select("fine", *columns, "part", every("chunk", "chunks")).select(name, *columns)
    met = many.select("fine", *columns, "chunk", every("part", "parts")).select(name, *columns)
    return small.unionByName(own).unionByName(met)


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int | None = None, rows: int | None = None, bits: int = SKETCH_BITS, margin: float = SKETCH_MARGIN, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(signatures of the rows, (fp, label, component_id) of each class)."""
    fit = banding(percent)
    bands, rows = bands or fit[0], rows or fit[1]
    spark, samples = docs.sparkSession, bands * rows
    scratch = Scratch(spark, "near-dup")
    marks = scratch.keep(signatures(docs, id_col, text_col, bands, rows, bits), "signatures")
    classes = marks.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    member = scratch.keep(classes.select("cid", F.posexplode("bands").alias("band", "key")).select("key", "cid"), "members")
    heads = member.groupBy("key").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    coarse = connected_components(member.join(heads, "key").where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")), scratch)
    scratch.drop(member)

    grouped = coarse.select(F.col("node").alias("cid"), F.col("label").alias("gid")).join(classes, "cid")
    sizes = grouped.groupBy("gid").agg(_chunk("chunks", block_docs, block_shingles))
    # the text of one row of each class that has a candidate
    wanted = grouped.join(sizes, "gid").select("cid", "gid", "chunks", "n", "bands", "sketch", "fp", "rep", F.pmod(F.xxhash64("cid"), F.col("chunks")).alias("chunk"))
    wanted = scratch.keep(wanted, "wanted")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = marks.select("doc_id", "fp").where("fp is not null")
    needed = wanted.select("cid", "fp", "rep")
    narrow = found.join(needed, (found.fp == needed.fp) & found.doc_id.eqNullSafe(needed.rep)).select("cid", "doc_id", needed.fp).dropDuplicates(["cid"])
    # an id may stand on several rows, so the fingerprint of the text decides
    hit = texts.join(narrow, texts.doc_id.eqNullSafe(narrow.doc_id)).select("cid", "fp", F.col("text").cast("binary").alias("text"))
    ready = scratch.keep(_matching(hit).dropDuplicates(["cid"]).join(wanted.drop("fp", "rep"), "cid"), "ready")
    scratch.drop(wanted)

    none = F.lit(None).cast("long")
    hub = ready.where("chunks > 1 and chunk = 0").withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("long"), F.col("chunks") - 1)))
    first = ready.where("chunks = 1 or chunk > 0").unionByName(hub)
    blocks = first.select(F.concat_ws(":", F.col("gid").cast("string"), F.col("chunk").cast("string")).alias("block"), "cid", none.alias("label"), "bands", "sketch", "text")
    edges = scratch.keep(_block_edges(blocks, percent, bits, samples, margin), "links")
    labels = connected_components(edges, scratch)
    pieces = _rest_blocks(ready, labels, percent, scratch, block_docs, block_shingles)
    if pieces is not None:
        more = scratch.keep(_block_edges(pieces, percent, bits, samples, margin), "links")
        labels = connected_components(edges.unionByName(more), scratch)

    classed = classes.select("cid", "fp", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    classed = scratch.keep(classed, "classed")
    smallest = classed.groupBy("label").agg(F.min("rep").alias("component_id"))
    ends = scratch.keep(classed.join(smallest, "label").select("fp", "label", "component_id"), "ends")
    scratch.only(marks, ends)
    return marks, ends


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_shingles (size of the set of 5-word shingles), component_id (smallest doc_id that links reach), kept.

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets. Null or wordless texts have
    n_shingles 0, link with nothing and keep their own id. Rows that repeat an id are rows of their own: equal or linked
    texts share a component, and every row that bears the component's id is kept. A null id is never smallest; it is the
    component's only if no member has an id, and then such rows are kept. Other columns are ignored; an empty table gives
    an empty result.
    """
    marks, ends = _grouped(docs, id_col, text_col, **options)
    out = marks.select("doc_id", "n_shingles", "fp").join(ends, "fp", "left")
    out = out.withColumn("component_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _matching(hit: DataFrame) -> DataFrame:
    """hit(cid, fp, text): the rows whose text has the fingerprint."""

    def run(batches):
        import pyarrow as pa

        hashes = word_hashes()
        for batch in batches:
            fine = [xxhash.xxh3_128_digest(shingle_set(t, hashes).tobytes()) == f for t, f in zip(binary_texts(batch), batch.column("fp").to_pylist(), strict=True)]
            yield batch.filter(pa.array(fine, pa.bool_())).select(["cid", "text"])

    return hit.mapInArrow(frees(run), "cid long, text binary")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their group, with their columns, whatever their names: one row that bears the component's id for each group of linked texts.

    Rows without a word are in no group and stay. Rows are matched by their text, so repeated ids do no harm; of rows
    that repeat both the component's id and a text of its group, one stays, whichever. A null id, repeated rows and an
    empty table are treated as near_duplicates() says.
    """
    _, ends = _grouped(docs, id_col, text_col, **options)
    rows, text_at = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("doc_id")), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        hashes, part, wordless = word_hashes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, has = [], []
            for t in batch.column("row").field(text_at).cast(pa.binary()).to_pylist():
                items = shingle_set(t or b"", hashes)
                has.append(len(items) > 0)
                wordless += not len(items)  # a key of its own, so that such rows do not meet in one task
                keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else f"{part}:{wordless}".encode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(has)], names=[*batch.schema.names, "fp", "has"])

    rows = rows.mapInArrow(frees(run), T.StructType([*rows.schema.fields, T.StructField("fp", T.BinaryType()), T.StructField("has", T.BooleanType())]))
    # by text and id, so that copies of one text do not meet in one task
    heads = ends.select(F.col("fp").alias("head"), "label", "component_id")
    met = rows.join(heads, (rows.fp == heads["head"]) & rows.doc_id.eqNullSafe(heads.component_id), "left").where(~F.col("has") | F.col("label").isNotNull())
    return met.withColumn("alone", F.when(~F.col("has"), F.col("fp"))).dropDuplicates(["label", "alone"]).select(*unpacked(docs))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {SQL_SPACED_WORDS} AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS s FROM w),
c AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
x AS (SELECT c, n, unnest(s) AS g FROM c),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.c <> b.c GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
t(a, b) AS (SELECT c, c FROM c UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
m AS (SELECT a, min(b) AS m FROM t GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.m, s.doc_id) AS component_id, s.doc_id = coalesce(m.m, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.a = c.c
"""
