"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Every item is cut into windows of ten consecutive words (a shorter item is one window). Windows of one length form one
matcher: a table tells for each block of two words how far the search may move on, a block that ends a window leads to
the bucket of windows with that end, and a direct comparison of words confirms the occurrence. Words outside the
benchmark's vocabulary stop no search: it moves past them.

The windows go to the executors by broadcast, in blocks of about `block_words` words, so their size is bounded; longer
items are cut. A benchmark beyond that takes one pass for each block, each pass written to the shared folder with the
hits so far, so no machine holds more.
"""

from __future__ import annotations

import hashlib
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SQL_ASCII_WORDS, WORDS, Scratch, frees, table, unpacked, whole_row

WINDOW = 10
BLOCK_WORDS = 500_000  #: Counted by the word rule. Measured: 115 MB in each worker, 400 MB on the driver while they are built.


class WuManber:
    """Finds all occurrences of patterns of one length in sequences of word numbers; -1 stands for words of no pattern.

    The patterns lie in one flat array of word numbers, each given by its start. Blocks of two words are single integers
    a * base + b. The shift table maps each known block to its shift; the bucket of a block is a range of the starts, which
    stand in the order of the block that ends their pattern. Nothing holds an object for each pattern.
    """

    def __init__(self, patterns: dict[tuple[int, ...], int], length: int):
        flat = np.array([w for p in patterns for w in p], np.int32)
        self._prepare(flat, np.arange(len(patterns), dtype=np.int64) * length, length)
        self.numbers = np.array(list(patterns.values()), np.int64)[self.numbers]

    @classmethod
    def over(cls, flat: np.ndarray, starts: list[int], length: int) -> WuManber:
        """The patterns flat[s : s + length]; they are numbered as the starts stand."""
        out = cls.__new__(cls)
        out._prepare(flat, np.asarray(starts, np.int64), length)
        return out

    def _prepare(self, flat, starts, length) -> None:
        self.m, self.b, self.flat = length, min(2, length), flat
        self.base = int(self.flat.max(initial=0)) + 1
        self.default = length - self.b + 1
        block = lambda at: self.flat[at] if self.b == 1 else self.flat[at - 1].astype(np.int64) * self.base + self.flat[at]
        last = block(starts + length - 1)
        order = np.argsort(last, kind="stable")
        self.starts, last = starts[order], last[order]
        self.ends, first = np.unique(last, return_index=True)
        self.cuts = np.append(first, len(last))
        self.numbers = order
        # from far to near, so that the smallest shift of a block stays
        known: dict[int, int] = {}
        for end in range(self.b - 1, length):
            for code in np.unique(block(starts + end)).tolist() if len(starts) else ():
                known[code] = length - 1 - end
        self.shift = known

    def find(self, words: list[int]):
        """(start, number) of each occurrence, by start."""
        m, n, shift, default, base, flat = self.m, len(words), self.shift, self.default, self.base, self.flat
        i = m - 1
        while i < n:
            last = words[i]
            if last < 0:
                i += m  # no window that holds this word can match
                continue
            code = last if self.b == 1 else words[i - 1] * base + last if words[i - 1] >= 0 else -1
            step = shift.get(code, default)
            if step:
                i += step
                continue
            k = int(np.searchsorted(self.ends, code))
            at = words[i - m + 1 : i + 1]
            for j in range(int(self.cuts[k]), int(self.cuts[k + 1])):
                start = int(self.starts[j])
                if flat[start : start + m].tolist() == at:
                    yield i - m + 1, int(self.numbers[j])
            i += 1


def build(items: list[tuple[str | None, bytes]], window: int = WINDOW):
    """(vocabulary, matchers, owners): owners[k] has, for each pattern of matcher k, the ids of its items as one string each, joined by line ends."""
    vocabulary: dict[bytes, int] = {}
    flat, by_length = array("i"), {}
    for item, text in items:
        words = text.translate(WORDS).split()
        size, begin = min(window, len(words)), len(flat)
        flat.extend(vocabulary.setdefault(w, len(vocabulary)) for w in words)
        for k in range(len(words) - size + 1) if size else ():
            known = by_length.setdefault(size, {})
            start, who = known.setdefault(flat[begin + k : begin + k + size].tobytes(), (begin + k, set()))
            if item is not None:
                who.add(item)
    flat = np.array(flat, np.int32)
    matchers, owners = [], []
    for size, known in sorted(by_length.items()):
        matchers.append(WuManber.over(flat, [start for start, _ in known.values()], size))
        owners.append([sys.intern("\n".join(sorted(who))) for _, who in known.values()])
    return vocabulary, matchers, owners


def search(words: list[bytes], vocabulary: dict, matchers: list[WuManber], owners: list[list[str]], hit: set, found: set) -> None:
    """Adds the positions of hit words and the ids of items to hit and found."""
    numbers = [vocabulary.get(w, -1) for w in words]
    for matcher, own in zip(matchers, owners, strict=True):
        for start, number in matcher.find(numbers):
            hit.update(range(start, start + matcher.m))
            if own[number]:
                found.update(own[number].split("\n"))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int):
    """The benchmark's rows in lists of about block_words words, one at a time on the driver. Longer items are cut into parts that share window - 1 words, so no window is lost and none is new."""
    rows, held, size = [], 0, max(block_words, window)
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = (r["t"] or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
        at = 0
        while True:
            end = len(words) if len(words) - at < size + window else at + size
            rows.append((r["i"], b" ".join(words[at:end])))
            held += end - at
            if held >= block_words:
                yield rows
                rows, held = [], 0
            if end == len(words):
                break
            at = end - window + 1
    yield rows


_STATE = [T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
RESULT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def _judged(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, window: int, block_words: int) -> DataFrame:
    """(row, the results): row is a struct of all columns of docs, so their names clash with none of ours."""
    spark = docs.sparkSession
    scratch, passes, waiting = Scratch(spark, "decontaminate"), None, None
    rows, at = docs.select(whole_row(docs).alias("row")), docs.columns.index(text_col)
    for items in _blocks(benchmark, item_id, item_text, block_words, window):
        if waiting is not None:
            before, passes = passes, scratch.keep(_pass(rows if passes is None else passes, at, waiting, False), "pass")
            if before is not None:
                scratch.drop(before)
        waiting = spark.sparkContext.broadcast(build(items, window))
    return _pass(rows if passes is None else passes, at, waiting, True)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 and contaminated (n_hit > 0).

    items_sha256 is the lowercase hex digest of the ids of the items with occurring windows, sorted as strings and joined
    by commas (of the empty string if none occurs). Null or wordless texts have no words, on either side. An item
    without an id marks words, but is not counted; rows of one id are one item. Columns of docs that bear a result's name
    are replaced; other names do not matter. Rows are judged one by one, so order, repeated rows and empty tables need no
    care. Texts of any length are searched whole.
    """
    own = [c for c in docs.columns if c not in dict(RESULT)]
    judged = _judged(docs, benchmark, text_col, item_id, item_text, window, block_words)
    return judged.select(*[F.col("row")[c].alias(c) for c in own], *[n for n, _ in RESULT])


def _pass(rows: DataFrame, text_at: int, model, last: bool) -> DataFrame:
    """rows with the hits of one block of the benchmark added to those so far; the last pass turns them into the result."""
    schema = T.StructType([rows.schema["row"]] + ([T.StructField(n, k) for n, k in RESULT] if last else _STATE))

    def run(batches):
        import pyarrow as pa

        vocabulary, matchers, owners = model.value
        for batch in batches:
            before = (batch.column("hit").to_pylist(), batch.column("items").to_pylist()) if "hit" in batch.schema.names else None
            hits, items, sizes = [], [], []
            for k, text in enumerate(batch.column("row").field(text_at).cast(pa.binary()).to_pylist()):
                hit, found = (set(before[0][k]), set(before[1][k])) if before else (set(), set())
                words = (text or b"").translate(WORDS).split()
                search(words, vocabulary, matchers, owners, hit, found)
                hits.append(hit), items.append(sorted(found)), sizes.append(len(words))
            if last:
                added = [
                    pa.array(sizes, pa.int64()),
                    pa.array([len(h) for h in hits], pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([bool(h) for h in hits], pa.bool_()),
                ]
            else:
                added = [pa.array([sorted(h) for h in hits], pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *added], names=schema.names)

    return rows.mapInArrow(frees(run), schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *[n for n, _ in RESULT])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without any occurrence of a benchmark window, with their columns, whatever their names; see contamination()."""
    judged = _judged(docs, benchmark, text_col, "item_id", "text", WINDOW, BLOCK_WORDS)
    return judged.where("not contaminated").select(*unpacked(docs))


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {SQL_ASCII_WORDS} AS w FROM documents)),
b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m FROM (SELECT item_id, {SQL_ASCII_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
x AS (SELECT d.r, i, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT d.r, w, m, unnest(range(1, n - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE n >= m) d),
h AS (SELECT x.r, x.i, x.m, p.item_id FROM x JOIN p ON x.p = p.p AND x.m = p.m),
k AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
