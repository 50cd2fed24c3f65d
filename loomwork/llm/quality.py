"""Quality rules with n-gram perplexity: a modified Kneser-Ney model counted by Spark over all documents, and perplexity bands per language.

The n-grams are of characters (five, by default) of the normalised text: lower case, digits as 0, white space as one
space. Their number follows the alphabet and the language, not the vocabulary, so the counts that each task sends are
small beside the text.

The model trains on every row of the table that it scores, so each n-gram that scoring meets has been counted and one
lookup gives its full interpolated probability. With `held_out`, no text is scored by what it taught itself: a hash puts
a text, and all its copies, into one of two halves, n-grams are counted in both halves apart, and each half is scored by
the model of the other. The table then has the n-grams of both halves with their probability under either model, so one
lookup is enough even where the other half lacks an n-gram.

The model is kept in hash arrays sorted by the n-gram's 64-bit hash. They are broadcast only if they have at most
`broadcast_entries` entries; a larger model is joined by hash, which gives the same sums without any array on one machine.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, beside, frees, mix64, table, unpacked, whole_row

ORDER = 5
BROADCAST_ENTRIES = 4_000_000  #: 12 bytes each, 16 with both halves: 64 MB in each worker at most.
#: Interquartile ranges below the first and above the third quartile where the bands end. Checked against labels (see the
#: README): above, 4 takes nearly all texts labelled bad and few others; below, labels do not separate, so 5 takes only the utmost.
LOW_WIDTH, HIGH_WIDTH = 5.0, 4.0
BIN = 0.01  #: Width of a bin of log perplexity per word in the histograms that the quartiles come from.
LEAST_SPREAD = 0.05  #: An interquartile range below this counts as this.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\v\f\r"
CHUNK = 1_000_000  #: n-grams that are hashed at once.
UNSEEN = -20.0  #: Log probability of an n-gram that the model lacks; the model of the same table lacks none.

_START, _END = "\x02", "\x03"
_DIGIT, _SPACE = re.compile(r"[0-9]"), re.compile(r"[ \t-\r]+")


def normalise(text: str) -> str:
    return _SPACE.sub(" ", _DIGIT.sub("0", text.lower())).strip(" ")


def _points(text: str, order: int) -> np.ndarray:
    return np.frombuffer((_START * (order - 1) + normalise(text) + _END).encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray, order: int, lang: int) -> np.ndarray:
    """A 64-bit hash of each window of `order` code points, with the language."""
    n = len(points) - order + 1
    x = np.full(n, lang, np.uint64)
    for j in range(order):
        x = x * np.uint64(0x9E3779B97F4A7C15) + points[j : j + n].astype(np.uint64) + np.uint64(1)
    return mix64(x)


def _lang_key(lang: str | None) -> int:
    return xxhash.xxh64_intdigest(lang.encode()) if lang is not None else 1


def _half(text: str) -> int:
    """Which half a text is in; the other half's model scores it."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) & 1


def ngram_counts(docs: DataFrame, order: int = ORDER, held_out: bool = False) -> DataFrame:
    """(lang, gram, h, n0, n1): how often each character n-gram occurs in each language in either half of the texts (all in n0 unless held_out); a task sends each n-gram once."""

    def run(batches):
        import pyarrow as pa

        def distinct(h):
            codes, unique = pd.factorize(h)
            first = np.full(len(unique), -1, np.int64)
            first[codes[::-1]] = np.arange(len(h))[::-1]
            return codes, unique, first

        def emit(got):
            langs, grams, hs, ns = [], [], [], []
            for lang, parts in got.items():
                h, n, g = (np.concatenate(x) for x in zip(*parts, strict=True))
                codes, unique, first = distinct(h)
                langs += [lang] * len(unique)
                flat = np.ascontiguousarray(g[first]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                grams += [flat[i : i + order] for i in range(0, len(flat), order)]
                hs.append(unique.view(np.int64))
                ns.append(np.stack([np.bincount(codes, weights=n[:, j], minlength=len(unique)) for j in (0, 1)], 1).astype(np.int64))
            for i in range(0, len(langs), 100_000):
                part = slice(i, i + 100_000)
                n = np.concatenate(ns)[part]
                yield pa.RecordBatch.from_arrays([pa.array(langs[part], pa.string()), pa.array(grams[part], pa.string()), pa.array(np.concatenate(hs)[part], pa.int64()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["lang", "gram", "h", "n0", "n1"])

        got: dict = {}
        held = 0
        for batch in batches:
            by: dict = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                key, waiting, sides, size = _lang_key(lang), [], [], 0
                for i, text in enumerate(texts):
                    waiting.append(_points(text, order))
                    sides.append(_half(text) if held_out else 0)
                    size += len(waiting[-1])
                    if size < CHUNK and i + 1 < len(texts):
                        continue
                    h = np.concatenate([_hashes(p, order, key) for p in waiting])
                    codes, unique, first = distinct(h)
                    right = np.bincount(codes, weights=np.repeat(sides, [len(p) - order + 1 for p in waiting]), minlength=len(unique))
                    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(p, order) for p in waiting])
                    got.setdefault(lang, []).append((unique, np.stack([np.bincount(codes, minlength=len(unique)) - right, right], 1).astype(np.int64), windows[first]))
                    held += len(unique)
                    waiting, sides, size = [], [], 0
            if held > 600_000:
                yield from emit(got)
                got, held = {}, 0
        yield from emit(got)

    parts = docs.mapInArrow(frees(run), "lang string, gram string, h long, n0 long, n1 long")
    return parts.groupBy("lang", "gram", "h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


SIDES = (0, 1)


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d10, d20, d30, d11, d21, d31): modified Kneser-Ney discounts of both halves from the counts of counts; where those lack, halves."""
    of = counts.groupBy("lang").agg(*[F.sum(F.when(F.col(f"n{s}") == k, 1).otherwise(0)).cast("double").alias(f"n{k}{s}") for s in SIDES for k in (1, 2, 3, 4)])

    def d(k, s):
        y = F.try_divide(F.col(f"n1{s}"), F.col(f"n1{s}") + 2 * F.col(f"n2{s}"))
        return F.least(F.greatest(F.coalesce(F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}{s}"), F.col(f"n{k}{s}")), F.lit(0.5 * k)), F.lit(0.1)), F.lit(float(k)))

    return of.select("lang", *[d(k, s).alias(f"d{k}{s}") for s in SIDES for k in (1, 2, 3)])


def kneser_ney(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(h, logp0, logp1): the interpolated natural-log probability of each counted n-gram, given its first order - 1 characters, under the model of either half.

    A half that never saw an n-gram's context leaves it to the shorter context; below all is one share for each character.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):  # continuation counts: in how many n-grams one longer it is the end
        ends = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(*[F.count(F.when(F.col(f"n{s}") > 0, 1)).alias(f"n{s}") for s in SIDES])
        levels[k] = scratch.keep(ends, f"level{k}")
    below = None
    for k in range(1, order + 1):
        now = levels[k].join(beside(scratch.keep(_discounts(levels[k]).withColumnRenamed("lang", "dlang"), f"discounts{k}")), F.col("lang").eqNullSafe(F.col("dlang"))).drop("dlang")
        context = Window.partitionBy("lang", F.substring("gram", 1, k - 1))
        cut = {s: F.when(F.col(f"n{s}") == 0, 0.0).when(F.col(f"n{s}") == 1, F.col(f"d1{s}")).when(F.col(f"n{s}") == 2, F.col(f"d2{s}")).otherwise(F.col(f"d3{s}")) for s in SIDES}
        now = now.withColumns({f"cut{s}": cut[s] for s in SIDES})
        now = now.withColumns({f"total{s}": F.sum(f"n{s}").over(context) for s in SIDES} | {f"cuts{s}": F.sum(f"cut{s}").over(context) for s in SIDES})
        own = {s: F.coalesce(F.try_divide(F.greatest(F.col(f"n{s}") - F.col(f"cut{s}"), F.lit(0.0)), F.col(f"total{s}")), F.lit(0.0)) for s in SIDES}
        spare = {s: F.coalesce(F.try_divide(F.col(f"cuts{s}"), F.col(f"total{s}")), F.lit(1.0)) for s in SIDES}
        if below is None:
            now = now.withColumn("share", 1 / F.count(F.lit(1)).over(Window.partitionBy("lang")))
            low = {s: F.col("share") for s in SIDES}
        else:
            shorter = below.select(F.col("lang").alias("llang"), F.col("gram").alias("low"), *[F.col(f"p{s}").alias(f"low{s}") for s in SIDES])
            now = now.join(shorter, F.col("lang").eqNullSafe(F.col("llang")) & (F.substring("gram", 2, k - 1) == F.col("low")))
            low = {s: F.col(f"low{s}") for s in SIDES}
        now = now.withColumns({f"p{s}": own[s] + spare[s] * low[s] for s in SIDES})
        last, below = below, scratch.keep(now.select("lang", "gram", "p0", "p1", *(["h"] if k == order else [])), f"p{k}")
        scratch.drop(levels[k], *([last] if last is not None else []))
    return below.select("h", *[F.log(f"p{s}").cast("float").alias(f"logp{s}") for s in SIDES])


def _rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if (n := len(words)) > 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        w = mix64((h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:])
        codes, unique = pd.factorize(w)
        if len(unique) < len(w):
            twice = (np.bincount(codes) > 1)[codes]
            hit = np.zeros(n, bool)
            for j in range(3):
                hit[j : n - 2 + j] |= twice
            repeat = int(np.count_nonzero(hit))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat


RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def hash_arrays(h: np.ndarray, *logp: np.ndarray) -> tuple[np.ndarray, ...]:
    """The model's arrays: uint64 hashes in ascending order and their float32 log probabilities, of each half's model."""
    order = np.argsort(h)
    return h[order], *[x[order] for x in logp]


def look_up(arrays: tuple[np.ndarray, ...], h: np.ndarray, side: int) -> np.ndarray:
    """The log probability of each hash under the model of a half; the distinct ones are searched for once."""
    keys, logp = arrays[0], arrays[1 + side]
    codes, unique = pd.factorize(h)
    if not len(keys):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
    return np.where(keys[at] == unique, logp[at], np.float32(UNSEEN)).astype(np.float64)[codes]


def _field(batch, where: tuple):
    """A column of a batch, or a field of its struct column."""
    column = batch.column(where[0])
    return column if len(where) == 1 else column.field(where[1])


def _measured(docs: DataFrame, order: int, model, text: tuple, lang: tuple, held_out: bool) -> DataFrame:
    """docs with the rules' columns, n_grams and nll, the sum of negative log probabilities (null without a model). text and lang say where those are: see _field."""

    def run(batches):
        import pyarrow as pa

        arrays = model.value if model is not None else None
        for batch in batches:
            texts, langs = _field(batch, text).to_pylist(), _field(batch, lang).cast(pa.string()).to_pylist()
            rules = [_rules(t) for t in texts]
            counts, sums = [0] * len(texts), [0.0] * len(texts)
            waiting: dict[int, list] = {0: [], 1: []}
            held = 0

            def score():
                for side, of in waiting.items():
                    if not of:
                        continue
                    lengths = [len(h) for _, h in of]
                    logp = look_up(arrays, np.concatenate([h for _, h in of]), side)
                    for (i, _), x in zip(of, np.add.reduceat(logp, np.cumsum([0, *lengths[:-1]])), strict=True):
                        sums[i] = -float(x)
                    of.clear()

            for i, (t, language) in enumerate(zip(texts, langs, strict=True)):
                if not t:
                    continue
                points = _points(t, order)
                counts[i] = len(points) - order + 1
                if arrays is None:
                    continue
                waiting[1 - _half(t) if held_out else 0].append((i, _hashes(points, order, _lang_key(language))))
                held += counts[i]
                if held >= CHUNK:
                    score()
                    held = 0
            score()
            added = [pa.array([r[j] for r in rules], pa.int64()) for j in range(5)] + [pa.array(counts, pa.int64()), pa.array(sums if arrays is not None else [None] * len(texts), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *RULE_COLUMNS, "n_grams", "nll"])

    extra = [T.StructField(c, T.LongType()) for c in (*RULE_COLUMNS, "n_grams")] + [T.StructField("nll", T.DoubleType())]
    return docs.mapInArrow(frees(run), T.StructType([*docs.schema.fields, *extra]))


def _joined_nll(docs: DataFrame, order: int, model: DataFrame, scratch: Scratch, text: tuple, lang: tuple, held_out: bool) -> DataFrame:
    """The same as _measured with a model of any size: each text's n-gram counts join the model by hash."""
    rows = scratch.keep(_measured(docs, order, None, text, lang, held_out).drop("nll").withColumn("at", F.monotonically_increasing_id()), "rows")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row, t, language in zip(batch.column("at").to_pylist(), _field(batch, text).to_pylist(), _field(batch, lang).cast(pa.string()).to_pylist(), strict=True):
                if t:
                    h, n = np.unique(_hashes(_points(t, order), order, _lang_key(language)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row), pa.int64()), pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.full(len(h), 1 - _half(t) if held_out else 0), pa.int32())], names=["at", "h", "n", "side"])

    grams = rows.select("at", *{text[0], lang[0]}).mapInArrow(frees(run), "at long, h long, n long, side int")
    logp = F.when(F.col("side") == 0, F.col("logp0")).otherwise(F.col("logp1")).cast("double")
    sums = grams.join(model, "h").groupBy("at").agg((-F.sum(F.col("n") * logp)).alias("nll"))
    return rows.join(sums, "at", "left").drop("at").withColumn("nll", F.coalesce("nll", F.lit(0.0)))


def bands(scored: DataFrame, low_width: float = LOW_WIDTH, high_width: float = HIGH_WIDTH) -> DataFrame:
    """(lang, low, high): limits of log perplexity per word, so many interquartile ranges beyond the quartiles of the language's distinct texts (by text_key) that pass the base rules."""
    texts = scored.where(~base_failed()).groupBy("lang", "text_key").agg(F.min("log_ppl").alias("log_ppl"))
    bins = texts.groupBy("lang", F.floor(F.col("log_ppl") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang")
    up = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) + 0.5) * BIN
    quartiles = up.groupBy("lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
    return quartiles.select("lang", (F.col("q1") - spread * low_width).alias("low"), (F.col("q3") + spread * high_width).alias("high"))


def base_failed(min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_percent * F.col("n_words"))


def _judged(docs: DataFrame, text_col: str, lang_col: str, keep: list[str], order: int, low_width: float, high_width: float, broadcast_entries: int, held_out: bool) -> DataFrame:
    """(row, the rules' columns, n_grams, log_ppl, low, high, base_failed, kept): row is a struct of the columns `keep` of docs, so their names clash with none of ours."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    text_lang = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = scratch.keep(ngram_counts(text_lang, order, held_out), "counts")
    model = scratch.keep(kneser_ney(counts, order, scratch), "model")
    entries, sides = model.count(), [f"logp{s}" for s in SIDES[: 1 + held_out]]
    columns, where = [(whole_row(docs.select(*keep)) if keep else F.struct(F.lit(0).alias("none"))).alias("row")], []
    for c, name in ((text_col, "text"), (lang_col, "lang")):  # a text that is kept is not sent twice
        if c in keep:
            where.append(("row", keep.index(c)))
        else:
            columns.append(F.col(c).alias(name))
            where.append((name,))
    rows, (text, lang) = docs.select(*columns), where
    if entries <= broadcast_entries:
        got = model.select("h", *sides).toArrow()
        arrays = hash_arrays(got.column("h").to_numpy().view(np.uint64), *[got.column(c).to_numpy() for c in sides])
        measured = _measured(rows, order, spark.sparkContext.broadcast(arrays), text, lang, held_out)
    else:
        measured = _joined_nll(rows, order, model, scratch, text, lang, held_out)
    of = {c: F.col("row")[c_] if len(at) == 2 else F.col(at[0]) for c, c_, at in (("text", text_col, text), ("lang", lang_col, lang))}
    measured = measured.select("row", *RULE_COLUMNS, "n_grams", F.try_divide("nll", "n_words").alias("log_ppl"), of["lang"].cast("string").alias("lang"), F.xxhash64(of["text"]).alias("text_key"))
    scored = scratch.keep(measured, "scored")
    limits = scratch.keep(bands(scored, low_width, high_width).withColumnRenamed("lang", "band_lang"), "bands")
    scratch.only(scored, limits)
    limits = beside(limits)  # one row for each language
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    failed = base_failed()
    fits = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("row", *RULE_COLUMNS, "n_grams", "log_ppl", "low", "high", failed.alias("base_failed"), (~failed & fits).alias("kept"))


def quality_scores(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, order: int = ORDER, low_width: float = LOW_WIDTH, high_width: float = HIGH_WIDTH, broadcast_entries: int = BROADCAST_ENTRIES, held_out: bool = False) -> DataFrame:
    """The columns `keep` of docs, with the rules' counts, n_grams, log_ppl, base_failed, low, high and kept.

    kept is false for rows that fail the base rules (fewer than 50 words, or over half of the words in repeated 3-word
    windows), else whether the log perplexity per word (log_ppl) lies in its language's band, ends included. A null or
    empty text has no words and fails. A null language is a language of its own; one without a text that passes the base
    rules has no band. Repeated rows are scored alike, each counted in the model and once in the band; an empty table
    gives an empty result. Other columns may have any names; those in `keep` should not bear a result's name, or the
    result has two such columns (filter_quality has no such limit). Texts of any length are read whole.
    """
    keep = keep or []
    judged = _judged(docs, text_col, lang_col, keep, order, low_width, high_width, broadcast_entries, held_out)
    return judged.select(*[F.col("row")[c].alias(c) for c in keep], *judged.columns[1:])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *RULE_COLUMNS, "base_failed", "kept", "log_ppl")


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, low_width: float = LOW_WIDTH, high_width: float = HIGH_WIDTH, broadcast_entries: int = BROADCAST_ENTRIES, held_out: bool = False) -> DataFrame:
    """The rows of docs that the rules keep, with their columns, whatever their names; see quality_scores()."""
    judged = _judged(docs, text_col, lang_col, docs.columns, order, low_width, high_width, broadcast_entries, held_out)
    return judged.where("kept").select(*unpacked(docs))
