"""License scan: exact phrases, and fuzzy search for short notices.

A text is reduced to its words (lower case, joined by single spaces). A notice of k allowed edits is split into k + 1
pieces; by the pigeonhole principle a passage within k edits holds at least one piece unchanged, so exact piece matches
locate every candidate. A bit-parallel pass over the candidates' surroundings throws out what has more edits; the regex
library then looks for the notice with at most k edits in what is left, counts the edits and reports the span.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, binary_texts, frees, small_batches, table

#: Base phrases and their labels: fixed values.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Short notices by label, as words.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
]
CHARS_PER_EDIT = 12  #: A notice of n characters allows n // 12 edits, 1 at least.


class Notice:
    """A notice with its pieces, their places in it, and the pattern that verifies a candidate."""

    def __init__(self, text: str, label: str, chars_per_edit: int = CHARS_PER_EDIT):
        self.text, self.label, self.edits = text, label, max(1, len(text) // chars_per_edit)
        cuts = [len(text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(f"(?e)(?:{regex.escape(text)}){{e<={self.edits}}}")
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def windows(self, words: str) -> list[list[int]]:
        """Ranges of the text that hold every passage within the allowed edits, joined where they overlap."""
        found = []
        for piece, offset in self.pieces:
            at = words.find(piece)
            while at >= 0:
                start = at - offset - self.edits
                found.append((max(start, 0), min(start + len(self.text) + 3 * self.edits, len(words))))
                at = words.find(piece, at + 1)
        joined: list[list[int]] = []
        for a, b in sorted(found):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        return joined

    def near(self, words: str, a: int, b: int) -> list[list[int]]:
        """Parts of words[a:b] that hold every passage within the allowed edits: one bit-parallel pass over the range gives the least edits of a passage that ends at each place, so the pattern runs only where it matches."""
        whole = (1 << len(self.text)) - 1
        top, masks, up, down, edits, found = len(self.text) - 1, self.masks, whole, 0, len(self.text), []
        for at in range(a, b):
            same = masks.get(words[at], 0)
            down_or_same = same | down
            across = (((same & up) + up) ^ up) | same
            plus, minus = (down | ~(across | up)) & whole, up & across
            edits += (plus >> top) - (minus >> top)
            plus, minus = plus << 1, minus << 1
            up, down = (minus | ~(down_or_same | plus)) & whole, plus & down_or_same & whole
            if edits <= self.edits:
                start, end = max(a, at + 1 - len(self.text) - self.edits), min(b, at + 1 + self.edits)
                if found and start <= found[-1][1]:
                    found[-1][1] = end
                else:
                    found.append([start, end])
        return found

    def matches(self, words: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) of non-overlapping passages, leftmost first."""
        out = []
        for a, b in self.windows(words):
            for x, y in self.near(words, a, b):
                for m in self.pattern.finditer(words, x, y):
                    out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
        return out


def _places(padded: bytes, phrase: bytes) -> list[int]:
    """Word numbers of the phrase's places, counted in one pass; places may share words, so the search goes on one space further."""
    out, word, last, at = [], 0, 0, padded.find(phrase)
    while at >= 0:
        word, last = word + padded.count(b" ", last, at), at
        out.append(word)
        at = padded.find(phrase, at + 1)
    return out


def scan(text: bytes, phrases, notices) -> dict:
    """The result of one text: see licenses()."""
    words = text.translate(WORDS).split()
    padded = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in phrases:
        found = _places(padded, phrase)
        if found:
            starts += found
            labels.add(label)
    spans, score = [], 1.0 if starts else 0.0
    if notices:
        plain = padded[1:-1].decode("utf-8", "surrogatepass") if len(words) else ""
        found = sorted((a, b, n.label, edits, len(n.text)) for n in notices for a, b, edits in n.matches(plain))
        word = at = 0
        for a, b, label, edits, size in found:  # by place, so words are counted once
            word, at = word + plain.count(" ", at, a), a
            spans.append((word, a, b, label, edits))
            score = max(score, 1 - edits / size)
    return {"n_words": len(words), "starts": starts, "base": labels, "spans": spans, "score": score}


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places where a phrase's words stand one after another; first_word and last_word are the smallest
    and largest of them, as word numbers from 0 (null without one). base_labels are their labels, labels also those of
    the notices found, distinct, sorted and joined by commas. score is 1 for a phrase, else the share of the best notice's
    characters that is unedited, else 0. spans has the notices found: word, start and end (characters of the words joined
    by spaces), label and edits. Null and wordless texts have no words. Rows are judged one by one, so repeated rows get
    equal results and an empty table gives an empty result; of equal starts the shorter span comes first. Other columns are
    ignored, whatever their names. Texts of any length are searched whole, in time in proportion to their length.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
            T.StructField("base_labels", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("edits", T.LongType())]))),
        ]
    )

    def run(batches):
        import pyarrow as pa

        exact = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        fuzzy = [Notice(t, label, chars_per_edit) for t, label in notices]
        span = pa.list_(pa.struct([("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))
        for batch in batches:
            found = [scan(t, exact, fuzzy) for t in binary_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x["n_words"] for x in found], pa.int64()),
                    pa.array([len(x["starts"]) for x in found], pa.int64()),
                    pa.array([min(x["starts"], default=None) for x in found], pa.int64()),
                    pa.array([max(x["starts"], default=None) for x in found], pa.int64()),
                    pa.array([",".join(sorted(x["base"])) for x in found], pa.string()),
                    pa.array([",".join(sorted(x["base"] | {s[3] for s in x["spans"]})) for x in found], pa.string()),
                    pa.array([x["score"] for x in found], pa.float64()),
                    pa.array([[dict(zip(("word", "start", "end", "label", "edits"), s, strict=True)) for s in x["spans"]] for x in found], span),
                ],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frees(run), schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents")).drop("spans")
