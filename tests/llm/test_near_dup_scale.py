"""Families with one template: linked by bands, apart in fact. What is compared must grow with the rows, and no link may be lost."""

import random

import pytest

from loomwork.llm import near_dup as N
from loomwork.llm.common import Scratch

from .test_near_dup import brute, collect, words


def family(rnd, n, shared=120, own=18):
    """Texts that share a template of `shared` words and have `own` words of their own: similarity about shared / (shared + 2 own)."""
    template = words(rnd, shared)
    return [" ".join(template + [f"u{i}x{k}" for k in range(own)]) for i in range(n)]


def compared(spark, texts, monkeypatch):
    """Rows of all blocks that were compared, and the pairs of documents' ids with their components."""
    rows, kept = [0], Scratch.keep

    def keep(self, df, name):
        out = kept(self, df, name)
        if name == "counted":
            rows[0] += out.count()
        return out

    edges = N._block_edges

    def counting(blocks, *a):
        return edges(Scratch(spark, "count").keep(blocks, "counted"), *a)

    monkeypatch.setattr(Scratch, "keep", keep)
    monkeypatch.setattr(N, "_block_edges", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collect(N.near_duplicates(df, block_docs=16))
    monkeypatch.undo()
    return rows[0], got


@pytest.mark.parametrize("own", [12, 25])
def test_block_rows_grow_with_the_rows(spark, monkeypatch, own):
    rnd = random.Random(1)
    texts = family(rnd, 400, own=own)
    few, _ = compared(spark, texts[:200], monkeypatch)
    many, got = compared(spark, texts, monkeypatch)
    assert many <= 2.5 * few and many <= 4 * len(texts)
    assert all(r[2] == r[0] for r in got)


def test_links_inside_a_template_family(spark):
    """Near copies hidden in a family whose other members are apart; sizes differ, so early and late shingles meet."""
    rnd = random.Random(3)
    rows = [(i, t) for i, t in enumerate(family(rnd, 70, 100, 14))]
    for i in range(0, 60, 4):
        w = rows[i][1].split()
        for _ in range(rnd.randint(1, 2)):
            w[rnd.randrange(len(w))] = f"y{rnd.randrange(9999)}"
        rows.append((100 + i, " ".join(w + [f"z{i}{k}" for k in range(rnd.randint(0, 8))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 40):
        assert collect(N.near_duplicates(df, block_docs=block)) == sorted(brute(rows), key=repr)
