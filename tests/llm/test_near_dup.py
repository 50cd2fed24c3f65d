"""Near-duplicates against all pairs, and the cases that the docstrings define."""

import random

import numpy as np
import pytest

from loomwork.llm import near_dup as N
from loomwork.llm.components import connected_components
from loomwork.llm.common import Scratch


def words(rnd, n, vocabulary=4000):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, width=5):
    w = (text or "").encode().translate(N.LOWER).split()
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*[w[i:] for i in range(width)]))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[find(i)] = min(k, best.get(find(i), k))
    out = []
    for i, (k, _) in enumerate(rows):
        c = best.get(find(i)) if sets[i] else k
        out.append((k, len(sets[i]), c, k == c))
    return out


def corpus():
    rnd = random.Random(5)
    texts = []
    for _ in range(12):
        base = words(rnd, rnd.randint(60, 200))
        for _ in range(rnd.randint(1, 8)):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            texts.append(" ".join(w))
    passage = words(rnd, 60)
    texts += [" ".join(words(rnd, 150) + passage) for _ in range(15)]
    texts += ["A B  c", "a b c", "one", "", None, "   \n", texts[0], texts[0].upper(), "word " * 3000]
    return [(i * 3 % 1000, t) for i, t in enumerate(texts)]


def collect(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("block", [256, 3])
def test_equals_all_pairs(spark, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collect(N.near_duplicates(df, block_docs=block)) == sorted(brute(rows), key=repr)


def test_large_family_in_small_blocks(spark):
    """A group whose members are often not linked to each other, cut into many blocks: no link may be lost."""
    rnd = random.Random(9)
    base = words(rnd, 150)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(99999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(N.near_duplicates(df, block_docs=8)) == sorted(brute(rows), key=repr)


def test_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(7, "a b c d e f g", 1), (7, "a b c d e f g", 2), (None, "a b c d e f g", 3), (None, "other words stand here alone now", 4), (9, None, 5), (9, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumnRenamed("component_id", "fp")
    got = collect(N.near_duplicates(df))
    assert (7, 3, 7, True) in got and got.count((7, 3, 7, True)) == 2 and (None, 3, 7, False) in got
    assert (None, 2, None, True) in got and got.count((9, 0, 9, True)) == 2
    kept = [tuple(r) for r in N.one_of_each(df).collect()]
    assert len(kept) == 4 and df.columns == N.one_of_each(df).columns
    assert sum(r[1] == "a b c d e f g" for r in kept) == 1
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert N.one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rnd.randrange(500, 560), rnd.randrange(500, 560)) for _ in range(25)] + [(None, 3), (8, 8)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m), todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    a, b = N._multipliers(320)
    for j, most in ((0.95, 0.06), (0.85, 0.12)):
        n = 400
        both = round(2 * n * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        s = [N.odd_sketch(N.min_hashes(np.unique(y), a, b), 512) for y in (x[:n], x[n - both : 2 * n - both])]
        z = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert abs(float(N.sketch_similarity(np.array(z), 512, 320)) - j) < most


def test_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    want = sorted(con.sql(N.OP3_SQL).fetchall(), key=repr)
    assert collect(N.op3_near_dup(spark, sf)) == want


def test_banding_misses_few():
    assert N.banding(85) == (40, 8)
    for percent in range(60, 100):
        bands, rows = N.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 3e-6


def test_lower_thresholds_miss_no_pair(spark):
    """Pairs just at the threshold, which the bands of 0.85 would often not bring together."""
    rnd, rows = random.Random(3), []
    for k in range(60):  # 70 of 100 shingles in common
        base = [f"{k}w{i}" for i in range(74)]
        rows += [(2 * k + j, " ".join(base + [f"{k}x{j}y{rnd.random()}" for _ in range(15)])) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(N.near_duplicates(df, percent=70)) == sorted(brute(rows, 70), key=repr)
