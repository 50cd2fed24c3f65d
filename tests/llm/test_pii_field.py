"""The field: its marginals on graphs with loops, what the skip edges are worth, and bounds that must not be there."""

import itertools
import random
import time

import numpy as np

from loomwork.llm import pii as P

M = len(P.LABELS)


def test_loopy_marginals_are_near_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(5):
        n = 5
        s, t, w = rng.normal(size=(n, M)), rng.normal(size=(M, M)) * 0.4, rng.uniform(0, 1, M)
        chain, skips = np.array([[0, 1], [1, 2], [2, 3], [3, 4]]), np.array([[0, 3], [1, 4]])
        got = P.marginals(s, chain, skips, t, w, rounds=60)
        want = np.zeros((n, M))
        for at in itertools.product(range(M), repeat=n):
            x = sum(s[i, at[i]] for i in range(n)) + sum(t[at[a], at[b]] for a, b in chain) + sum(w[at[a]] for a, b in skips if at[a] == at[b])
            for i in range(n):
                want[i, at[i]] += np.exp(x)
        want /= want.sum(1, keepdims=True)
        assert np.abs(got - want).max() < 0.06


def documents(rnd, n=240):
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def card():
        x = d(15)
        return next(x + c for c in "0123456789" if P.luhn(x + c))

    out = []
    for i in range(n):
        kind = i % 4
        entity = [f"u{d(3)}.x@mail{d(2)}.example.org", ".".join(str(rnd.randrange(256)) for _ in range(4)), card(), f"+1 ({d(3)}) 555-{d(4)}"][kind]
        out.append((kind, entity, f"Some words {d(4)} and {entity} then more, token = \"{d(6)}ab{d(12)}ef\" as {d(2)}.{d(1)}. said"))
    return out


def test_skip_edges_find_what_the_patterns_miss(spark):
    rnd = random.Random(8)
    rows = documents(rnd)
    train = spark.createDataFrame([(t,) for _, _, t in rows], "text string")
    field = P.trained_field(train)
    texts, want = [], []
    for kind, entity, text in documents(rnd, 160):
        other = P.degraded(kind, entity, rnd)
        start = len(text) + len(" and again ")
        texts.append(f"{text} and again {other} there")
        want.append((start, kind, start + len(other)))
    recall = {}
    for skips in (True, False):
        found = P.search(texts, field, skips)
        recall[skips] = [sum(w in more for w, (_, more) in zip(want, found, strict=True) if w[1] == k) / 40 for k in range(4)]
        assert all(base == P.base_spans(t) for t, (base, _) in zip(texts, found, strict=True))
    assert min(recall[True]) >= 0.9 and sum(recall[False]) < sum(recall[True]) - 1.5
    # the same shapes without an entity that they repeat are left alone
    decoys = [f"Some words and (314) 555-{1000 + i} or 12{i:02d}.5555.6666.777{i % 10} there" for i in range(60)]
    assert sum(len(more) for _, more in P.search(decoys, field)) == 0


def test_secrets_and_their_repeats(spark):
    rnd = random.Random(9)
    field = P.trained_field(spark.createDataFrame([(t,) for _, _, t in documents(rnd)], "text string"))
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'first token = "{key}" and later only {key} stands'
    ((_, more),) = P.search([text], field)
    assert [(text[a:b], P.FOUND[k]) for a, k, b in more] == [(key, "secret"), (key, "secret")]


def test_bounds_that_are_not_there():
    text = "0" * 4500 + "1.1.1.1"
    assert P.base_spans(text) == [(0, 1, len(text))]
    many = " ".join(f"a{i}@b.org" for i in range(8000))
    t = time.perf_counter()
    places, _, observed, _, _ = P.graph(many, P.base_spans(many))
    assert len(places) == 8000 and set(observed) == {1} and time.perf_counter() - t < 3


def test_result_columns(spark):
    rows = [(1, "mail a@b.org or 10.0.0.1", 5), (1, "mail a@b.org or 10.0.0.1", 6), (None, None, 7), (2, "x" * 300_000 + " a@b.org", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long").withColumnRenamed("spans", "base_sha256")
    got = P.personal_data(df).collect()
    assert sorted(r["n_spans"] for r in got) == [0, 1, 2, 2] and got[0]["spans"] == "email:5:12,ip:16:24"
