"""The lower band, and scores held out by halves."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomwork.llm import quality as Q


def test_lower_band_rejects_boilerplate(spark):
    """Texts of a few words that stand everywhere, in ever new orders, pass the base rules and lie below the band; all others stay."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    few = ["click", "here", "to", "accept", "all", "our", "terms", "now"]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(100)), "en") for i in range(240)]
    rows += [(1000 + i, " ".join(rnd.choice(few) for _ in range(60)), "en") for i in range(8)]
    got = {r["doc_id"]: r for r in Q.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep=["doc_id"]).collect()}
    low = [r for k, r in got.items() if k >= 1000]
    assert all(not r["base_failed"] and not r["kept"] and r["log_ppl"] < r["low"] for r in low)
    assert all(r["kept"] for k, r in got.items() if k < 1000)


def plain_model(texts, others, order):
    """Modified Kneser-Ney of texts by its definition, for the n-grams of texts and others."""
    grams = lambda t: [s[i : i + order] for s in [Q._START * (order - 1) + Q.normalise(t) + Q._END] for i in range(len(s) - order + 1)]
    levels = {order: Counter(g for t in texts for g in grams(t))}
    known = {g for t in [*texts, *others] for g in grams(t)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, context = {}, {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        n = Counter(c.values())
        cuts[k] = [0.0]
        for j in (1, 2, 3):
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            cuts[k].append(min(max(j - (j + 1) * y * n[j + 1] / n[j] if y is not None and n[j] else 0.5 * j, 0.1), j))
        for g, x in c.items():
            context[k][g[:-1]].append(x)
    signs = len({g[-1] for g in known})

    def p(g):
        k = len(g)
        if not k:
            return 1 / signs
        near = context[k][g[:-1]]
        if not near:
            return p(g[1:])
        d = lambda n: cuts[k][min(n, 3)]
        return max(levels[k][g] - d(levels[k][g]), 0) / sum(near) + sum(map(d, near)) / sum(near) * p(g[1:])

    return lambda t: -sum(np.log(p(g)) for g in grams(t))


@pytest.mark.parametrize("bound", [4_000_000, 5])
def test_held_out_scores_equal_the_other_halfs_model(spark, bound):
    rnd = random.Random(9)
    words = ["the", "cat", "Sat", "on", "mat", "9", "été", "zoo", "quark"]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randint(3, 9)]) for _ in range(rnd.randint(50, 70))), rnd.choice(["en", "fr"])) for i in range(30)]
    rows += [(50, rows[0][1], rows[0][2]), (51, "lonely text", "es"), (52, None, "en")]
    got = Q.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep=["doc_id", "text", "lang"], broadcast_entries=bound, held_out=True).collect()
    assert len(got) == len(rows)
    for lang in ("en", "fr", "es"):
        halves = [[t for _, t, x in rows if t and x == lang and Q._half(t) == s] for s in (0, 1)]
        models = [plain_model(halves[s], halves[1 - s], Q.ORDER) for s in (0, 1)]
        for r in got:
            if r["lang"] == lang and r["text"]:
                assert r["log_ppl"] == pytest.approx(models[1 - Q._half(r["text"])](r["text"]) / r["n_words"], rel=1e-5)
