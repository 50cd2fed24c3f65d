"""Personal data, decontamination, license scan and quality rules against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from loomwork.llm import decontaminate as D
from loomwork.llm import license_scan as L
from loomwork.llm import pii as P
from loomwork.llm import quality as Q

BASE = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(x):
    out = []
    for k, p in enumerate(BASE):
        for m in p.finditer(x):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(q) > 255 for q in m[0].split(".")) or k == 2 and not (14 <= len(d) <= 19 and P.luhn(d)) or k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_patterns():
    rnd = random.Random(2)
    for _ in range(8000):
        x = "".join(rnd.choice("a.@1925+-( )%é\n") for _ in range(rnd.randint(0, 45)))
        assert P.base_spans(x) == plain_spans(x), x
    assert P.base_spans("9" * 100_000) == [] and P.base_spans("a" * 100_000 + "@") == []


def test_pii_result(spark):
    good = "4297648922181334"
    rows = [(1, f"mail eop.13@mail5.example.com and {good} at 70.214.118.188, +1 (314) 555-6532."), (2, None), (3, ""), (3, "plain words only"), (None, "x " * 20_000 + "me@host.org")]
    more = [(100 + i, f"call +1 (314) 555-{1000 + i} now, year {1900 + i}, mail a{i}@b.co, ip 10.1.2.{i}" + f" or again (314) 555-{1000 + i} later" * (i % 12 == 0)) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows + more], "doc_id long, text string, spans string")
    got = P.personal_data(df).collect()
    assert len(got) == len(rows) + len(more)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 3)}
    for k, t in [x for x in rows + more if x[0] not in (None, 3)]:
        base = plain_spans(t or "")
        said = ",".join(f"{P.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in base)
        assert by[k]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [by[k][f"n_{x}"] for x in P.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert set(filter(None, said.split(","))) <= set(filter(None, by[k]["spans"].split(",")))
    # numbers that are written again without their country code are found by the field, and nothing else is
    assert [by[k]["n_added"] for k, _ in more] == [int(i % 12 == 0) for i in range(60)]
    assert all(r["n_added"] == 0 for r in got if r["doc_id"] in (1, 2, 3, None))
    assert P.personal_data(df.limit(0)).count() == 0


def test_messages_equal_enumeration():
    """On a chain with a skip edge that makes no loop, message passing is exact."""
    rng = np.random.default_rng(0)
    m = len(P.LABELS)
    s, t = rng.normal(size=(4, m)), rng.normal(size=(m, m))
    chain, skips = np.array([[0, 1], [1, 2]]), np.array([[2, 3]])
    got = P.marginals(s, chain, skips, t, 1.5, rounds=60, damping=0.3)
    want = np.zeros((4, m))
    for at in np.ndindex(m, m, m, m):
        w = np.exp(sum(s[i, at[i]] for i in range(4)) + t[at[0], at[1]] + t[at[1], at[2]] + 1.5 * (at[2] == at[3]))
        for i in range(4):
            want[i, at[i]] += w
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


def plain_hits(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = cut(text), set(), set()
    for k, t in items:
        v = cut(t)
        m = min(window, len(v))
        pats = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i : i + m]) in pats:
                hit |= set(range(i, i + m))
                if k is not None:
                    found.add(str(k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [2_000_000, 12])
def test_decontamination(spark, block_words):
    rnd = random.Random(4)
    v = [f"b{i}" for i in range(6)]
    items = [(i, " ".join(rnd.choice(v) for _ in range(n))) for i, n in enumerate([14, 25, 10, 3, 1, 2, 0, 11])] + [(99, None), (None, "zz yy"), (2, "q1 q2 q3")]
    docs = []
    for i in range(60):
        w = [rnd.choice(v + ["c", "d"]) for _ in range(rnd.randint(0, 80))]
        if i % 3 == 0:
            w += (rnd.choice(items)[1] or "").upper().split()
        docs.append((i % 50, ", ".join(w), i))
    docs += [(7, None, 0), (8, "", 0), (8, "é!" * 3, 0), (None, "zz yy" + " x" * 5000, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = sorted(map(tuple, D.contamination(df, b, block_words=block_words).select("doc_id", *[n for n, _ in D.RESULT]).collect()), key=repr)
    assert got == sorted([(k, *plain_hits(t, items)) for k, t, _ in docs], key=repr)
    clean = D.drop_contaminated(df, b)
    assert clean.columns == df.columns and clean.count() == sum(not r[-1] for r in got)
    assert D.contamination(df.limit(0), b).count() == 0 and D.contamination(df, b.limit(0)).where("contaminated").count() == 0


def test_wu_manber_skips_and_finds():
    rnd = random.Random(8)
    for m in (1, 2, 3, 10):
        pats = {tuple(rnd.randrange(4) for _ in range(m)): None for _ in range(5)}
        pats = {p: i for i, p in enumerate(pats)}
        text = [rnd.choice([-1, 0, 1, 2, 3]) for _ in range(3000)]
        want = [(i, pats[tuple(text[i : i + m])]) for i in range(len(text) - m + 1) if tuple(text[i : i + m]) in pats]
        assert list(D.WuManber(pats, m).find(text)) == want


def edits(a, b):
    """Fewest edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_fuzzy_notices_equal_edit_distance():
    rnd = random.Random(3)
    notices = [L.Notice(t, label) for t, label in L.NOTICES[:6]]
    for _ in range(150):
        n = rnd.choice(notices)
        t = list(n.text)
        for _ in range(rnd.randint(0, n.edits + 2)):
            i, kind = rnd.randrange(len(t)), rnd.randrange(3)
            t[i : i + 1] = [[], [rnd.choice("abcxyz ")], [t[i], rnd.choice("abcxyz")]][kind]
        words = " ".join(f"some words before {''.join(t)} and after".split())
        assert bool(n.matches(words)) == (edits(n.text, words) <= n.edits), (n.text, words)


def test_license_result(spark):
    rows = [(1, "Released under the MIT License. CC BY-NC 4.0"), (2, None), (3, ""), (4, "no permit license"), (4, "GNU, General\nPublic: License " * 2), (5, "word " * 30_000 + "Licensed undr the Apache Licence, Version 2.0")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, labels int")
    got = {(r["doc_id"], r["n_words"]): r for r in L.licenses(df).collect()}
    a = got[1, 10]
    assert (a["n_base"], a["first_word"], a["last_word"], a["base_labels"], a["score"]) == (2, 3, 5, "cc-by,mit", 1.0)
    assert got[2, 0]["n_base"] == 0 and got[2, 0]["first_word"] is None and got[3, 0]["score"] == 0.0 and got[4, 3]["n_base"] == 0
    b = got[4, 8]
    assert (b["n_base"], b["first_word"], b["last_word"], b["labels"]) == (2, 0, 4, "gpl")
    c = got[5, 30_008]
    assert c["n_base"] == 0 and c["labels"] == "apache" and 0.9 < c["score"] < 1 and c["spans"][0]["edits"] == 2
    assert L.licenses(df.limit(0)).count() == 0


def plain_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_rules():
    rnd = random.Random(6)
    for _ in range(600):
        t = "".join(rnd.choice(["a", "b ", " ", "\n", "é", "#", "\u00a0", "ab a ", "\t", "a b c "]) for _ in range(rnd.randint(0, 60)))
        assert Q._rules(t) == plain_rules(t), repr(t)
    assert Q._rules(None) == (0, 0, 0, 0, 0)


def plain_kneser_ney(texts, order):
    """Modified Kneser-Ney by its definition, over tuples and dicts."""
    from collections import Counter, defaultdict

    levels = {order: Counter()}
    for t in texts:
        s = Q._START * (order - 1) + Q.normalise(t) + Q._END
        levels[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, c in levels.items():
        n = Counter(c.values())
        cuts[k] = []
        for j in (1, 2, 3):
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            d = j - (j + 1) * y * n[j + 1] / n[j] if y is not None and n[j] else 0.5 * j
            cuts[k].append(min(max(d, 0.1), j))
    ctx = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            ctx[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / len(levels[1])
        d = lambda n: cuts[k][min(n, 3) - 1]
        near = ctx[k][g[:-1]]
        return max(levels[k][g] - d(levels[k][g]), 0) / sum(near) + sum(map(d, near)) / sum(near) * p(g[1:])

    return {g: np.log(p(g)) for g in levels[order]}


@pytest.mark.parametrize("bound", [8_000_000, 5])
def test_perplexity_equals_definition(spark, bound):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "Sat", "on", "mat", "9", "été"]) for _ in range(rnd.randint(50, 90))), rnd.choice(["en", "fr", None])) for i in range(40)]
    rows += [(50, None, "en"), (51, "", None), (51, "short", "en"), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, kept string")
    got = Q.quality_scores(df, keep=["doc_id", "text", "lang"], broadcast_entries=bound).collect()
    assert len(got) == len(rows)
    model = {lang: plain_kneser_ney([t for _, t, x in rows if t and x == lang], Q.ORDER) for lang in ("en", "fr", None)}
    for r in got:
        if r["n_words"]:
            s = Q._START * 4 + Q.normalise(r["text"]) + Q._END
            want = -sum(model[r["lang"]][s[i : i + 5]] for i in range(len(s) - 4)) / r["n_words"]
            assert r["log_ppl"] == pytest.approx(want, rel=1e-5)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert Q.filter_quality(df.drop("kept")).columns == ["doc_id", "text", "lang"]
    assert Q.quality_scores(df.limit(0), keep=["doc_id"]).count() == 0


def test_bands_reject_outliers(spark):
    rnd = random.Random(1)
    common = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}" for _ in range(40)]
    rows = [(i, " ".join(rnd.choice(common) for _ in range(80)), "en") for i in range(120)]
    rows += [(1000, " ".join("".join(rnd.choice("qxzjkvwy#%&") for _ in range(9)) for _ in range(80)), "en")]
    got = {r["doc_id"]: r for r in Q.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep=["doc_id"]).collect()}
    assert not got[1000]["kept"] and not got[1000]["base_failed"]
    assert all(r["kept"] or r["base_failed"] for k, r in got.items() if k != 1000)


@pytest.mark.parametrize("widener", ["copies", "rows that fail the base rules"])
def test_bands_do_not_widen(spark, widener):
    rnd = random.Random(1)
    common = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}" for _ in range(40)]
    odd = lambda n: " ".join("".join(rnd.choice("qxzjkvwy#%&") for _ in range(9)) for _ in range(n))
    rows = [(i, " ".join(rnd.choice(common) for _ in range(80)), "en") for i in range(120)] + [(1000, odd(80), "en")]
    mixed = " ".join([odd(20), *(rnd.choice(common) for _ in range(60))])
    rows += [(2000 + i, mixed if widener == "copies" else odd(20), "en") for i in range(60)]
    got = {r["doc_id"]: r for r in Q.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep=["doc_id"]).collect()}
    assert not got[1000]["kept"] and not got[1000]["base_failed"]
    assert all(r["kept"] or r["base_failed"] for k, r in got.items() if k < 1000)


def test_band_limits(spark):
    """Quartiles of 9.0 and 9.2 (bins of 0.01) end the band five ranges below and four above; the copies and the short rows count for nothing."""
    rows = [("en", i, 80, 0, 8.9 + 0.002 * i) for i in range(201)]
    rows += [("en", 7, 80, 0, 8.914)] * 300 + [("en", 900 + i, 20, 0, 14.0) for i in range(300)] + [("fr", 1, 20, 0, 9.0)]
    scored = spark.createDataFrame(rows, "lang string, text_key long, n_words long, n_repeat_words long, log_ppl double")
    (got,) = Q.bands(scored).collect()
    assert got["lang"] == "en" and got["low"] == pytest.approx(8.0, abs=0.07) and got["high"] == pytest.approx(10.0, abs=0.07)
