"""Operators that were rewritten so that what they shuffle, spill and hold grows with their input: against plain versions, and what their plans may hold."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork import catalog
from loomwork.operators import recommend, study, supply

catalog.load_all()
PRODUCT = "sku string, base_price double, unit_cost double, base_demand double, elasticity double, ad_max_lift double, ad_saturation double, lead_time_mean double, lead_time_sd double"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def products(n=9):
    rnd = random.Random(2)
    return [(f"s{i}", 10.0 + i, 6.0 + i / 2, 20.0 + 3 * i, -0.8 - i / 5, 1.2 + i / 10, 200.0 + 9 * i, 4.0 + rnd.random() * 5, 1.0 + i % 3) for i in range(n)]


def some_log():
    rnd = random.Random(4)
    return {(u, int(40 * rnd.random() ** 2) * 1000 - 7) for u in range(60) for _ in range(rnd.randrange(1, 14))}


def plain_neighbours(log, k):
    users, out = defaultdict(set), {}
    for u, i in log:
        users[i].add(u)
    for i in users:
        s = [(-math.floor(len(users[i] & users[j]) / math.sqrt(len(users[i]) * len(users[j])) * 1e9 + 0.5), j) for j in users if j != i and users[i] & users[j]]
        out[i] = [(j, -x) for x, j in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("chunk", [4_000_000, 40])
def test_neighbours_without_rows_for_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(recommend, "CHUNK", chunk)
    log = some_log()
    df = spark.createDataFrame(sorted(log), "user int, item int")
    got = recommend.item_neighbours(df, 5)
    assert plan(got).count("Join") == 0 and got.schema["item"].dataType.simpleString() == "int"
    found = {(r["item"], r["other"], round(r["similarity"] * 1e9)) for r in got.collect()}
    assert found == {(i, j, s) for i, x in plain_neighbours(log, 5).items() for j, s in x}


@pytest.mark.parametrize("chunk", [4_000_000, 40])
def test_recommendations_by_neighbours(spark, monkeypatch, chunk):
    monkeypatch.setattr(recommend, "CHUNK", chunk)
    log = some_log()
    train, near = spark.createDataFrame(sorted(log), "user long, item long"), plain_neighbours(log, 5)
    asked = [*range(0, 60, 2), 1000]
    n = Counter(i for _, i in log)
    ranked = sorted(n, key=lambda i: (-n[i], i))
    popular = recommend.popularity(train)
    assert {(r["item"], r["n"], r["rank"]) for r in popular.collect()} == {(i, n[i], k) for k, i in enumerate(ranked, 1)}
    want, only_popular = set(), set()
    for u in asked:
        had, s = {i for v, i in log if v == u}, Counter()
        for i in had:
            s.update(dict(near[i]))
        best = sorted((i for i in s if i not in had), key=lambda i: (-s[i], i))[:10]
        best += [i for i in ranked if i not in had and i not in best][: 10 - len(best)]
        want |= {(u, i, k) for k, i in enumerate(best, 1)}
        only_popular |= {(u, i, k) for k, i in enumerate([i for i in ranked if i not in had][:10], 1)}
    users = spark.createDataFrame([(u,) for u in asked], "user long")
    assert {tuple(r) for r in recommend.recommend_neighbours(train, popular, users, 10, 5).select("user", "item", "place").collect()} == want
    assert {tuple(r) for r in recommend.recommend_popular(popular, users, train).select("user", "item", "place").collect()} == only_popular


def test_terms_make_no_rows(spark):
    texts = [(1, 0, "Graph theory (graph theory) helps. The graph is big"), (1, 1, "Big trees; tall trees and tall-ish trees"), (1, 2, "  "), (2, 0, None), (3, 0, "of the and")]
    t = spark.createDataFrame(texts, "doc_id long, unit int, text string")
    got = study.tf_idf(t, 3)
    assert "Aggregate" not in plan(got) and "Window" not in plan(got)
    g = [Counter(study.grams(x)) for d, _, x in texts if d == 1 and x.strip()]
    assert g[0] == {"graph": 3, "theory": 2, "graph theory": 2, "helps": 1, "big": 1} and g[1]["tall trees"] == 1 and g[1]["tall-ish trees"] == 1
    w = {x: max(c[x] / c.total() for c in g) * (math.log(3 / (sum(x in c for c in g) + 1)) + 1) * (1.6 if " " in x else 1.0) for c in g for x in c}
    best = sorted(w, key=lambda x: (-round(w[x], 9), x))[:9]
    halves = {h for x in best if " " in x for h in x.split()}
    want = [x for x in best if " " in x or x not in halves][:3]
    assert [(r["doc_id"], r["rank"], r["term"]) for r in got.orderBy("rank").collect()] == [(1, i, x) for i, x in enumerate(want, 1)]


def test_sentences_are_not_joined_with_terms(spark):
    text = "Heap memory is a part of a running program that holds objects. Stack memory holds frames of heap memory calls and nothing else."
    t = spark.createDataFrame([(1, 0, text)], "doc_id long, unit int, text string")
    got = study.glossary(t, t.select("doc_id", "text"))
    assert plan(got).count("Join") == 1  # the terms that are defined
    rows = {r["term"]: r["definition"] for r in got.collect()}
    assert rows["Heap memory"].startswith("part of a running program") and "heap memory" not in rows and rows["memory holds"].startswith("Stack memory")
    assert "Join" not in plan(study.summary(t, 1)) and study.summary(t, 1).first()["sentence"] in text


def test_grids_make_no_rows(spark):
    rows = products()
    df = spark.createDataFrame(rows, PRODUCT)
    prices, spends = supply.price_grid(df), supply.best_ad_spend(df)
    assert all(x not in plan(d) for d in (prices, spends) for x in ("Generate", "Aggregate"))
    prices, spends = ({r["sku"]: r for r in d.collect()} for d in (prices, spends))
    for sku, price, cost, demand, e, lift, full, *_ in rows:
        def profit(p, s):
            return demand * (p / price) ** e * (1 + (lift - 1) * s / (full + s)) * (p - cost) - s  # noqa: B023

        grid = [price * (0.2 + 5.8 * i / 290) for i in range(291)]
        at = max(range(291), key=lambda i: (round(profit(grid[i], 300.0), 6), -i))
        assert prices[sku]["price"] == pytest.approx(grid[at]) and prices[sku]["status"] == ("interior" if 0 < at < 290 else "unbounded")
        spend = max((50.0 * i for i in range(101)), key=lambda s: (profit(price, s), -s))
        assert spends[sku]["spend"] == spend and spends[sku]["profit"] == pytest.approx(profit(price, spend))


def plain_year(p, pol, seed, days):
    """The simulation run by run, with random.gauss."""
    rnd = random.Random(f"{p['sku']}:{seed}")
    price, spend, base, lead, lead_sd, reorder, lot, review, cost = supply._plan(p, pol, supply.NOISE)
    stock, due = reorder + lot / 2, {}
    sold_all = lost_all = orders = short = 0
    held = kept = 0.0
    for day in range(days):
        stock += due.pop(day, 0.0)
        mean = base * (1 + 0.18 * math.sin(2 * math.pi * (day - 80) / 365)) * (1 + 0.12 * math.sin(2 * math.pi * (day % 7) / 7))
        want = max(0, round(rnd.gauss(mean, mean * supply.NOISE)))
        sold = min(want, int(stock))
        stock -= sold
        sold_all, lost_all, short = sold_all + sold, lost_all + want - sold, short + (want > sold)
        held += stock * cost * supply.HOLDING_RATE / 365
        kept += stock
        if day % review == 0 and stock + sum(due.values()) <= reorder:
            at = day + max(1, round(rnd.gauss(lead, lead_sd)))
            due[at] = due.get(at, 0.0) + lot
            orders += 1
    return sold_all, lost_all, orders, short, held, kept / days


def test_years_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(supply, "BLOCK", 12)
    policies = [{"name": "a"}, {"name": "b", "price_change": 0.1, "review_days": 7, "lead_time_sd_mult": 3.0}, {"name": "c", "service": 0.5, "spend": 0.0}]
    df = spark.createDataFrame(products(), PRODUCT)
    sim = supply.simulate(df, policies, [1, 5], days=200)
    got = {(r["sku"], r["policy"], r["seed"]): r for r in sim.collect()}
    assert len(got) == 9 * 3 * 2
    names = df.columns
    for row in products():
        for pol in policies:
            for seed in (1, 5):
                r = got[row[0], pol["name"], seed]
                want = plain_year(dict(zip(names, row, strict=True)), pol, seed, 200)
                assert (r["units_sold"], r["units_lost"], r["orders_placed"], r["stockout_days"]) == want[:4]
                assert (r["holding_cost"], r["avg_inventory"]) == pytest.approx(want[4:])


def test_no_window_over_all_parts(spark, sf):
    """The only window without a key is over numbers of engagement, after they are counted."""
    p = plan(catalog.QUERIES["fan_out_distinct"](spark, sf))
    below = p[p.index("Window") :].split("\n")[1]
    assert "Aggregate [engagement" in below or "Aggregate [engagement" in "\n".join(p[p.index("Window") :].split("\n")[1:3])


@pytest.mark.parametrize("name", ["nearest_capital", "nearest_by_degrees"])
def test_nearest_inside_the_row(spark, sf, name):
    p = plan(catalog.QUERIES[name](spark, sf))
    assert "Aggregate [c_custkey" not in p and p.count("Join") == 1


def test_features_are_read_once(spark, sf):
    from loomwork.plans import models

    assert "documents.parquet" not in str(models.labelled(spark, sf).inputFiles())


def test_gate_counts_without_rows(spark):
    """Counts and audits agree with violations in long form; only rules on changed columns are counted again."""
    from functools import reduce

    from loomwork.operators import quality

    rows = [(i, str(i % 7 + 1) if i % 11 else " ", "abc"[i % 3], f"{i % 5 + 1}/2/2024" if i % 4 else "2024-01-03 10:00") for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string")
    rules = quality.suite([{"id": "n", "kind": "not_null", "column": "a"}, {"id": "t", "kind": "is_type", "column": "c", "type": "date"}, {"id": "u", "kind": "unique", "columns": ["a", "b"]}, {"id": "f", "kind": "foreign_key", "column": "b", "ref": "x", "ref_column": "k"}, {"id": "r", "kind": "row_count", "max": 95}, {"id": "m", "kind": "in_set", "column": "b", "allowed": ["a"]}])
    refs = {"x": spark.createDataFrame([("a",), ("b ",)], "k string")}
    long = lambda d: {r["rule"]: r["count"] for r in quality.violations(d, rules, refs=refs).groupBy("rule").count().collect()}
    short = quality.tally(df, rules, refs=refs)
    assert {r["rule"]: r["n"] for r in short.collect()} == long(df) and plan(short).count("Generate") <= 2
    mutations = {"blank": quality.blank_out("a", 0.2), "dup": quality.duplicate_rows(0.1), "drop": quality.drop_rows(), "cat": quality.unknown_category("b"), "swap": quality.swap_columns("b", "c")}
    assert mutations["blank"].columns == {"a"} and not hasattr(mutations["dup"], "columns")
    before = long(df)
    want = {name: sorted(k for k, n in long(m(df)).items() if n > before.get(k, 0)) for name, m in mutations.items()}
    assert {r["mutation"]: r["noticed_by"] for r in quality.audit(df, rules, mutations, refs=refs).collect()} == want
    shares = [mutations["blank"](df).where("a = ''").count(), mutations["dup"](df).count() - 90, mutations["drop"](df).count()]
    assert shares == [int(len([r for r in rows if r[1].strip()]) * 0.2), 9, 72]
    assert "Join" not in reduce(lambda s, x: s.replace(x, ""), ["Join Cross", "Join Inner"], plan(mutations["blank"](df)))


def test_chosen_are_first_in_seeded_order(spark):
    from loomwork.operators import sampling

    df = spark.range(3000)
    for share, least in ((0.37, 1), (0.0, 1), (1.0, 0), (0.0, 0)):
        cut = max(least, int(3000 * share))
        want = {r["id"] for r in sampling.ranked(df, ["id"], 5).where(F.col("_rank") < cut).collect()}
        assert {r["id"] for r in sampling.chosen(df, ["id"], share, 5, least).where("_chosen").collect()} == want and len(want) == cut
    assert sampling.chosen(df.where("id < 0"), ["id"], 0.5, 5).count() == 0
