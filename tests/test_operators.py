"""Properties, published values and awkward inputs of the operators."""

import csv
import io
import random
import re
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import geo, links, nfa, parsing, similarity, stats
from loomwork.operators import anomaly, experiment, finance, forecast, limiters, linkage, nearest, programming, quality, recommend, relational, sampling, scoring, search, study, trees
from loomwork.sources import csv_text, json_text


def one(df):
    return df.first()[0]


# --- published values


@pytest.mark.parametrize(("a", "b", "j", "w"), [("MARTHA", "MARHTA", 0.944, 0.961), ("DIXON", "DICKSONX", 0.767, 0.813), ("DWAYNE", "DUANE", 0.822, 0.840), ("CRATE", "TRACE", 0.733, 0.733), ("", "", 1.0, 1.0), ("a", "", 0.0, 0.0)])
def test_jaro(a, b, j, w):
    assert similarity.jaro(a, b) == pytest.approx(j, abs=5e-4) and similarity.jaro_winkler(a, b) == pytest.approx(w, abs=5e-4)
    assert similarity.jaro(a, b) == similarity.jaro(b, a)


def test_distances(spark):
    d = lambda *x: spark.range(1).select(geo.haversine_km(*map(F.lit, x))).first()[0]
    assert d(40.7128, -74.0060, 51.5074, -0.1278) == pytest.approx(5570.2, abs=0.1)
    assert d(33.7490, -84.3880, 39.7392, -104.9903) == pytest.approx(1947.4, abs=0.1)
    chord = spark.range(1).select(geo.chord_km(F.sqrt(geo.squared_chord(geo.unit_vector(F.lit(40.7128), F.lit(-74.006)), geo.unit_vector(F.lit(51.5074), F.lit(-0.1278)))))).first()[0]
    assert chord == pytest.approx(5570.2, abs=0.1)


def test_loans(spark):
    r = finance.prepay_or_invest(spark, 320000.0, 0.065, 30, 200.0, 0.07).first()
    assert (r["base_months"], r["extra_months"], r["base_interest"], r["extra_interest"]) == (360, 281, 408142.36, 302713.69)


def test_programmes(spark):
    c, k, u = programming.sizing()
    assert float(programming.relaxation(c, k, u)[0]) == 627.5 and programming.rounded_up(c, k, u)[0] == 740
    value, point, nodes = programming.branch_and_bound(c, k, u)
    assert (value, point) == (635, [0, 1, 5, 0, 1]) and nodes < 200
    r = programming.brute_force(spark, c, k, u).first()
    assert r["cost"] == 635
    for n in (3, 5):
        assert float(programming.relaxation(*programming.cover(n))[0]) == pytest.approx(n / (n - 1))
        assert programming.branch_and_bound(*programming.cover(n))[0] == 2


def test_closed_forms(spark):
    assert forecast.floor_of_constant(70, 130) == pytest.approx(15.2459, abs=1e-4)
    assert forecast.floor_of_naive(70, 130) == pytest.approx(20.3279, abs=1e-4)
    m = {r["n"]: r for r in anomaly.masking(spark).collect()}
    assert m[10]["ceiling"] == pytest.approx(2.846, abs=1e-3) and m[16]["ceiling"] == pytest.approx(3.75) and m[16]["z_two"] == pytest.approx(2.562, abs=1e-3) and m[16]["masked"]
    assert anomaly.least_window(3.0) == 11


def test_limiters_worst_windows(spark):
    w = {r["limiter"]: r["worst"] for r in limiters.worst_windows(limiters.replay(limiters.adversarial(spark), ["pattern"], "ts", "id", 100, 60), limiters.KINDS, 60).collect()}
    assert w == {"fixed_window": 200, "token_bucket": 199, "sliding_counter": 101, "sliding_log": 100}


def test_peeking(spark):
    rate = lambda looks: one(experiment.rejection_rate(experiment.simulate(spark, 4000), looks, 1.959964))
    assert 0.035 < rate([14]) < 0.07 and 0.18 < rate(list(range(1, 15))) < 0.27
    assert 2.45 < one(experiment.calibrated_bar(experiment.simulate(spark, 4000, seed=1), list(range(1, 15)))) < 2.75
    cdf = stats.binomial_cdf(1000, 0.1)
    assert cdf[-1] == 1.0 and cdf[100] == pytest.approx(0.5266, abs=1e-3) and all(a <= b + 1e-12 for a, b in zip(cdf, cdf[1:], strict=False))


# --- quality gate


def table(spark, rows, cols="row_id long, a string, b string"):
    return spark.createDataFrame(rows, cols)


def fired(spark, rows, entry, **kw):
    v = quality.violations(table(spark, rows), [quality.rule({"id": "r", **entry})], **kw)
    return sorted([(r["row_id"], r["detail"]) for r in v.collect()], key=repr)


def test_rules(spark):
    rows = [(0, "5", "7"), (1, " n/a ", "x"), (2, None, "3"), (3, "1,5", "1"), (4, "z", ""), (5, "5", "7"), (6, " 5 ", "2024-01-02")]
    f = lambda **e: fired(spark, rows, e)
    assert f(kind="not_null", column="a") == [(1, "empty"), (2, "empty")]
    assert f(kind="unique", columns=["a"]) == [(5, "first seen at row 0"), (6, "first seen at row 0")]
    assert f(kind="in_set", column="a", allowed=["5", "Z"]) == [(3, "not an allowed value")]
    assert f(kind="range", column="a", min=5, max=10) == [(3, "above 10"), (4, "not a number")]
    assert f(kind="matches", column="a", pattern="[0-9]") == [(3, "does not match"), (4, "does not match")]
    assert f(kind="is_type", column="a", type="int") == [(4, "not int")]
    assert f(kind="is_type", column="b", type="date") == [(0, "not date"), (1, "not date"), (2, "not date"), (3, "not date"), (5, "not date")]
    assert f(kind="no_padding", column="a") == [(1, "padded"), (6, "padded")]
    assert f(kind="compare", columns=["a", "b"], op="<") == [(3, "expected a < b"), (6, "not comparable")]
    assert f(kind="row_count", max=3) == [(None, "more than 3 rows")] and f(kind="row_count", min=3) == []
    assert f(kind="columns_exist", columns=["a", "q"]) == [(None, "column missing")]
    assert f(kind="control_total", column="a", stat="sum", expected=30) == [] and len(f(kind="control_total", column="a", stat="count", expected=9)) == 1
    assert f(kind="foreign_key", column="a", ref="x", ref_column="k") == [(None, "reference dataset not supplied")]
    ref = {"x": spark.createDataFrame([("5 ",), ("15",)], "k string")}
    assert fired(spark, rows, {"kind": "foreign_key", "column": "a", "ref": "x", "ref_column": "k"}, refs=ref) == [(3, "no matching reference row"), (4, "no matching reference row")]


@pytest.mark.parametrize("bad", [{"kind": "range", "column": "a", "min": 1}, {"id": "x", "kind": "nope"}, {"id": "x", "kind": "range", "column": "a"}, {"id": "x", "kind": "not_null"}, {"id": "x", "kind": "not_null", "column": "a", "min": 1}, {"id": "x", "kind": "matches", "column": "a", "pattern": "("}, {"id": "x", "kind": "not_null", "column": "a", "severity": "loud"}])
def test_specs_that_mean_nothing(bad):
    with pytest.raises(quality.SpecError):
        quality.rule(bad)


def test_spec_text():
    assert [r.id for r in quality.load_spec('[[rule]]\nid = "a"\nkind = "not_null"\ncolumn = "x"\n')] == ["a"]
    for text in ("", "[[rule]\n", '[[rule]]\nid="a"\nkind="row_count"\nmin=1\n[[rule]]\nid="a"\nkind="row_count"\nmin=1\n'):
        with pytest.raises(quality.SpecError):
            quality.load_spec(text)


def test_split_and_audit(spark):
    rows = [(i, str(i % 7 + 1), f"{'abc'[i % 3]}") for i in range(60)] + [(60, "", "a"), (61, " 3", "b")]
    rules = quality.suite([{"id": "n", "kind": "not_null", "column": "a"}, {"id": "t", "kind": "is_type", "column": "a", "type": "int"}, {"id": "m", "kind": "range", "column": "a", "min": 1, "max": 7}, {"id": "s", "kind": "in_set", "column": "b", "allowed": ["a", "b", "c"]}, {"id": "c", "kind": "row_count", "min": 60, "max": 63}, {"id": "w", "kind": "no_padding", "column": "a", "severity": "warn"}])
    clean, bad = quality.split(table(spark, rows), rules)
    assert [r["row_id"] for r in bad.collect()] == [60] and clean.count() == 61
    found = {r["mutation"]: r["caught"] for r in quality.audit(table(spark, rows), rules, {"blank": quality.blank_out("a"), "drop": quality.drop_rows(), "dup": quality.duplicate_rows(0.1), "pad": quality.pad_whitespace("a"), "out": quality.inject_outlier("a"), "cat": quality.unknown_category("b"), "swap": quality.swap_columns("a", "b"), "text": quality.corrupt_type("a"), "scale": quality.rescale("a"), "pair": quality.reverse_pair("a", "b"), "dec": quality.shift_decimal("a"), "cut": quality.truncate_values("b")}).collect()}
    assert not found["pad"] and not found["cut"] and all(v for k, v in found.items() if k not in ("pad", "cut"))


def test_exact_samples(spark):
    df = spark.range(1000)
    a, b = sampling.split_exact(df, ["id"], 0.37, 5)
    assert a.count() == 370 and b.count() == 630 and a.intersect(b).count() == 0
    assert a.exceptAll(sampling.split_exact(df.repartition(13), ["id"], 0.37, 5)[0]).count() == 0


# --- parsing and sources

_CELLS = ["", "a", ",", '"', "\n", "\r\n", "\r", " ", "b,c", 'x"y']


@given(st.lists(st.sampled_from(_CELLS), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_csv_equals_library(text):
    assert list(csv_text.parse(text, strip_bom=False)) == list(csv.reader(io.StringIO(text, newline="")))


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿k,v\r\n1,\"x\ny\"\r\n\r\n2,\"ab\"c,more\r\n".encode())
    rows = [(r["row_id"], r["fields"]) for r in csv_text.read_rows(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()]
    assert rows == [(0, ["k", "v"]), (1, ["1", "x\ny"]), (2, []), (3, ["2", "abc", "more"])]
    assert [(r["k"], r["v"]) for r in csv_text.read_text_table(spark, str(tmp_path / "a.csv"), exact=True).orderBy("row_id").collect()] == [("1", "x\ny"), ("2", "abc")]
    csv_text.write_table(spark.createDataFrame([("q\"", 1, 2)], "s string, n int, z int"), str(tmp_path / "out"), ["n", "s"])
    assert [r.asDict() | {"row_id": 0} for r in csv_text.read_text_table(spark, str(tmp_path / "out")).collect()] == [{"n": "1", "s": 'q"', "row_id": 0}]


_PATTERNS = ["a?a?a?aaa", "(a|b)*abb", "[a-c]+d?", "a.c", "x|y|", "[^ab]*", "a\\+b", "((a|b)c)+", "[]a]b*", ".*"]


@given(st.sampled_from(_PATTERNS), st.text("abcdxy+] \n", max_size=9))
@settings(max_examples=400, deadline=None)
def test_nfa_equals_library(pattern, text):
    assert nfa.fullmatch(pattern, text) == bool(re.fullmatch(pattern, text))


def test_nfa_is_linear_and_refuses():
    assert nfa.fullmatch("a?" * 60 + "a" * 60, "a" * 60)
    for bad in ("a**", "a+?", "(a", "a)", "[a", "*a", "a\\"):
        with pytest.raises(ValueError):
            nfa.Pattern(bad)


def test_numbers_and_dates(spark):
    cells = ["1,234.5", "$5", "50%", "1d", "1_000", "inf", "-.5", " 7 ", "n/a", None, "5.", "1e3", "abc"]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(parsing.as_number(F.col("c"))).collect()]
    assert got == [1234.5, 5.0, 50.0, None, 1000.0, float("inf"), -0.5, 7.0, None, None, 5.0, 1000.0, None]
    dates = ["2024-02-03", "2/3/2024", "25/12/2024", "05-Feb-2024 10:00", "Feb 5, 2024", "5 February 2024", "soon", "2024-02-03T04:05:06"]
    got = [r[0] and r[0].date() for r in spark.createDataFrame([(i, c) for i, c in enumerate(dates)], "i int, c string").orderBy("i").select(parsing.as_datetime(F.col("c")).cast("timestamp_ntz")).collect()]
    assert got == [date(2024, 2, 3), date(2024, 2, 3), date(2024, 12, 25), date(2024, 2, 5), date(2024, 2, 5), date(2024, 2, 5), None, date(2024, 2, 3)]


def test_links(spark):
    raw = [" Example.COM/a?B", "https://h.org:80/x#y", "javascript:alert(1)", "ftp://h.org", "http://nohost", "localhost:3000/x", "http://u:p@h.org", "", None, "a b.com\t/x", "host.com:80/x"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(raw)], "i int, u string").orderBy("i").select(links.normalised_url(F.col("u"))).collect()]
    assert got == ["http://example.com/a?B", "https://h.org:80/x#y", None, None, None, "http://localhost:3000/x", None, None, None, None, "http://host.com:80/x"]
    assert links.expected_collisions(7, 1) == pytest.approx(0, abs=1e-3)


def test_json(spark):
    df = spark.createDataFrame([(1, '{"hourly":{"time":["a","b","c"],"temperature_2m":[1,2]}}'), (2, "broken"), (3, None)], "k int, j string")
    got = json_text.zipped(json_text.parsed(df, "j"), ["k"], "j.hourly", ["time", "temperature_2m"], since=F.lit("b"), limit=5).collect()
    assert [tuple(r) for r in got] == [(1, "b", 2.0), (1, "c", None)]
    e = spark.createDataFrame([("timeout", None), (None, 404), ("x", 503)], "m string, s int").select(json_text.error_kind(F.col("m"), F.col("s")))
    assert [r[0] for r in e.collect()] == ["timeout", "not found", "server"]


# --- relational


def test_not_in(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    vals = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    n = lambda v: sorted((r[0] for r in relational.not_in(df, "a", v, "v").collect()), key=repr)
    assert n(vals(1)) == [2] and n(vals(1, None)) == [] and n(vals(1).limit(0)) == [1, 2, None]


def test_versions_and_raises(spark):
    s = spark.createDataFrame([(1, 7, Decimal(100), date(2024, 1, 1), None)], "id int, employee_id int, annual_amount decimal(10,2), effective_from date, effective_to date")
    out = relational.give_raise(s, 7, Decimal(110), date(2024, 6, 30)).orderBy("id").collect()
    assert [(r["annual_amount"], r["effective_from"], r["effective_to"]) for r in out] == [(100, date(2024, 1, 1), date(2024, 6, 30)), (110, date(2024, 7, 1), None)]
    with pytest.raises(ValueError):
        relational.give_raise(s, 8, Decimal(110), date(2024, 6, 30))
    with pytest.raises(ValueError):
        relational.give_raise(s, 7, Decimal(100), date(2024, 6, 30))


def test_upserts_and_splits(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, relational.insert_or_ignore(t, spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], t.schema), ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, relational.update_allowed(t, "k", 1, {"v": "z", "k": 9}, {"v"}).collect())) == [(1, "z"), (2, "b")]
    assert relational.delete_cascade({"t": (t, "k")}, 1)["t"].count() == 1
    assert [r["v"] for r in relational.split_list(spark.createDataFrame([(1, "a, b,"), (2, None)], "k int, v string"), "v").orderBy("k", "v").collect()] == ["a", "b", None]


# --- nearest, linkage, models


def test_tree_search_equals_scan(spark):
    rnd = random.Random(4)
    pts = [(i, [rnd.choice([0.0, 1.0, rnd.gauss(0, 1)]) for _ in range(3)]) for i in range(300)]
    q = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(99, pts[5][1])]
    got = {r["q"]: r for r in nearest.nearest_in_space(spark.createDataFrame(q, "q long, v array<double>"), spark.createDataFrame(pts, "p long, v array<double>"), "q", "p", "v").collect()}
    for i, v in q:
        d, p = min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in pts)
        assert got[i]["squared_distance"] == pytest.approx(d) and got[i]["p"] == p
    with pytest.raises(ValueError):
        nearest.nearest_in_space(spark.createDataFrame(q, "q long, v array<double>"), spark.createDataFrame(pts, "p long, v array<double>"), "q", "p", "v", max_points=10)


def test_hard_set(spark):
    t = linkage.typos(spark.createDataFrame([("Atlantic Station",), ("Grant Park",), ("West End",)], "name string"))
    assert t.count() > 8 and t.select("entity").distinct().count() == 3


def plain_tree(rows, depth, least):
    ys = [r[-1] for r in rows]
    mean = sum(ys) / len(ys)
    if depth == 0 or len(set(ys)) == 1:
        return lambda r: mean
    best = None
    for f in range(len(rows[0]) - 1):
        vals = sorted({r[f] for r in rows})
        for a, b in zip(vals, vals[1:], strict=False):
            left, right = [r for r in rows if r[f] <= a], [r for r in rows if r[f] > a]
            if min(len(left), len(right)) < least:
                continue
            g = round(sum(r[-1] for r in left) ** 2 / len(left) + sum(r[-1] for r in right) ** 2 / len(right), 9)
            if best is None or g > best[0]:
                best = (g, f, (a + b) / 2, left, right)
    if best is None:
        return lambda r: mean
    _, f, t, left, right = best
    lo, hi = plain_tree(left, depth - 1, least), plain_tree(right, depth - 1, least)
    return lambda r: lo(r) if r[f] <= t else hi(r)


def test_trees(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([0.0, 1.0, 2.0, 5.0]), round(rnd.random(), 3)) for _ in range(80)]
    rows = [(a, b, a * 2 + (b > 0.5) * 3 + rnd.random()) for a, b in rows]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    tree, want = trees.fit_tree(df, ["a", "b"], "y", 3, 2), plain_tree(rows, 3, 2)
    for r in df.select("a", "b", "y", tree.predict().alias("p")).collect():
        assert r["p"] == pytest.approx(want((r["a"], r["b"], r["y"])))
    b = df.withColumn("t", (F.col("y") > 6).cast("int"))
    m = trees.fit_boosted(b, ["a", "b"], "t", "log_loss", trees=3, max_depth=2, rate=0.5)
    losses = [r["loss"] for r in trees.log_losses(b, m, "t").orderBy("stage").collect()]
    assert losses == sorted(losses, reverse=True)
    with pytest.raises(ValueError):
        trees.fit_boosted(df, ["a"], "y", "log_loss")
    assert trees.by_correlation(df, ["a", "b"], "y", 1) == ["a"]
    assert sorted(r["count"] for r in trees.folds(df.withColumn("i", F.monotonically_increasing_id()), ["i"], 3).groupBy("fold").count().collect()) == [26, 27, 27]


def test_smoothing(spark):
    rows = [("c", t, 5.0) for t in range(12)] + [("l", t, 2.0 * t) for t in range(12)]
    p = {(r["k"], r["t"]): r for r in forecast.smoothing_predictions(spark.createDataFrame(rows, "k string, t long, y double"), ["k"]).collect()}
    assert p["c", 11]["ses"] == 5.0 and p["l", 11]["holt"] == pytest.approx(22.0) and p["l", 11]["alpha"] == 0.95
    o = {(r["k"], r["t"]): r for r in forecast.predictions(spark.createDataFrame(rows, "k string, t long, y double"), ["k"]).collect()}
    assert o["l", 11]["trend"] == pytest.approx(22.0) and o["l", 11]["drift"] == pytest.approx(22.0) and o["c", 11]["mean"] == 5.0


def test_splits(spark):
    rnd = random.Random(5)
    log = spark.createDataFrame(sorted({(rnd.randrange(30), rnd.randrange(40)): rnd.randrange(50) for _ in range(400)}.items()), "p struct<u:int,i:int>, day int").selectExpr("p.u as user", "p.i as item", "day")
    for tr, te in (recommend.random_split(log), recommend.leave_last_out(log), recommend.temporal_split(log)):
        assert tr.unionByName(te).exceptAll(log).count() == 0 and tr.count() + te.count() == log.count()
    tr, te = recommend.temporal_split(log)
    recs = recommend.recommend_popular(recommend.popularity(tr), te, tr)
    assert recs.join(tr, ["user", "item"], "left_semi").count() == 0
    assert recs.groupBy("user").count().where("count > 10").count() == 0
    test, honest, leaky = recommend.honest_and_leaky(log)
    assert honest.count() == leaky.count() and leaky.join(test, ["user", "item"], "left_semi").count() == 0


def test_search_of_an_oracle(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i == 3 else "gamma") for i in range(9)], "id long, text string")
    r = search.bm25(docs, spark.createDataFrame([("q", "alpha"), ("z", "absent")], "query_id string, query string"), "id", "text")
    assert [tuple(x)[:1] + (x["id"],) for x in r.collect()] == [("q", 3)]
    m = search.metrics(r, spark.createDataFrame([("q", 3)], "query_id string, id long")).first()
    assert m["mrr"] == 1.0 and m["p_at_k"] == 0.1


def test_summaries_are_verbatim(spark):
    text = "A normal form is a property of a relation in the relational model. " * 3 + "Functional dependency theory explains why a normal form helps. Short one."
    u = spark.createDataFrame([(1, 0, text)], "doc_id long, unit int, text string")
    for r in study.summary(u, 2).collect():
        assert r["sentence"] in text
    d = study.definitions(u.select("doc_id", "text")).collect()
    assert d[0]["term"] == "normal form" and "property of a relation" in d[0]["definition"]


def test_score_edges(spark):
    c = spark.createDataFrame([(1, "Fintech", 1.0)], "company int, sector string, gross_margin double")
    rest = [x for parts in scoring.CURVES.values() for x, *_ in parts if x != "gross_margin"] + [x for x, _ in scoring.RISK] + [x for x, *_ in scoring.FIT]
    for x in rest:
        c = c.withColumn(x, F.lit(None).cast("double"))
    for x, _ in scoring.RISK_FLAGS:
        c = c.withColumn(x, F.lit(None).cast("boolean"))
    r = scoring.scored(c).first()
    assert r["growth"] == 50.0 and r["risk"] == 0.0 and r["financial"] == pytest.approx(10 * 0.35 + 50 * 0.65) and r["tier"] == "avoid"


def test_streams_are_what_batches_are(spark, sf, tmp_path):
    from loomwork.streaming import limiters as SL
    from loomwork.streaming import windows as SW

    stream = SW.events_stream(spark, sf)
    whole = SW.run_to_table(SW.tumbling(stream, "ts", ["event_type"], "1 hour", "10 minutes"), f"file://{tmp_path}/a", "complete")
    part = SW.run_to_table(SW.tumbling(stream, "ts", ["event_type"], "1 hour", "10 minutes"), f"file://{tmp_path}/b", "append")
    assert part.exceptAll(whole).count() == 0 and whole.count() - part.count() < 20
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = limiters.replay(events, ["user_id"], "ts", "event_id", 2, 86400)
    for kind in limiters.KINDS:
        s = SW.run_to_table(SL.limited(stream, "user_id", "event_id", "ts", kind, 2, 86400), f"file://{tmp_path}/{kind}")
        assert s.select("event_id", "admitted").exceptAll(batch.select("event_id", F.col(kind).alias("admitted"))).count() == 0
