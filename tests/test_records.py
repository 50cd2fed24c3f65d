"""The gate's command, imports, causes of wrong splits, clocks, anomalies of flat tables, search by query, simulated stock."""

import math

import pytest
from pyspark.sql import functions as F

from loomwork import gate
from loomwork.functions import geo, parsing
from loomwork.operators import linkage, nearest, programming, relational, search, study, supply, tracking
from loomwork.sources import csv_text

SPEC = '[[rule]]\nid = "a"\nkind = "not_null"\ncolumn = "x"\n[[rule]]\nid = "b"\nkind = "range"\ncolumn = "n"\nmin = 0\nmax = 9\n'


@pytest.fixture
def files(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_gate_exit_codes(spark, files, capsys):
    spec, good, bad = files("s.toml", SPEC), files("good.csv", "x,n\na,1\nb,2\n"), files("bad.csv", "x,n\n,1\nb,12\n")
    assert gate.main(["check", spec, good]) == 0
    assert gate.main(["check", spec, bad]) == 1
    assert "a: 1" in capsys.readouterr().out
    assert gate.main(["check", files("broken.toml", "[[rule]\n"), good]) == 2
    assert gate.main(["check", spec, str(files("s2.toml", SPEC)) + ".absent"]) == 2


def test_gate_audit_threshold(spark, files, capsys):
    spec, good = files("s.toml", SPEC), files("good.csv", "x,n\n" + "".join(f"v{i},{i % 9}\n" for i in range(40)))
    assert gate.main(["audit", spec, good]) == 0
    assert "missed" in capsys.readouterr().out  # two rules cannot notice all
    assert gate.main(["audit", spec, good, "--fail-under", "1.0"]) == 1


def test_import_and_export_of_expenses(spark):
    rows = [("2024-02-29", "food", "12.5"), ("2024-02-30", "food", "1"), ("24-1-1", "food", "1"), ("2024-03-01", " ", "1"), ("2024-03-01", "food", "-1"), ("2024-03-01", "food", None), (None, "food", "1")]
    taken, refused = csv_text.import_expenses(spark.createDataFrame(rows, "date string, category string, amount string"))
    assert [(str(r["date"]), r["amount"]) for r in taken.collect()] == [("2024-02-29", 12.5)] and refused.count() == 6
    out = csv_text.export_expenses(taken.withColumn("description", F.col("category"))).collect()
    assert [tuple(r) for r in out] == [("2024-02-29", "food", "-12.50")]


def test_positional(spark):
    t = spark.createDataFrame([("a,b",), ("a",), ("a,b,c",), ("  ",), (None,)], "line string")
    rows, refused = csv_text.positional(t, ["x", "y"])
    assert sorted((r["x"], r["y"] or "") for r in rows.collect()) == [("a", ""), ("a", "b"), ("a", "b")]
    assert sorted(r["line"] for r in refused.collect()) == ["a", "a,b,c"]


@pytest.mark.parametrize(
    ("text", "cause"),
    [("a,b\n", None), ('"a\nb",c\n', "newline in quotes"), ('"a,b",c\n', "comma in quotes"), ("a\n\nb\n", "blank line"), ('"a",b\n', "quotes kept"), ('"a""b"\n', "doubled quote"), ('"a,b\nc",d\n', "newline in quotes")],
)
def test_failure_cause(spark, text, cause):
    rows = [(csv_text.naive(text), list(csv_text.parse(text)))]
    t = spark.createDataFrame(rows, "got array<array<string>>, want array<array<string>>")
    assert t.select(csv_text.failure_cause(F.col("got"), F.col("want"))).first()[0] == cause


def test_clock(spark):
    t = spark.createDataFrame([(1, 0, 1000), (1, 5000, 5500), (1, 9000, 8000), (2, 10, 10)], "k long, resumed_at long, stopped_at long")
    assert {r["k"]: r["served_ms"] for r in tracking.served(t, "k").collect()} == {1: 1500, 2: 0}


def test_anomalies(spark):
    flat = spark.createDataFrame([("s1", "CS", "Reed"), ("s2", "CS", "Reed"), ("s3", "PH", "Ito")], "student string, course string, teacher string")
    after = {r["course"]: (r["before"], r["after"]) for r in relational.update_anomaly(flat, "course", "teacher", F.col("student") == "s1", F.lit("Lee")).collect()}
    assert after == {"CS": (1, 2), "PH": (1, 1)}
    assert [r[0] for r in relational.delete_anomaly(flat, "course", F.col("student") == "s3").collect()] == ["PH"]
    courses = spark.createDataFrame([("CS",), ("PH",), ("CH",)], "course string")
    assert [r[0] for r in relational.insert_anomaly(courses, flat, "course").collect()] == ["CH"]


def test_search_by_query(spark):
    results = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "query_id string, id long, rank long")
    judged = spark.createDataFrame([("a", 2), ("a", 2), ("a", 9), ("b", 7), ("c", 1)], "query_id string, id long")
    got = {r["query_id"]: (r["relevant"], r["hits"], r["first_rank"]) for r in search.per_query(results, judged).collect()}
    assert got == {"a": (2, 1, 2), "b": (1, 0, None), "c": (1, 0, None)}


def test_sweep_equals_single_settings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    queries = spark.createDataFrame([("q", "license apache the"), ("r", "mit license")], "query_id string, query string")
    grid = [(0.5, 0.0), (1.5, 0.75)]
    all_at_once = search.bm25_grid(docs, queries, "doc_id", "text", grid)
    for k1, b in grid:
        one = search.bm25(docs, queries, "doc_id", "text", 10, k1, b).select("query_id", "rank", "id", "score")
        mine = all_at_once.where((F.col("k1") == k1) & (F.col("b") == b)).select("query_id", "rank", "id", "score")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, mine.collect()))


def test_labels_points_months(spark):
    t = spark.createDataFrame([("x",), ("y",), ("y",)], "text string")
    assert [r[0] for r in linkage.unlabelled(t, spark.createDataFrame([("x",)], "text string")).collect()] == ["y"]
    p = spark.createDataFrame([(90.0, 180.0), (90.1, 0.0), (None, 0.0)], "a double, o double")
    assert [r[0] for r in p.select(geo.valid_point(F.col("a"), F.col("o"))).collect()] == [True, False, False]
    m = spark.createDataFrame([("2024-03",), ("2024-13",), ("2024-3",), ("2024-00",), (None,)], "t string")
    assert [r[0] for r in m.select(parsing.year_month(F.col("t"))).collect()] == ["2024-03", None, None, None, None]


def test_points_on_the_sphere(spark):
    for t in (nearest.on_sphere(spark, 500, 3), nearest.clustered(spark, 500, 3)):
        v = [r["v"] for r in t.collect()]
        assert all(math.isclose(sum(x * x for x in p), 1, abs_tol=1e-9) for p in v) and len(set(map(tuple, v))) == 500
    even = [r["v"][2] for r in nearest.on_sphere(spark, 4000).collect()]
    assert abs(sum(even) / 4000) < 0.05 and abs(sum(z > 0.5 for z in even) / 4000 - 0.25) < 0.04


def test_gaps():
    assert programming.gaps(*programming.sizing()) == (7.5, 105.0, 105 / 635)


def test_definitions_and_headings(spark):
    t = spark.createDataFrame([(1, "The Model Graph is a small structure that holds nodes; and more of it is here. Entropy is defined as the mean of surprise in bits."), (2, "A widget was known as the smallest thing of all the things."), (3, "Heap is called a tree. Nothing is a."), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["term"], r["definition"]) for r in study.definitions(t).collect()}
    assert got == {(1, "Model Graph", "small structure that holds nodes"), (1, "Entropy", "the mean of surprise in bits"), (2, "widget", "the smallest thing of all the things")}
    lines = ["2.1) Methods of the trade, as they are.", "1. intro", "12", "1.2.x odd, and low", "", "3 apples and pears."]
    h = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", study.is_heading(F.col("line")).alias("h"))
    assert [r["i"] for r in h.orderBy("i").collect() if r["h"]] == [0, 1, 5]


def test_review_interval(spark):
    p = spark.createDataFrame([("s", 20.0, 8.0, 30.0, -1.5, 1.2, 200.0, 5.0, 1.0)], "sku string, base_price double, unit_cost double, base_demand double, elasticity double, ad_max_lift double, ad_saturation double, lead_time_mean double, lead_time_sd double")
    rows = {r["policy"]: r for r in supply.simulate(p, [{"name": "daily"}, {"name": "monthly", "review_days": 30}], [1]).collect()}
    d, m = rows["daily"], rows["monthly"]
    assert d["orders_placed"] > m["orders_placed"] and m["orders_placed"] <= 13 and m["units_lost"] > d["units_lost"]
    for r in rows.values():
        assert r["cogs"] == pytest.approx(8.0 * r["units_sold"]) and r["ad_spend"] == pytest.approx(300.0 * 365)
        assert r["net_profit"] == pytest.approx(r["revenue"] - r["cogs"] - r["ad_spend"] - r["holding_cost"])
