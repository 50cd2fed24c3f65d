"""Scores, loans, supply, programmes and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import finance as N
from ..operators import programming as P
from ..operators import scoring as A
from ..operators import supply as U
from ..operators import trees as T
from ..scratch import kept
from ..tables import load

#: A company's figures from a supplier's key and balance, in both dialects.
_COLUMNS = {
    "sector": "CASE s_suppkey % 4 WHEN 0 THEN 'Fintech' WHEN 1 THEN 'Media' WHEN 2 THEN 'MedTech' ELSE 'Mining' END",
    "gross_margin": "s_suppkey % 80", "operating_margin": "s_suppkey % 50 - 22", "fcf_margin": "s_suppkey % 43 - 16", "revenue_growth": "s_suppkey % 63 - 16", "net_retention": "78 + s_suppkey % 55",
    "backlog_growth": "s_suppkey % 61 - 20", "sga_pct_revenue": "s_suppkey % 44", "sga_growth": "s_suppkey % 47 - 16", "ad_spend_growth": "s_suppkey % 62 - 21", "debt_to_ebitda": "(s_suppkey % 70) / 10.0",
    "interest_coverage": "s_suppkey % 14", "current_ratio": "(s_suppkey % 28) / 10.0", "cash_runway_months": "s_suppkey % 52", "risk_factor_count": "s_suppkey % 75", "customer_concentration": "s_suppkey % 64",
    "going_concern": "s_suppkey % 17 = 0", "material_weakness": "s_suppkey % 13 = 0", "litigation_material": "s_suppkey % 11 = 0", "revenue_millions": "s_suppkey * 37 % 21000", "tech_spend_pct_revenue": "s_suppkey % 16",
}


def companies(spark, sf):
    return load(spark, sf, "supplier").selectExpr("s_suppkey AS company", *[f"{x} AS {c}" for c, x in _COLUMNS.items()])


def _curve(x: str, pts) -> str:
    out = f"CASE WHEN {x} IS NULL THEN 50.0 WHEN {x} <= {pts[0][0]} THEN {pts[0][1]:.1f}"
    for (x0, y0), (x1, y1) in zip(pts, pts[1:], strict=False):
        out += f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) / CAST({x1 - x0} AS DOUBLE) * {y1 - y0}"
    return f"CAST({out} ELSE {pts[-1][1]:.1f} END AS DOUBLE)"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 100.0)"


_FACTORS = {name: _clamp(" + ".join(f"{_curve(f'CAST({sign} * {c} AS DOUBLE)', pts)} * {share}" for c, sign, pts, share in parts)) for name, parts in A.CURVES.items()}
_FACTORS["risk"] = _clamp("100.0 - " + " - ".join(_curve(f"CAST({c} AS DOUBLE)", pts) for c, pts in A.RISK) + "".join(f" - CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in A.RISK_FLAGS))
_FACTORS["fit"] = _clamp(f"CASE WHEN sector IN {A.TARGETS} THEN 100 WHEN sector IN {A.ADJACENT} THEN 55 ELSE 20 END * 0.45 + " + " + ".join(f"{_curve(f'CAST({c} AS DOUBLE)', pts)} * {s}" for c, pts, s in A.FIT))
_COMPANIES = "c AS (SELECT s_suppkey AS company, " + ", ".join(f"{x} AS {c}" for c, x in _COLUMNS.items()) + " FROM supplier)"


@query(
    "account_score",
    f"WITH {_COMPANIES}, f AS (SELECT company, {', '.join(f'{x} AS {n}' for n, x in _FACTORS.items())} FROM c), s AS (SELECT *, {' + '.join(f'{k} * {v}' for k, v in A.WEIGHTS.items())} AS composite FROM f) "
    + "SELECT company, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in _FACTORS)
    + ", round(composite, 6) AS composite, CASE WHEN composite >= 70 THEN 'pursue' WHEN composite >= 50 THEN 'watch' ELSE 'avoid' END AS tier FROM s",
)
def account_score(spark, sf):
    s = A.scored(companies(spark, sf))
    return s.select("company", *[F.round(n, 6).alias(n) for n in (*A.WEIGHTS, "composite")], "tier")


@query("account_tiers", f"WITH {_COMPANIES}, f AS (SELECT company, {', '.join(f'{x} AS {n}' for n, x in _FACTORS.items())} FROM c), s AS (SELECT *, {' + '.join(f'{k} * {v}' for k, v in A.WEIGHTS.items())} AS composite FROM f) SELECT CASE WHEN composite >= 70 THEN 'pursue' WHEN composite >= 50 THEN 'watch' ELSE 'avoid' END AS tier, count(*) AS n, round(median(composite), 6) AS median_score FROM s GROUP BY 1")
def account_tiers(spark, sf):
    return A.scored(companies(spark, sf)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("composite"), 6).alias("median_score"))


@query("account_signals")
def account_signals(spark, sf):
    return A.signals(companies(spark, sf), "company")


_LOANS = "l(loan, principal, annual_rate, years, extra) AS (VALUES ('base', 320000.0::DOUBLE, 0.065::DOUBLE, 30, 0.0::DOUBLE), ('extra', 320000.0, 0.065, 30, 200.0), ('short', 9000.0, 0.1, 2, 50.0))"
_SCHEDULE = f"""WITH RECURSIVE {_LOANS}, s(loan, r, pay, extra, month, interest, paid, balance) AS (SELECT loan, annual_rate / 12, principal * (annual_rate / 12) / (1 - power(1 + annual_rate / 12, -(years * 12))), extra, 0, 0.0::DOUBLE, 0.0::DOUBLE, principal FROM l
    UNION ALL SELECT loan, r, pay, extra, month + 1, balance * r, least(pay - balance * r + extra, balance), greatest(balance - least(pay - balance * r + extra, balance), 0.0) FROM s WHERE balance > 0.005)"""


def loans(spark):
    return spark.createDataFrame([("base", 320000.0, 0.065, 30, 0.0), ("extra", 320000.0, 0.065, 30, 200.0), ("short", 9000.0, 0.1, 2, 50.0)], "loan string, principal double, annual_rate double, years int, extra double")


@query("amortization", _SCHEDULE + " SELECT loan, month, round(interest, 4) AS interest, round(paid, 4) AS paid, round(balance, 4) AS balance FROM s WHERE month > 0")
def amortization(spark, sf):
    return N.schedule(loans(spark)).select("loan", "month", *[F.round(c, 4).alias(c) for c in ("interest", "paid", "balance")])


@query("loan_summary", _SCHEDULE + " SELECT loan, count(*) AS months, round(sum(interest), 2) AS interest, CAST(min(CASE WHEN paid > interest THEN month END) AS BIGINT) AS crossover_month FROM s WHERE month > 0 GROUP BY 1")
def loan_summary(spark, sf):
    return N.summary(loans(spark))


@query("prepay_or_invest")
def prepay_or_invest(spark, sf):
    return N.prepay_or_invest(spark, 320000.0, 0.065, 30, 200.0, 0.07)


_PAY = "320000.0 * ({0} / 12) / (1 - power(1 + {0} / 12, -360))"


@query("rate_sensitivity", f"SELECT round(0.045 + i * 0.005, 6)::DOUBLE AS rate, round({_PAY.format('(0.045::DOUBLE + i * 0.005::DOUBLE)')}, 2) AS payment, round({_PAY.format('(0.045::DOUBLE + i * 0.005::DOUBLE)')} - {_PAY.format('0.065::DOUBLE')}, 2) AS difference FROM range(11) r(i)")
def rate_sensitivity(spark, sf):
    return N.rate_grid(spark, 320000.0, 30, 0.065)


_PRODUCT = {
    "sku": "CAST(p_partkey AS STRING)", "base_price": "CAST(p_retailprice AS DOUBLE)", "unit_cost": "p_retailprice * 0.6", "base_demand": "20.0 + p_size", "elasticity": "-0.8 - (p_partkey % 20) / 10.0",
    "ad_saturation": "200.0 + p_partkey % 500", "ad_max_lift": "1.2 + (p_partkey % 8) / 10.0", "lead_time_mean": "5.0 + p_partkey % 9", "lead_time_sd": "1.0 + p_partkey % 4",
}


def products(spark, sf):
    """Every part as a product."""
    return load(spark, sf, "part").selectExpr(*[f"CAST({x} AS {'STRING' if c == 'sku' else 'DOUBLE'}) AS {c}" for c, x in _PRODUCT.items()])


_P = "p AS (SELECT " + ", ".join(f"CAST({x.replace('STRING', 'VARCHAR')} AS {'VARCHAR' if c == 'sku' else 'DOUBLE'}) AS {c}" for c, x in _PRODUCT.items()) + " FROM part)"


@query(
    "price_grid",
    f"""WITH {_P}, g AS (SELECT *, i, base_price * (0.2::DOUBLE + (6.0::DOUBLE - 0.2::DOUBLE) * i / 290) AS price FROM p, range(291) r(i)), v AS (SELECT *, base_demand * power(price / base_price, elasticity) * (1 + (ad_max_lift - 1) * 300.0 / (ad_saturation + 300.0)) * (price - unit_cost) - 300.0 AS profit FROM g),
    b AS (SELECT sku, unit_cost, elasticity, arg_max(i, (round(profit, 6), -i)) AS i FROM v GROUP BY 1, 2, 3)
    SELECT b.sku, round(v.price, 6) AS price, round(v.profit, 4) AS profit, CASE WHEN b.i BETWEEN 1 AND 289 THEN 'interior' ELSE 'unbounded' END AS status, round(CASE WHEN b.elasticity < -1 THEN b.unit_cost * b.elasticity / (b.elasticity + 1) END, 4) AS closed_form FROM b JOIN v ON v.sku = b.sku AND v.i = b.i""",
)
def price_grid(spark, sf):
    g = U.price_grid(products(spark, sf))
    return g.select("sku", F.round("price", 6).alias("price"), F.round("profit", 4).alias("profit"), "status", F.round("closed_form", 4).alias("closed_form"))


@query("best_ad_spend")
def best_ad_spend(spark, sf):
    return U.best_ad_spend(products(spark, sf))


@query(
    "stock_policy",
    f"""WITH {_P}, d AS (SELECT *, base_demand AS q FROM p) SELECT sku, round(1.645 * sqrt(lead_time_mean * power(q * 0.35, 2) + power(q, 2) * power(lead_time_sd, 2)), 6) AS safety_stock, round(q * lead_time_mean + 1.645 * sqrt(lead_time_mean * power(q * 0.35, 2) + power(q, 2) * power(lead_time_sd, 2)), 6) AS reorder_point,
    round(sqrt(2 * greatest(1.0, q * 365) * 120.0 / greatest(0.01, unit_cost * 0.25)), 6) AS order_quantity FROM d""",
)
def stock_policy(spark, sf):
    p = U.stock_policy(products(spark, sf), F.col("base_demand"))
    return p.select("sku", *[F.round(c, 6).alias(c) for c in ("safety_stock", "reorder_point", "order_quantity")])


@query("inventory_sim")
def inventory_sim(spark, sf):
    return U.simulate(products(spark, sf), [{"name": "base"}, {"name": "dearer", "price_change": 0.05}, {"name": "weekly", "review_days": 7}], [1, 2])


@query("scenario")
def scenario(spark, sf):
    return U.scenario(U.simulate(products(spark, sf), [{"name": "base"}, {"name": "late", "lead_time_add": 3.0, "lead_time_sd_mult": 1.5}], [1, 2]), "base", "late")


@query("service_sweep")
def service_sweep(spark, sf):
    """Mean profit for each service target, and so the best one."""
    s = U.simulate(products(spark, sf), [{"name": str(t), "service": t} for t in U.Z], [1])
    return s.groupBy("policy").agg(F.avg("net_profit").alias("profit"), F.avg("service_level").alias("service_level"))


_C, _K, _U = P.sizing()


@query(
    "ip_bruteforce",
    f"SELECT CAST(min(cost) AS BIGINT) AS cost, count(*) AS feasible FROM (SELECT {' + '.join(f'{c} * x{i}' for i, c in enumerate(_C))} AS cost FROM {', '.join(f'range({u + 1}) r{i}(x{i})' for i, u in enumerate(_U))} WHERE {' AND '.join('(' + ' + '.join(f'{a} * x{i}' for i, a in enumerate(row)) + f') >= {b}' for row, b in _K)})",
)
def ip_bruteforce(spark, sf):
    return P.brute_force(spark, _C, _K, _U).select("cost", "feasible")


@query("ip_methods", "SELECT method, CAST(cost AS DOUBLE) AS cost FROM (VALUES ('relaxation', 627.5::DOUBLE), ('branch and bound', 635.0), ('rounded up', 740.0)) v(method, cost)")
def ip_methods(spark, sf):
    rows = [("relaxation", float(P.relaxation(_C, _K, _U)[0])), ("branch and bound", float(P.branch_and_bound(_C, _K, _U)[0])), ("rounded up", float(P.rounded_up(_C, _K, _U)[0]))]
    return spark.createDataFrame(rows, "method string, cost double")


def labelled(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("lines"), (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("double").alias("stops"))
    return kept(load(spark, sf, "labels").join(d, "doc_id"), "labelled")  # every level of a tree passes over it


@query("tree_predictions")
def tree_predictions(spark, sf):
    """Quality by a tree of depth two on three counts of each labelled document."""
    t = labelled(spark, sf)
    tree = T.fit_tree(t, ["n_chars", "lines", "stops"], "quality", 2, 5)
    return t.select("doc_id", F.round(tree.predict(), 9).alias("p"), "quality")


@query("boosted_losses")
def boosted_losses(spark, sf):
    t = labelled(spark, sf)
    return T.log_losses(t, T.fit_boosted(t, ["n_chars", "stops"], "quality", "log_loss", trees=3, max_depth=2, rate=0.3), "quality")


@query("feature_leakage")
def feature_leakage(spark, sf):
    """Accuracy by fold with features selected inside the training rows, and selected once on all rows."""
    t = labelled(spark, sf)
    names = ["n_chars", "lines", "stops"]
    rows = [(where, i, a) for where, inside in (("inside", True), ("outside", False)) for i, a in enumerate(T.cross_validated(t, names, "quality", ["doc_id"], 2, 3, inside, trees=2))]
    return spark.createDataFrame(rows, "selected string, fold int, accuracy double")


@query("ip_gap", "SELECT 635 - 627.5::DOUBLE AS gap, 740.0::DOUBLE - 635 AS overpaid, (740.0::DOUBLE - 635) / 635 AS overpaid_share")
def ip_gap(spark, sf):
    """What whole numbers cost beyond the relaxation, and what rounding its solution up costs beyond the optimum."""
    return spark.createDataFrame([P.gaps(_C, _K, _U)], "gap double, overpaid double, overpaid_share double")
