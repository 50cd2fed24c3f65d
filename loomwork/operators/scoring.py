"""Account scores: six factors from piecewise-linear curves, a weighted blend, tiers and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clamp, curve

#: Weights of the factors: fixed values.
WEIGHTS = {"financial": 0.25, "growth": 0.20, "marketing": 0.18, "solvency": 0.15, "risk": 0.12, "fit": 0.10}
#: Curves of each factor, as (column, sign, points, share): fixed values.
CURVES = {
    "financial": [("gross_margin", 1, [(10, 10), (30, 40), (50, 70), (70, 95)], 0.35), ("operating_margin", 1, [(-20, 0), (0, 35), (10, 65), (25, 95)], 0.40), ("fcf_margin", 1, [(-15, 0), (0, 40), (12, 75), (25, 95)], 0.25)],
    "growth": [("revenue_growth", 1, [(-15, 0), (0, 30), (10, 55), (25, 80), (45, 100)], 0.50), ("net_retention", 1, [(80, 10), (100, 50), (115, 80), (130, 100)], 0.30), ("backlog_growth", 1, [(-20, 10), (0, 45), (20, 80), (40, 100)], 0.20)],
    "marketing": [("sga_pct_revenue", 1, [(5, 15), (15, 50), (25, 80), (40, 95)], 0.35), ("sga_growth", 1, [(-15, 5), (0, 40), (15, 75), (30, 100)], 0.35), ("ad_spend_growth", 1, [(-20, 5), (0, 40), (20, 80), (40, 100)], 0.30)],
    "solvency": [("debt_to_ebitda", -1, [(-6, 5), (-4, 25), (-2, 60), (-1, 85), (0, 95)], 0.30), ("interest_coverage", 1, [(0, 0), (2, 35), (5, 70), (12, 95)], 0.30), ("current_ratio", 1, [(0.5, 5), (1.0, 40), (1.5, 75), (2.5, 95)], 0.20), ("cash_runway_months", 1, [(3, 5), (12, 45), (24, 80), (48, 100)], 0.20)],
}
RISK = [("risk_factor_count", [(10, 0), (25, 20), (45, 45), (70, 60)]), ("customer_concentration", [(5, 0), (20, 12), (35, 28), (60, 45)])]
RISK_FLAGS = [("going_concern", 35), ("material_weakness", 15), ("litigation_material", 8)]
FIT = [("revenue_millions", [(50, 25), (250, 65), (1000, 95), (5000, 80), (20000, 55)], 0.30), ("tech_spend_pct_revenue", [(1, 15), (4, 55), (8, 85), (15, 100)], 0.25)]
TARGETS = ("Enterprise SaaS", "Fintech", "Semiconductors", "MedTech")
ADJACENT = ("Omnichannel Retail", "Logistics", "Media")


def factors(targets: tuple = TARGETS, adjacent: tuple = ADJACENT) -> dict[str, Column]:
    """The six factors, 0 to 100, over a company's columns; an unknown figure counts as neutral."""
    out = {}
    for name, parts in CURVES.items():
        out[name] = clamp(sum((curve(sign * F.col(c), pts) * share for c, sign, pts, share in parts), F.lit(0.0)), 0, 100)
    risk = F.lit(100.0)
    for c, pts in RISK:
        risk = risk - curve(F.col(c), pts)
    for c, loss in RISK_FLAGS:
        risk = risk - F.when(F.col(c), loss).otherwise(0)
    out["risk"] = clamp(risk, 0, 100)
    sector = F.when(F.col("sector").isin(*targets), 100).when(F.col("sector").isin(*adjacent), 55).otherwise(20)
    out["fit"] = clamp(sum((curve(F.col(c), pts) * share for c, pts, share in FIT), sector * 0.45), 0, 100)
    return out


def scored(companies: DataFrame, weights: dict | None = None, **profile) -> DataFrame:
    """companies with their factors, composite, score (rounded, halves up) and tier (on the composite)."""
    w = weights or WEIGHTS
    f = companies.withColumns(factors(**profile))
    composite = sum((F.col(k) * v for k, v in w.items()), F.lit(0.0)) / sum(w.values())
    tier = F.when(F.col("composite") >= 70, "pursue").when(F.col("composite") >= 50, "watch").otherwise("avoid")
    return f.withColumn("composite", composite).withColumn("score", F.floor(F.col("composite") + 0.5)).withColumn("tier", tier)


def signals(companies: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, signal): what stands out in the numbers, generated from them."""
    c = F.col
    say = lambda kind, name, test: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("signal")))
    found = F.array(
        say("pos", "revenue grows", c("revenue_growth") >= 20), say("neg", "revenue shrinks", c("revenue_growth") < 0), say("neu", "modest growth", (c("revenue_growth") >= 0) & (c("revenue_growth") < 20)),
        say("pos", "expansion outpaces churn", c("net_retention") >= 110), say("neg", "churn exceeds expansion", c("net_retention") < 95),
        say("pos", "spending into demand", c("sga_growth") >= 15), say("neg", "cutting costs", c("sga_growth") <= -5),
        say("pos", "pricing power", c("gross_margin") >= 60), say("neg", "thin margin", c("gross_margin") < 25),
        say("neg", "going concern", c("going_concern")), say("neg", "material weakness", c("material_weakness")),
        say("neg", "leveraged", c("debt_to_ebitda") >= 4), say("pos", "conservative debt", c("debt_to_ebitda") <= 1.5),
        say("neg", "thin coverage", c("interest_coverage") < 2), say("neu", "concentrated customers", c("customer_concentration") >= 30),
        say("neg", "short runway", c("cash_runway_months") < 18), say("neu", "dense disclosure", c("risk_factor_count") >= 40),
    )
    return companies.select(id_col, F.inline(F.filter(found, lambda x: x.isNotNull())))
