"""Loans: payments, schedules, extra payments, futures and sensitivities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def payment(principal: Column, annual_rate: Column, years: Column) -> Column:
    r = annual_rate / 12
    return principal * r / (1 - F.pow(1 + r, -(years * 12)))


def future_value(monthly: Column, annual_rate: Column, months: Column) -> Column:
    r = annual_rate / 12
    return monthly * ((F.pow(1 + r, months) - 1) / r)


def schedule(loans: DataFrame) -> DataFrame:
    """loans(loan, principal, annual_rate, years, extra) -> (loan, month, interest, paid, balance): months until the balance is below half a cent, the last payment capped.

    One fold for each loan over its months; the recursion needs no join.
    """
    months = F.sequence(F.lit(1), (F.col("years") * 12 + 600).cast("int"))
    r, pay = F.col("annual_rate") / 12, payment(F.col("principal"), F.col("annual_rate"), F.col("years"))

    def step(acc, month):
        last = F.element_at(acc, -1)
        interest = last["balance"] * r
        paid = F.least(F.col("_pay") - interest + F.col("extra"), last["balance"])
        row = F.struct(month.cast("int").alias("month"), interest.alias("interest"), paid.alias("paid"), F.greatest(last["balance"] - paid, F.lit(0.0)).alias("balance"))
        return F.when(last["balance"] > 0.005, F.concat(acc, F.array(row))).otherwise(acc)

    zero = F.array(F.struct(F.lit(0).alias("month"), F.lit(0.0).alias("interest"), F.lit(0.0).alias("paid"), F.col("principal").cast("double").alias("balance")))
    t = loans.withColumn("_pay", pay).withColumn("_rows", F.aggregate(months, zero, step))
    return t.select("loan", F.inline(F.slice("_rows", 2, F.size("_rows") - 1)))


def summary(loans: DataFrame) -> DataFrame:
    """(loan, months, interest, crossover_month): the first month in which more is repaid than paid in interest."""
    return schedule(loans).groupBy("loan").agg(F.count(F.lit(1)).alias("months"), F.round(F.sum("interest"), 2).alias("interest"), F.min(F.when(F.col("paid") > F.col("interest"), F.col("month"))).cast("long").alias("crossover_month"))


def prepay_or_invest(spark: SparkSession, principal: float, annual_rate: float, years: int, extra: float, invest_rate: float) -> DataFrame:
    """One row: the value at the loan's end of investing the extra payment, and of prepaying and then investing what is free."""
    loans = spark.createDataFrame([("base", principal, annual_rate, years, 0.0), ("extra", principal, annual_rate, years, extra)], "loan string, principal double, annual_rate double, years int, extra double")
    s = summary(loans).agg(*[F.max(F.when(F.col("loan") == n, F.col(c))).alias(f"{n}_{c}") for n in ("base", "extra") for c in ("months", "interest")])
    pay = payment(F.lit(principal), F.lit(annual_rate), F.lit(years))
    s = s.withColumn("months_saved", F.col("base_months") - F.col("extra_months")).withColumn("payment", F.round(pay, 2))
    invest, prepay = future_value(F.lit(extra), F.lit(invest_rate), F.lit(years * 12)), future_value(pay + extra, F.lit(invest_rate), F.col("months_saved"))
    return s.withColumns({"interest_saved": F.round(F.col("base_interest") - F.col("extra_interest"), 2), "invest_value": F.round(invest, 2), "prepay_value": F.round(prepay, 2), "difference": F.round(invest - prepay, 2)})


def rate_grid(spark: SparkSession, principal: float, years: int, base: float, lo: float = 0.045, hi: float = 0.095, step: float = 0.005) -> DataFrame:
    """(rate, payment, difference): payments over a grid of rates and their difference from the base rate's."""
    t = spark.range(round((hi - lo) / step) + 1).select((F.lit(lo) + F.col("id") * step).alias("rate"))
    pay = lambda r: payment(F.lit(principal), r, F.lit(years))
    return t.select(F.round("rate", 6).alias("rate"), F.round(pay(F.col("rate")), 2).alias("payment"), F.round(pay(F.col("rate")) - pay(F.lit(base)), 2).alias("difference"))
