"""Loan economics: schedule, expected loss, profit, price and decisions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossbook import fixed_values as V
from lossbook.functions import curves as C
from lossbook.functions.expr import clip


@dataclass(frozen=True)
class Economics:
    """The lender's yearly assumptions."""

    funding_rate: float = 0.04
    servicing_rate: float = 0.01
    capital_ratio: float = 0.08
    target_raroc: float = 0.15


def amortization(loans: DataFrame, amount: str, apr: str, term: str = "Term") -> DataFrame:
    """Schedule in long form: one row per loan and month, balances in closed form (no ordering)."""
    rate, n = F.col(apr) / 12, F.col(term)
    rows = loans.withColumn("t", F.explode(C.months(n)))
    start = C.balance(F.col(amount), rate, n, F.col("t"))
    pay = C.payment(F.col(amount), rate, n)
    return (rows.withColumn("balance_start", start).withColumn("interest", F.col("balance_start") * rate)
            .withColumn("principal", F.least(pay - F.col("interest"), F.col("balance_start")))
            .withColumn("payment", pay))


def project(loans: DataFrame, amount: Column, apr: Column, term: Column, marginal: Column, lgd: Column,
            economics: Economics = Economics()) -> DataFrame:
    """Lifetime figures of every loan at its offered rate, from one pass over its months."""
    rate = apr / 12
    g = 1 + rate
    fixed = F.struct(g.alias("g"), F.pow(g, term).alias("growth"), (rate <= C.NO_RATE).alias("flat"),
                     term.cast("double").alias("n"))

    # state: months done, g**months, default mass so far, and two discounted sums per unit lent
    start = F.struct(F.lit(0).alias("k"), F.lit(1.0).alias("gk"), F.lit(0.0).alias("dead"),
                     F.lit(0.0).alias("lost"), F.lit(0.0).alias("owed"))

    def walk(p: Column) -> Column:
        def step(a: Column, m: Column) -> Column:
            bal = F.when(p["flat"], (p["n"] - a["k"]) / p["n"]).otherwise(
                F.try_divide(p["growth"] - a["gk"], p["growth"] - 1))
            grown = a["gk"] * p["g"]
            disc = bal / grown
            return F.struct((a["k"] + 1).alias("k"), grown.alias("gk"), (a["dead"] + m).alias("dead"),
                            (a["lost"] + m * disc).alias("lost"), (a["owed"] + (1 - a["dead"]) * disc).alias("owed"))
        return F.aggregate(C.conform(marginal, term), start, step)

    folded = loans.withColumn("_f", C.let(fixed, walk))
    lost, owed = F.col("_f.lost") * amount, F.col("_f.owed") * amount
    out = folded.select(
        *loans.columns, (lost * lgd).alias("lifetime_ecl"), (owed * rate).alias("interest_income_pv"),
        (owed * (economics.funding_rate / 12)).alias("funding_cost_pv"),
        (owed * (economics.servicing_rate / 12)).alias("servicing_cost_pv"),
        (amount * economics.capital_ratio).alias("capital"), (term / 12).alias("_years"),
        C.payment(amount, rate, term).alias("monthly_payment"))
    profit = (F.col("interest_income_pv") - F.col("lifetime_ecl") - F.col("funding_cost_pv") - F.col("servicing_cost_pv"))
    out = out.withColumn("expected_profit", profit)
    raroc = F.when((F.col("capital") > 0) & (F.col("_years") > 0), F.col("expected_profit") / F.col("capital") / F.col("_years"))
    return out.withColumn("raroc", raroc).drop("_years")


def _apr_solver(economics: Economics):
    """Vectorized bisection over Arrow batches of (curve, loss): break-even and target rate per loan.

    Profit per unit of amount at monthly rate c, with g = 1 + c and phi the monthly cost rate, is
    [(c-phi)(P_S(g)-sum(S)/g) - lgd(P_m(g)-sum(m)/g)] / (g^n-1), P_v a polynomial in g whose
    coefficients are the loan's survival S or default mass m by month. Sixty rounds of it as
    nested array lambdas would be interpreted month by month, hence the Arrow batch.
    """
    phi = (economics.funding_rate + economics.servicing_rate) / 12
    hurdle = economics.target_raroc * economics.capital_ratio

    def solve(marginal: pa.Array, lgd: pa.Array) -> list[pa.Array]:
        flat, ends, row, month = C.by_month(marginal, 0.0)
        n = np.diff(ends)
        k = int(n.max(initial=0))
        m, s = np.zeros((k, len(n))), np.zeros((k, len(n)))       # month-major, padded in front
        at = month + k - n[row]
        m[at, row] = flat
        s[at, row] = 1.0 - (np.cumsum(m, axis=0)[at, row] - flat)
        loss = lgd.to_numpy(zero_copy_only=False).astype(float)
        m_sum, s_sum = m.sum(axis=0), s.sum(axis=0)

        def unit_profit(c: np.ndarray) -> np.ndarray:
            g = 1.0 + c
            pm, ps = np.zeros_like(g), np.zeros_like(g)
            for j in range(k):
                pm = pm * g + m[j]
                ps = ps * g + s[j]
            value = (c - phi) * (ps - s_sum / g) - loss * (pm - m_sum / g)
            return np.where(c <= C.NO_RATE, -np.inf, value / np.expm1(n * np.log1p(c)))

        lacking = pc.or_(pc.is_null(marginal), pc.is_null(lgd)).to_numpy(zero_copy_only=False)
        rates = []
        for goal in (0.0 * n, hurdle * n / 12):
            lo, hi = np.zeros(len(n)), np.full(len(n), V.APR_CEILING)
            for _ in range(V.BISECTION_ROUNDS):
                mid = (lo + hi) / 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    low = unit_profit(mid / 12) < goal
                lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
            rates.append(pa.array((lo + hi) / 2, mask=lacking))
        return rates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, curve, loss = batch.columns
            yield pa.RecordBatch.from_arrays([*kept, *solve(curve, loss)], names=[*batch.schema.names[:-2], "breakeven_apr", "target_raroc_apr"])

    return run


def price(loans: DataFrame, term: Column, marginal: Column, lgd: Column,
          economics: Economics = Economics()) -> DataFrame:
    """Break-even APR and the APR that earns the target return, per loan.

    Profit is proportional to the amount, so the rate does not depend on it. Other columns pass through as the Arrow
    columns they are. Without a curve or a loss both rates are NULL; a NULL month has no default mass.
    """
    rows = loans.withColumn("_curve", C.conform(marginal, term).cast("array<double>")).withColumn("_loss", lgd.cast("double"))
    schema = T.StructType([*loans.schema.fields, T.StructField("breakeven_apr", T.DoubleType()),
                           T.StructField("target_raroc_apr", T.DoubleType())])
    return rows.mapInArrow(_apr_solver(economics), schema)


def expected_loss(pd_: Column, lgd: Column, ead: Column) -> Column:
    """PD x LGD x EAD with a bounded severity and a floored exposure."""
    return pd_ * clip(lgd, 0, 1) * clip(ead, lo=0)


def decision(pd_: Column, loss_rate: Column) -> Column:
    return (F.when((pd_ < 0.15) & (loss_rate < 0.05), "approve").when(pd_ < 0.35, "refer").otherwise("decline"))


def verdict(offered: Column, breakeven: Column, target: Column) -> Column:
    return (F.when(offered >= target, "profitable").when(offered >= breakeven, "covers cost").otherwise("unprofitable"))


def survival_rows(hazards: DataFrame, keys: Sequence[str] = ("loan_id",)) -> DataFrame:
    """S(t) and marginal PD of hazards in long form (loan, t, h); a loan has at most Term rows."""
    w = Window.partitionBy(*keys).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    h = C.clip_hazard(F.col("h"))
    s = F.exp(F.sum(F.log1p(-h)).over(upto))
    out = hazards.withColumn("survival", s)
    return out.withColumn("marginal_pd", F.coalesce(F.lag("survival").over(w), F.lit(1.0)) * h)


def alive_at_start(marginals: DataFrame, keys: Sequence[str] = ("loan_id",)) -> DataFrame:
    """1 minus the default mass of earlier months, for long-form marginals."""
    before = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return marginals.withColumn("alive_start", 1 - F.coalesce(F.sum("marginal_pd").over(before), F.lit(0.0)))


def lifetime_from_rows(hazards: DataFrame, keys: Sequence[str] = ("loan_id",)) -> DataFrame:
    """Lifetime PD per loan as a grouped product through log sums; combines before the shuffle."""
    h = C.clip_hazard(F.col("h"))
    return hazards.groupBy(*keys).agg((1 - F.exp(F.sum(F.log1p(-h)))).alias("lifetime_pd"))
