"""Loan-month (person-period) panels and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions.expr import MONTHS_PER_DAY, whole_days
from lossbook.operators.population import panel_scope

EVENT = "defaulted_this_month"


def months_to_close() -> Column:
    return F.bround(whole_days(F.col("ClosedDate"), F.col("LoanOriginationDate")) * MONTHS_PER_DAY, 0)


def observed_months() -> Column:
    """Months on book: to the closing date, or to the snapshot for a loan still open; 1..Term."""
    seen = F.when(F.col("ClosedDate").isNotNull(), months_to_close()).otherwise(F.col("LoanMonthsSinceOrigination"))
    bounded = F.least(F.greatest(seen, F.lit(1.0)), F.col("Term").cast("double"))
    return F.when(seen.isNotNull() & F.col("Term").isNotNull(), bounded).cast("long")


def durations(book: DataFrame, cutoff: str) -> DataFrame:
    """Loans of the panel with `is_event` and `T_obs`."""
    out = panel_scope(book, cutoff).select(
        "*", F.coalesce(F.col("LoanStatus").isin(*V.BAD_STATUSES), F.lit(False)).alias("is_event"),
        observed_months().alias("T_obs"))
    return out.filter(F.col("T_obs") >= 1)


def expand(loans: DataFrame, months: str) -> DataFrame:
    """One row per loan and month 1..months, with `t` and `t_frac`. No shuffle."""
    out = loans.withColumn("t", F.explode(F.sequence(F.lit(1).cast("long"), F.col(months).cast("long"))))
    return out.withColumn("t_frac", F.col("t") / F.col("Term"))


def loan_months(loans: DataFrame) -> DataFrame:
    """Person-period rows up to the observed duration; the event flag is set in the last month only."""
    return expand(loans, "T_obs").withColumn(
        EVENT, ((F.col("t") == F.col("T_obs")) & F.col("is_event")).cast("int"))


def first_rows(panel: DataFrame) -> DataFrame:
    """One row per loan: months start at 1, so the first month is a filter, not a grouping."""
    return panel.filter(F.col("t") == 1)


def panel_checks(loans: DataFrame) -> DataFrame:
    """One row of facts about the panel population."""
    apart = F.abs(months_to_close() - F.col("LoanMonthsSinceOrigination"))
    return loans.agg(
        F.count("*").alias("loans"), F.sum(F.col("is_event").cast("long")).alias("events"),
        F.count(F.when(F.col("LoanStatus") == "Current", 1)).alias("current"),
        F.sum("T_obs").alias("loan_months"),
        F.count(F.when(~F.col("T_obs").between(F.lit(1), F.col("Term")), 1)).alias("out_of_bounds"),
        F.count(apart).alias("closed"))


def assert_panel(checks: DataFrame, min_events: int = 1, min_current: int = 1) -> None:
    """Fail when events or censored loans are too few, or a duration is outside 1..Term."""
    row = checks.first()
    if row["events"] < min_events:
        raise AssertionError(f"expected at least {min_events} events, got {row['events']}")
    if row["current"] < min_current:
        raise AssertionError(f"expected at least {min_current} open loans, got {row['current']}")
    if row["out_of_bounds"]:
        raise AssertionError(f"{row['out_of_bounds']} durations are outside 1..Term")
