"""Whole jobs: the entry points a user of the library starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions import curves as C
from lossbook.operators import features as FE
from lossbook.operators import labels as LB
from lossbook.operators import overlay as OV
from lossbook.operators import panel as PA
from lossbook.operators import population as PO
from lossbook.operators import pricing as PX
from lossbook.operators import validate as VA
from lossbook.operators.ranking import quantile_grid
from lossbook.sources import book as B

POPULATION = ["LoanOriginationDate", "LoanStatus"]


def population(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Resolved loans from the cutoff on, with the target."""
    book = B.loan_book(spark, sf_dir, list(dict.fromkeys([*POPULATION, *columns])))
    return LB.with_target(PO.resolved(book, B.CUTOFF))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved loans with all base and engineered features, label support and target."""
    pop = PO.resolved(B.loan_book(spark, sf_dir), B.CUTOFF)
    return LB.categoricals_as_text(LB.with_target(FE.all_features(pop)))


def macro_table(spark: SparkSession, sf_dir: str, calendar: bool = False) -> DataFrame:
    return OV.overlay_table(B.monthly_series(spark, sf_dir), V.MACRO_RAW, [], B.LONG_RUN, calendar)


def state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OV.overlay_table(B.state_series(spark, sf_dir), V.STATE_RAW, ["state"], B.LONG_RUN)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full preparation: features, macro and state overlay, target, casts."""
    frame = feature_table(spark, sf_dir)
    macro = [*V.MACRO_RAW, *dict.fromkeys(V.MACRO_TTC + V.MACRO_ROBUST)]
    frame = OV.attach_macro(frame, macro_table(spark, sf_dir), macro)
    frame = OV.attach_state(frame, state_table(spark, sf_dir))
    keep = dict.fromkeys(["loan_id", *V.MODEL_FEATURES, *V.ENGINEERED_NUMERIC, *macro, *V.STATE_RAW, *V.STATE_TTC,
                          "LoanOriginationDate", *V.LABEL_SUPPORT, *V.BENCHMARK, V.TARGET, *B.HELPERS])
    return frame.select(*keep)


PANEL_COLUMNS = ["LoanOriginationDate", "LoanStatus", "ClosedDate", "LoanMonthsSinceOrigination", "Term"]


def panel_loans(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    book = B.loan_book(spark, sf_dir, list(dict.fromkeys([*PANEL_COLUMNS, *columns])))
    return PA.durations(book, B.CUTOFF)


def panel(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    return PA.loan_months(panel_loans(spark, sf_dir, columns))


def default_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = B.loan_book(spark, sf_dir, ["LoanStatus", "LoanOriginationDate", "ClosedDate", "Term"])
    return VA.default_timing(PO.default_timing_scope(book, B.CUTOFF))


SCORED = ["DebtToIncomeRatio", "risk_band", "LoanOriginalAmount", "Term"]


def scored_population(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """Resolved loans with the stand-in PD, severity and exposure."""
    pop = population(spark, sf_dir, [*SCORED, "LP_NetPrincipalLoss", *columns])
    return (pop.withColumn("pd", B.fixed_pd(pop)).withColumn("lgd", F.lit(B.FIXED_LGD))
            .withColumn("ead", F.col("LoanOriginalAmount") * (1 - B.FIXED_EAD_SHARE)))


def ecl_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against realized dollar losses by vintage (the flagship report)."""
    scored = scored_population(spark, sf_dir)
    el = PX.expected_loss(F.col("pd"), F.col("lgd"), F.col("ead"))
    return VA.backtest(scored, el, int(B.OOT_CUTOFF[:4]))


MONTHS_A_PART = 500_000


def hazard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(loan_id, Term, t, h): stand-in hazards over every resolved loan's full term.

    Loans are dealt out by id before their months are laid out, in parts of about `MONTHS_A_PART` months: a window over a loan then
    neither shuffles the months nor sorts more of them at once than fit in memory.
    """
    months = population(spark, sf_dir, ["Term"]).agg(F.sum("Term")).first()[0] or 0
    loans = scored_population(spark, sf_dir).select("loan_id", "Term", "pd").repartition(months // MONTHS_A_PART + 1, "loan_id")
    return PA.expand(loans, "Term").select("loan_id", "Term", "t", B.fixed_hazard(F.col("pd"), F.col("t"), F.col("Term")).alias("h"))


def hazard_array(loans: DataFrame, pd_: str = "pd", term: str = "Term") -> DataFrame:
    """Add `hazards`, the stand-in hazards of the loan's months as an array."""
    curve = C.let(F.struct(F.col(pd_).alias("pd"), F.col(term).alias("n")), lambda x: F.transform(
        C.months(x["n"]), lambda k: B.fixed_hazard(x["pd"], k, x["n"])))
    return loans.withColumn("hazards", curve)


def age_gap_median(loans: DataFrame) -> DataFrame:
    """Median distance in months between closing age and snapshot age."""
    gap = F.abs(PA.months_to_close() - F.col("LoanMonthsSinceOrigination")).cast("double")
    grid = quantile_grid(loans.select(F.lit("gap").alias("feature"), gap.alias("value")), 2, ["feature"], "value")
    return grid.select(F.col("grid")[1].alias("median_age_gap"))
