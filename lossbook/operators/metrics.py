"""Model-quality metrics (M1-M7): exact, and per cohort when one is given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook.operators.ranking import running_totals

LOG_EPS = 2.220446049250313e-16     # double precision step: scores are kept this far from 0 and 1


def score_tally(frame: DataFrame, score: Column, target: Column, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: bads and goods. Equal scores collapse before the shuffle."""
    y = target.cast("long")
    return (frame.select(*by, score.cast("double").alias("score"), y.alias("y"))
            .filter(F.col("score").isNotNull() & F.col("y").isNotNull())
            .groupBy(*by, "score").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")))


def ranking_metrics(frame: DataFrame, score: Column, target: Column, by: Sequence[str] = ()) -> DataFrame:
    """AUC, Gini, KS, average precision and base rate of a score that rises with risk.

    A cohort of one class has no AUC, Gini or KS, and one without bads no average precision: NULL.
    """
    r = running_totals(score_tally(frame, score, target, by), "score", ["bad", "good"], by)
    nb, ng = F.col("bad_all"), F.col("good_all")
    wins = F.col("bad") * (F.col("good_before") + F.col("good") / 2)
    gap = F.abs(F.try_divide(F.col("bad_before") + F.col("bad"), nb) - F.try_divide(F.col("good_before") + F.col("good"), ng))
    hit = nb - F.col("bad_before")                      # bads at this score or above
    called = hit + ng - F.col("good_before")
    precision = F.try_divide(F.col("bad"), nb) * F.try_divide(hit, called)
    out = r.groupBy(*by).agg(
        F.try_divide(F.sum(wins), F.max(nb).cast("double") * F.max(ng)).alias("AUC"), F.max(gap).alias("KS"),
        F.sum(precision).alias("PR_AUC"),
        (F.max(nb) / (F.max(nb) + F.max(ng))).alias("BaseRate"), (F.max(nb) + F.max(ng)).alias("n"))
    return out.select(*by, "n", "AUC", (2 * F.col("AUC") - 1).alias("Gini"), "KS", "PR_AUC", "BaseRate")


def calibration_metrics(frame: DataFrame, prob: Column, target: Column, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and log-loss of a probability."""
    y = target.cast("double")
    p = F.least(F.greatest(prob, F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    return frame.filter(prob.isNotNull() & target.isNotNull()).groupBy(*by).agg(
        F.avg((prob - y) * (prob - y)).alias("Brier"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("LogLoss"))


def pd_metrics(frame: DataFrame, prob: Column, target: Column, by: Sequence[str] = (),
               calibration: bool = True) -> DataFrame:
    """All PD metrics; a pure ranking skips the calibration part."""
    ranks = ranking_metrics(frame, prob, target, by)
    if not calibration:
        return ranks
    cal = calibration_metrics(frame, prob, target, by)
    if by:
        return ranks.join(cal, list(by))
    return ranks.select("*", cal.select("Brier").scalar().alias("Brier"), cal.select("LogLoss").scalar().alias("LogLoss"))


def champion_metrics(frame: DataFrame, score: str, target: Column, min_rows: int = 100) -> DataFrame:
    """Ranking metrics of an incumbent score (high = safe); none when too few rows carry it."""
    known = frame.filter(F.col(score).isNotNull() & target.isNotNull())
    return ranking_metrics(known, -F.col(score), target).filter(F.col("n") > min_rows)


def reg_metrics(frame: DataFrame, actual: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2. The spread of the actuals is a central moment, safe for large values."""
    e = actual - predicted
    rows = frame.filter(actual.isNotNull() & predicted.isNotNull())
    a = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("MAE"),
                              F.avg(e * e).alias("_mse"), F.var_pop(actual).alias("_var"))
    return a.select(*by, "n", "MAE", F.sqrt("_mse").alias("RMSE"),
                    (1 - F.try_divide(F.col("_mse"), F.col("_var"))).alias("R2"))
