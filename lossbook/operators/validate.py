"""Outcome tables: calibration, dollar backtest, default timing, book summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions.expr import DAYS_PER_MONTH, clip, whole_days
from lossbook.operators.binning import bin_edges, bin_number


def calibration_by_bucket(frame: DataFrame, prob: str, target: str = V.TARGET, bins: int = 10) -> DataFrame:
    """Predicted against actual rate per equal-frequency bucket of the prediction."""
    rows = frame.filter(F.col(prob).isNotNull()).select(F.lit("p").alias("feature"), F.col(prob).alias("value"),
                                                        F.col(target).cast("double").alias("y"))
    edges = bin_edges(rows.select("feature", "value"), bins)
    return (rows.join(F.broadcast(edges), "feature").withColumn("bucket", bin_number("edges", "value", bins))
            .groupBy("bucket").agg(F.count("*").alias("n"), F.avg("value").alias("pred_PD"), F.avg("y").alias("actual_PD"))
            .withColumn("gap", F.col("pred_PD") - F.col("actual_PD")).orderBy("bucket"))


def calibration_by_vintage(frame: DataFrame, prob: str, target: str = V.TARGET) -> DataFrame:
    return (frame.filter(F.col("LoanOriginationDate").isNotNull())
            .groupBy(F.year("LoanOriginationDate").alias("year"))
            .agg(F.count("*").alias("n"), F.avg(prob).alias("pred_PD"), F.avg(F.col(target).cast("double")).alias("actual_PD"))
            .withColumn("gap", F.col("pred_PD") - F.col("actual_PD")).orderBy("year"))


def weighted_calibration_error(calibration: DataFrame) -> DataFrame:
    return calibration.agg((F.sum(F.abs("gap") * F.col("n")) / F.sum("n")).alias("weighted_error"))


def backtest(frame: DataFrame, predicted_el: Column, oot_year: int, target: str = V.TARGET) -> DataFrame:
    """Predicted and realized dollars per vintage and for the whole book, from one rollup."""
    realized = F.greatest(F.coalesce(F.col("LP_NetPrincipalLoss"), F.lit(0.0)), F.lit(0.0))
    rows = frame.filter(F.col("LoanOriginationDate").isNotNull()).select(
        F.year("LoanOriginationDate").alias("y"), F.col(target).alias("bad"),
        predicted_el.alias("el"), realized.alias("loss"))
    out = rows.rollup("y").agg(F.count("*").alias("n"), F.sum("bad").alias("n_default"),
                               F.sum("el").alias("predicted_el"), F.sum("loss").alias("realized_loss"))
    return out.select(
        F.coalesce(F.col("y").cast("string"), F.lit("ALL")).alias("year"), "n", "n_default", "predicted_el",
        "realized_loss", F.when(F.col("realized_loss") > 0, F.col("predicted_el") / F.col("realized_loss")).alias("ratio"),
        F.when(F.col("y").isNull(), "").otherwise((F.col("y") >= oot_year).cast("string")).alias("is_oot")).orderBy("year")


def default_timing(loans: DataFrame, bins: int = V.TIMING_BINS) -> DataFrame:
    """When in their life loans default: `bins` equal slots of the term, empty ones included."""
    lived = clip(whole_days(F.col("ClosedDate"), F.col("LoanOriginationDate")) / DAYS_PER_MONTH / F.col("Term"), 0, 1)
    slot = F.least(F.floor(lived * bins), F.lit(bins - 1)).cast("int")
    counts = loans.filter(lived.isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = loans.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return (all_bins.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
            .select("bin", "n", F.try_divide(F.col("n"), total).alias("density")))


def timing_peak(curve: DataFrame, bins: int = V.TIMING_BINS) -> DataFrame:
    """Middle of the fullest slot (the first one on a tie) and the number of defaults."""
    best = F.min_by(F.col("bin"), F.struct(-F.col("n"), F.col("bin")))
    return curve.agg(((best + 0.5) / bins).alias("peak"), F.sum("n").alias("n"))


def segment_rates(frame: DataFrame, segment: str | Sequence[str], target: str = V.TARGET) -> DataFrame:
    keys = [segment] if isinstance(segment, str) else list(segment)
    return frame.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("bad_rate"))


def book_summary(book: DataFrame, frame: DataFrame) -> DataFrame:
    """Raw rows, population, bads, bad rate and split sizes in one row."""
    raw = book.agg(F.count("*").alias("raw_rows"))
    return frame.agg(
        F.count("*").alias("population"), F.sum(V.TARGET).alias("bads"),
        F.avg(F.col(V.TARGET).cast("double")).alias("bad_rate"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train_rows"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test_rows")).select(raw.scalar().alias("raw_rows"), "*")


def class_weight(frame: DataFrame, target: str = V.TARGET) -> DataFrame:
    bad = F.sum(F.col(target).cast("long"))
    return frame.agg(((F.count("*") - bad) / F.greatest(bad, F.lit(1))).alias("class_weight"))
