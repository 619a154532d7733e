"""Train/test, calibration and sampling splits (X1-X6), all repeatable from the keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions.expr import key_hash
from lossbook.operators.ranking import fold_by_hash, smallest_by_hash

SEED = 42


def stratified_split(frame: DataFrame, key: str = "loan_id", stratum: str = V.TARGET,
                     share: float = V.TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add `split`: the share of each stratum with the smallest key hash is `test`."""
    marked = smallest_by_hash(frame, key, key_hash(F.col(key), seed), share=share, strata=[stratum])
    return marked.withColumn("split", F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen")


def out_of_time(frame: DataFrame, cutoff: str) -> DataFrame:
    """Add `split` by origination date; a loan without a date belongs to neither side."""
    d, cut = F.col("LoanOriginationDate"), F.lit(cutoff).cast("timestamp")
    return (frame.withColumn("split", F.when(d < cut, "train").when(d >= cut, "test"))
            .filter(F.col("split").isNotNull()))


def calibration_loans(rows: DataFrame, key: str = "loan_id", share: float = V.CALIBRATION_LOAN_SHARE,
                      seed: int = SEED) -> DataFrame:
    """Distinct loan ids with `is_cal`; at least one loan, otherwise the floor of the share."""
    loans = rows.select(key).distinct()
    count = F.greatest(F.floor(F.col("_n") * share), F.lit(1))
    return smallest_by_hash(loans, key, key_hash(F.col(key), seed), count=count).withColumnRenamed("chosen", "is_cal")


def downsample_negatives(rows: DataFrame, target: str, row_key: str, per_positive: int = V.NEGATIVES_PER_POSITIVE,
                         seed: int = SEED) -> DataFrame:
    """All positives and the `per_positive` times as many negatives with the smallest hash.

    `row_key` is a unique integer per row (for a loan-month: loan id and month combined).
    """
    positives = rows.filter(F.col(target) == 1)
    negatives = rows.filter(F.col(target) == 0)
    wanted = positives.agg(F.count("*").alias("n")).scalar() * per_positive
    kept = smallest_by_hash(negatives, row_key, key_hash(F.col(row_key), seed),
                            count=F.least(wanted, F.col("_n"))).filter("chosen").drop("chosen")
    return positives.unionByName(kept)


def stratified_folds(frame: DataFrame, key: str = "loan_id", stratum: str = V.TARGET,
                     folds: int = V.CV_FOLDS, seed: int = SEED) -> DataFrame:
    """Add `fold` 0..k-1 with equal stratum shares, cut by hash order."""
    shares = [i / folds for i in range(1, folds)]
    return fold_by_hash(frame, key, key_hash(F.col(key), seed), shares, stratum)


def fixed_size_sample(frame: DataFrame, n: int, key: str = "loan_id", seed: int = SEED) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by key hash."""
    count = F.least(F.lit(n), F.col("_n"))
    return smallest_by_hash(frame, key, key_hash(F.col(key), seed), count=count).filter("chosen").drop("chosen")
