"""Who is in scope: row filters of the loan jobs (F1-F8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook.fixed_values import BAD_STATUSES, CANCELLED, GOOD_STATUSES, TARGET

ORIGINATED, STATUS, CLOSED, TERM = "LoanOriginationDate", "LoanStatus", "ClosedDate", "Term"


def since(cutoff: str) -> Column:
    return F.col(ORIGINATED) >= F.lit(cutoff).cast("timestamp")


def resolved(book: DataFrame, cutoff: str, mode: str = "resolved") -> DataFrame:
    """Loans from the cutoff on whose outcome is known."""
    if mode != "resolved":
        raise NotImplementedError(f"population mode {mode!r} is not available")
    return book.filter(since(cutoff) & F.col(STATUS).isin(*BAD_STATUSES, *GOOD_STATUSES))


def panel_scope(book: DataFrame, cutoff: str) -> DataFrame:
    """Loans followed month by month: all but cancelled ones; an unknown status stays."""
    return book.filter(since(cutoff) & ~F.col(STATUS).eqNullSafe(CANCELLED) & (F.col(TERM) >= 1))


def defaulted(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col(TARGET) == 1)


def label_known(frame: DataFrame, label: str) -> DataFrame:
    return frame.filter(F.col(label).isNotNull())


def naive_target(book: DataFrame) -> DataFrame:
    """Rows with a status; every status but the bad ones counts as good, open loans too."""
    return (book.filter(F.col(STATUS).isNotNull())
            .withColumn(TARGET, F.col(STATUS).isin(*BAD_STATUSES).cast("int")))


def complete_cases(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.dropna(subset=list(columns))


def default_timing_scope(book: DataFrame, cutoff: str) -> DataFrame:
    return book.filter(F.col(STATUS).isin(*BAD_STATUSES) & F.col(CLOSED).isNotNull()
                       & since(cutoff) & (F.col(TERM) > 0))


def minimum_volume(report: DataFrame, min_count: int, count: str = "Count") -> DataFrame:
    return report.filter(F.col(count) >= min_count)
