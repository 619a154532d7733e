"""Column expressions shared by every operator. All of them stay inside Spark's JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MICROS = 86_400_000_000
DAYS_PER_MONTH = 30.44          # month length for ages and default timing
MONTHS_PER_DAY = 12.0 / 365.25  # month length for observed durations


def ratio(num: Column, den: Column, undefined: float | None = None) -> Column:
    """num / den; a zero denominator or a missing operand gives `undefined` (default NULL)."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if undefined is None else F.coalesce(out, F.lit(float(undefined)))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value and keep NULL (`greatest`/`least` alone would skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def flag(condition: Column) -> Column:
    """0/1 flag of a condition; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, rounded down, between two timestamps."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(DAY_MICROS)).cast("long")


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def key_hash(key: Column, seed: int = 0) -> Column:
    """Spread an integer key over 1,000,003 slots with plain arithmetic.

    The same expression is valid in any SQL engine and does not depend on partitions, so a
    sample drawn by it can be repeated anywhere.
    """
    slot = F.pmod(key.cast("long"), F.lit(1_000_003).cast("long"))
    return F.pmod(slot * F.lit(2_654_435_761) + F.lit(int(seed)).cast("long"),
                  F.lit(1_000_003).cast("long"))


def numeric_columns(df: DataFrame, among: list[str] | None = None) -> list[str]:
    names = among or df.columns
    return [n for n in names if isinstance(df.schema[n].dataType, T.NumericType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the source data; Spark would order it above every number."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([F.when(~F.isnan(n), F.col(n)).alias(n) if n in floats else F.col(n)
                      for n in df.columns])
