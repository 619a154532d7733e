"""Smoothing of monthly series (W1-W10) and their joins onto loans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions.expr import month_of, ratio
from lossbook.session import stage


def outer_on_month(tables: Sequence[DataFrame], on: Sequence[str] = ("ym",)) -> DataFrame:
    """Full outer join of several monthly series; a month of any series stays."""
    return reduce(lambda a, b: a.join(b, list(on), "outer"), tables)


def ewm_mean(value: Column, position: Column, w) -> Column:
    """Exponentially weighted mean with half-life 6 rows, as two running sums.

    Row i has the weight 2**(i/6), so the newest row weighs most; a missing value adds no
    weight but the older ones still fade by its row. Weights stay finite for 6,000 months.
    """
    weight = F.pow(F.lit(2.0), position / V.EWM_HALFLIFE)
    return F.try_divide(F.sum(value * weight).over(w), F.sum(F.when(value.isNotNull(), weight)).over(w))


def smooth(series: DataFrame, value: str, unit: Sequence[str], window: tuple[str, str]) -> DataFrame:
    """Trailing and through-the-cycle columns of one series per unit, ordered by `ym`.

    Rows are months, not loans, so one unit's window is as long as its calendar.
    """
    unit = list(unit) or [F.lit(0)]
    ordered = Window.partitionBy(*unit).orderBy("ym")
    whole = Window.partitionBy(*unit)
    x = F.col(value)
    row = F.row_number().over(ordered)
    trailing = ordered.rowsBetween(-(V.TRAILING_ROWS - 1), 0)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    longrun = F.avg(F.when(F.col("ym").between(*window), x)).over(whole)
    back = F.lag(x, 12).over(ordered)
    out = series.withColumn("_row", row)
    out = out.select("*", F.avg(x).over(trailing).alias(f"{value}_ma12"),
                     ewm_mean(x, F.col("_row"), upto).alias(f"{value}_ewma"),
                     longrun.alias(f"{value}_longrun"), back.alias("_back"))
    ewma, lr = F.col(f"{value}_ewma"), F.col(f"{value}_longrun")
    return out.select(
        *series.columns, f"{value}_ma12", f"{value}_ewma", f"{value}_longrun",
        (V.TTC_WEIGHT * ewma + (1 - V.TTC_WEIGHT) * lr).alias(f"{value}_ttc"),
        (x - lr).alias(f"{value}_gap"),
        ratio(x - F.col("_back"), F.col("_back")).alias(f"{value}_yoy"),
        F.when(x > 0, F.ln(x)).alias(f"{value}_ln"))


def year_key() -> Column:
    return F.substring("ym", 1, 4)


def quarter_key() -> Column:
    quarter = F.floor((F.substring("ym", 6, 2).cast("int") - 1) / 3) + 1
    return F.concat(year_key(), F.lit("Q"), quarter.cast("string"))


def calendar_means(series: DataFrame, value: str, unit: Sequence[str], key: Column, prefix: str) -> DataFrame:
    """Mean of the whole calendar period and its change on the period before (looks ahead)."""
    unit = list(unit)
    rows = series.withColumn("_period", key)
    per = rows.groupBy(*unit, "_period").agg(F.avg(value).alias("_m"))
    prev = F.lag("_m").over(Window.partitionBy(*(unit or [F.lit(0)])).orderBy("_period"))
    per = per.select(*unit, "_period", F.col("_m").alias(f"{value}_{prefix}_avg"),
                     ratio(F.col("_m") - prev, prev).alias(f"{value}_{prefix}_change"))
    return rows.join(per, [*unit, "_period"], "left").drop("_period")


def smooth_all(series: DataFrame, values: Sequence[str], unit: Sequence[str], window: tuple[str, str],
               calendar: bool = False) -> DataFrame:
    out = series
    for v in values:
        out = smooth(out, v, unit, window)
        if calendar:
            out = calendar_means(out, v, unit, year_key(), "annual")
            out = calendar_means(out, v, unit, quarter_key(), "quarterly")
    return out


def overlay_table(series: DataFrame, values: Sequence[str], unit: Sequence[str], window: tuple[str, str],
                  calendar: bool = False) -> DataFrame:
    """The smoothed series as a stage table: a lookup whose real size decides the join kind."""
    return stage(smooth_all(series, values, unit, window, calendar), "overlay")


def attach_macro(loans: DataFrame, macro: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All (or the listed) macro columns at each loan's origination month; no month, no value."""
    names = [c for c in (columns or macro.columns) if c != "ym"]
    keyed = loans.withColumn("ym", month_of(F.col("LoanOriginationDate")))
    return keyed.join(macro.select("ym", *names), "ym", "left").drop("ym")


def attach_state(loans: DataFrame, state: DataFrame, columns: Sequence[str] = tuple(V.STATE_RAW + V.STATE_TTC)) -> DataFrame:
    lookup = state.select("ym", F.col("state").alias("BorrowerState"), *columns)
    keyed = loans.withColumn("ym", month_of(F.col("LoanOriginationDate")))
    return keyed.join(lookup, ["ym", "BorrowerState"], "left").drop("ym")


def latest_row(macro: DataFrame, required: Sequence[str]) -> DataFrame:
    """The most recent month with all required values, or the last month if none has them."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    best = F.max_by(F.struct("ym", *required), F.struct(complete, F.col("ym")))
    return macro.agg(best.alias("_r")).select("_r.*")


def latest_by_state(state: DataFrame, required: Sequence[str] = tuple(V.STATE_TTC)) -> DataFrame:
    """Per state its latest complete month; a state without one is absent."""
    best = F.max_by(F.struct("ym", *required), F.col("ym"))
    return state.dropna(subset=list(required)).groupBy("state").agg(best.alias("_r")).select("state", "_r.*")


def with_current_macro(loans: DataFrame, macro: DataFrame, columns: Sequence[str] = tuple(V.MACRO_TTC)) -> DataFrame:
    """Today's macro values on every row, from one scalar subquery."""
    now = latest_row(macro, list(columns)).select(F.struct(*columns)).scalar()
    return loans.select("*", *[now[c].alias(c) for c in columns])
