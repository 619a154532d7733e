"""Survival metrics under censoring (M8-M10): weighted concordance, dynamic AUC, Brier score.

Time is the whole number of months on book, so tables keyed by time have at most the longest
term as rows. Risk scores are cut into parts like the order statistics of `ranking`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossbook.operators.ranking import depth_of, part_offsets, with_parts
from lossbook.session import stage

PART_ROWS = 200_000                     # distinct (score, month) rows that one task orders


def censoring_survival(train: DataFrame) -> DataFrame:
    """Kaplan-Meier curve of staying uncensored, per month: (t, G). Events count before censorings."""
    per = train.groupBy(F.col("T_obs").alias("t")).agg(
        F.sum(F.col("is_event").cast("long")).alias("d"), F.count("*").alias("n"))
    later = Window.orderBy(F.desc("t"))
    risk = per.withColumn("at_risk", F.sum("n").over(later))
    still = 1 - F.try_divide((F.col("n") - F.col("d")).cast("double"), F.col("at_risk") - F.col("d"))
    step = risk.withColumn("keep", F.coalesce(still, F.lit(1.0)))
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return step.select("t", F.product("keep").over(upto).alias("G"))


def event_survival(rows: DataFrame) -> DataFrame:
    """Kaplan-Meier curve of not having defaulted: (t, S)."""
    per = rows.groupBy(F.col("T_obs").alias("t")).agg(
        F.sum(F.col("is_event").cast("long")).alias("d"), F.count("*").alias("n"))
    risk = per.withColumn("at_risk", F.sum("n").over(Window.orderBy(F.desc("t"))))
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return risk.select("t", F.product(1 - F.col("d") / F.col("at_risk")).over(upto).alias("S"))


def at_times(curve: DataFrame, value: str, times: DataFrame) -> DataFrame:
    """Last value of a step curve at or before each whole month in `times` (column `t`), else 1."""
    span = curve.select("t", value).unionByName(times.select("t", F.lit(None).cast("double").alias(value)))
    both = span.groupBy("t").agg(F.max(value).alias(value))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("t", F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(1.0)).alias(value))
    return filled.join(times.select("t").distinct(), "t", "left_semi")


def _with_weight(test: DataFrame, censoring: DataFrame) -> DataFrame:
    g = at_times(censoring, "G", test.select(F.col("T_obs").alias("t")).distinct())
    return test.join(F.broadcast(g.withColumnRenamed("t", "T_obs")), "T_obs").withColumn(
        "_w", F.when(F.col("is_event") & (F.col("G") > 0), 1 / F.col("G")))


def _scored_pairs(rows: DataFrame, times: list[int] | None, own_month: bool, budget: int) -> DataFrame:
    """(t, right, weight, controls) for each time (or each event month): cases against loans followed beyond t.

    `rows` is (T_obs, is_event, r, _w, last). Cases of t are the events of that month (`own_month`) or up to it, controls the loans
    with last >= t. `weight` sums the weights of the cases, `right` the weights times the controls with a lower score, ties counting half.

    Equal rows merge first; then they are cut into parts by score. The controls of each part, one counter per time, are
    prefix-summed over the parts level by level, and each part adds its own running counts. So every row is shuffled once and
    neither pairs nor months are laid out.
    """
    tally = stage(rows.groupBy("r", "T_obs", "is_event", "_w", "last").agg(F.count("*").alias("n")).filter(F.col("r").isNotNull()).withColumn(
        "_g", F.lit(0)), "survival")
    if times is None:                                    # one row per event month
        times = sorted(r[0] for r in tally.filter("is_event").select("T_obs").distinct().collect())
    if not times:
        return rows.sparkSession.createDataFrame([], "t long, right double, weight double, controls long")
    depth = depth_of(tally, ["_g"], budget)
    parted = stage(with_parts(tally, ["_g"], "r", depth), "survival-parts") if depth else tally.withColumn("_part", F.lit(0).cast("long"))
    names = [f"c{t}" for t in times]
    totals = parted.groupBy("_g", "_part").agg(*[F.sum(F.when(F.col("last") >= t, F.col("n")).otherwise(0)).alias(c) for t, c in zip(times, names)])
    offsets = part_offsets(totals, ["_g"], names, depth).select(
        "_part", F.array(*[f"{c}_before" for c in names]).alias("before"), F.array(*[f"{c}_all" for c in names]).alias("all"))

    def run(have: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if have.num_rows:
            have = have.sort_by([("r", "ascending")])
            r, T, last, n, w = (have.column(c).fill_null(0).to_numpy() for c in ("r", "T_obs", "last", "n", "_w"))
            event = have.column("is_event").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1], [True]]))
            tied = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            before, every = known.column("before")[0].as_py(), known.column("all")[0].as_py()
            for k, t in enumerate(times):
                case = event & ((T == t) if own_month else (T <= t))
                if case.any():
                    upto = np.concatenate([[0], np.cumsum(np.where(last >= t, n, 0))])[edge]
                    lower = before[k] + (upto[tied[case]] + upto[tied[case] + 1]) / 2
                    heavy = w[case] * n[case]
                    out.append((t, float((heavy * lower).sum()), float(heavy.sum()), every[k]))
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("t", "right", "weight", "controls"), cols, (pa.int64(), pa.float64(), pa.float64(), pa.int64()))})

    found = parted.groupBy("_part").cogroup(offsets.groupBy("_part")).applyInArrow(run, "t long, right double, weight double, controls long")
    return found.groupBy("t").agg(F.sum("right").alias("right"), F.sum("weight").alias("weight"), F.max("controls").alias("controls"))


def ipcw_concordance(train: DataFrame, test: DataFrame, risk: str, budget: int = PART_ROWS) -> DataFrame:
    """Share of comparable pairs in the right order, weighted by 1/G(T)^2 of the earlier event.

    An event at month t is comparable with every loan followed longer and with every loan
    censored in that same month.
    """
    rows = _with_weight(test.select("T_obs", "is_event", F.col(risk).cast("double").alias("r")), stage(censoring_survival(train), "km"))
    last = F.when(F.col("is_event"), F.col("T_obs") - 1).otherwise(F.col("T_obs")).cast("long")
    rows = rows.select("r", F.col("T_obs").cast("long").alias("T_obs"), "is_event", (F.col("_w") * F.col("_w")).alias("_w"), last.alias("last"))
    pairs = _scored_pairs(rows, None, True, budget)
    return pairs.agg(F.try_divide(F.sum("right"), F.sum(F.col("weight") * F.col("controls"))).alias("concordance_ipcw"))


def evaluation_times(train: DataFrame, test: DataFrame, step: int = 6) -> list[int]:
    """Every `step` months, strictly inside the follow-up of both sides."""
    a, b = (x.agg(F.min("T_obs"), F.max("T_obs")).first() for x in (train, test))
    return list(range(max(a[0], b[0]) + 2, min(a[1], b[1]) - 1, step))


def _grid(times: list[int]):
    return F.array(*[F.lit(t).cast("long") for t in times])


def dynamic_auc(train: DataFrame, test: DataFrame, risk: str, times: list[int], budget: int = PART_ROWS) -> DataFrame:
    """(t, auc): defaults up to t against loans still alive after t; defaults weigh 1/G(T)."""
    rows = _with_weight(test.select("T_obs", "is_event", F.col(risk).cast("double").alias("r")), stage(censoring_survival(train), "km"))
    rows = rows.select("r", F.col("T_obs").cast("long").alias("T_obs"), "is_event", "_w", (F.col("T_obs") - 1).cast("long").alias("last"))
    grid = test.sparkSession.createDataFrame([(int(t),) for t in times], "t long")
    pairs = _scored_pairs(rows, [int(t) for t in times], False, budget)
    return grid.join(pairs, "t", "left").select("t", F.try_divide(F.col("right"), F.col("weight") * F.col("controls")).alias("auc"))


def mean_dynamic_auc(auc: DataFrame, test: DataFrame) -> DataFrame:
    """Mean over time, weighted by the drop of the default-free curve since the time before."""
    s = at_times(event_survival(test), "S", auc.select("t"))
    w = Window.orderBy("t")
    drop = F.coalesce(F.lag("S").over(w), F.lit(1.0)) - F.col("S")
    rows = auc.join(s, "t").withColumn("_d", drop)
    return rows.agg((F.sum(F.col("auc") * F.col("_d")) / F.sum("_d")).alias("mean_auc"))


def brier_by_time(train: DataFrame, test: DataFrame, hazards: str, times: list[int]) -> DataFrame:
    """(t, brier): censoring-weighted squared error of the predicted survival at each time.

    `hazards` is an array column of monthly hazards; survival past its end stays at its last value.
    """
    km = stage(censoring_survival(train), "km")
    rows = _with_weight(test, km)
    t = F.col("t")
    long = rows.withColumn("t", F.explode(_grid(times)))
    s = F.aggregate(F.slice(F.col(hazards), 1, t.cast("int")), F.lit(1.0), lambda a, h: a * (1 - h))
    grid = test.sparkSession.createDataFrame([(x,) for x in times], "t long")
    g_t = F.broadcast(at_times(km, "G", grid).withColumnRenamed("G", "_gt"))
    case = F.when(F.col("is_event") & (F.col("T_obs") <= t), s * s * F.col("_w")).otherwise(0.0)
    control = F.when(F.col("T_obs") > t, F.try_divide((1 - s) * (1 - s), F.col("_gt"))).otherwise(0.0)
    return long.join(g_t, "t").groupBy("t").agg(F.avg(case + control).alias("brier"))


def integrated_brier(by_time: DataFrame) -> DataFrame:
    """Trapezoid of the Brier score over the grid, divided by its length."""
    w = Window.orderBy("t")
    area = (F.col("t") - F.lag("t").over(w)) * (F.col("brier") + F.lag("brier").over(w)) / 2
    rows = by_time.withColumn("_a", area)
    return rows.agg((F.sum("_a") / (F.max("t") - F.min("t"))).alias("integrated_brier"))
