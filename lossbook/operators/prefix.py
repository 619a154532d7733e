"""Ordered totals that no single task has to compute alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEY_ROWS = 1_000_000


def _summed(measures: Mapping[str, Column]) -> list[Column]:
    return [F.sum(c).alias(n) for n, c in measures.items()]


def totals_before(df: DataFrame, key: str, order: Sequence[str], levels: Sequence[Column],
                  measures: Mapping[str, Column], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Add, per row, the sum of each measure over the key's earlier rows (0 for the first).

    Most keys are small and take a plain window. A key with more than `hot_rows` rows is cut
    by `levels` - expressions that never decrease along `order`, coarse first - and its rows
    get the totals of earlier level groups from small pre-aggregated tables, so its work is
    spread over as many tasks as there are level groups. NULL is a key and a level like any other.
    """
    hot = df.groupBy(key).count().filter(F.col("count") > hot_rows).select(F.col(key).alias("_hot"))
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))
    cold_rows = df.join(hot, is_hot, "left_anti")
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cold = cold_rows.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n)
                                   for n, c in measures.items()])

    level_names = [f"_level{i}" for i in range(len(levels))]
    rows = df.join(hot, is_hot, "left_semi").select(
        "*", *[c.alias(n) for n, c in zip(level_names, levels)])
    finest = [key, *level_names]
    inner = Window.partitionBy(*finest).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_own_{n}")
                             for n, c in measures.items()])
    for i, level in enumerate(level_names):
        outer = [key, *level_names[:i]]
        step = Window.partitionBy(*outer).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in [*outer, level]]
        offsets = (rows.groupBy(*outer, level).agg(*_summed(measures))
                   .select(*[F.col(c).alias(f"_at_{c}") for c in [*outer, level]], *[F.coalesce(F.sum(n).over(step), F.lit(0)).alias(f"_off{i}_{n}")
                                            for n in measures]))
        out = out.join(offsets, reduce(Column.__and__, same)).drop(*[f"_at_{c}" for c in [*outer, level]])
    spread = out.select(*df.columns, *[
        sum((F.col(f"_off{i}_{n}") for i in range(len(levels))), F.col(f"_own_{n}")).alias(n)
        for n in measures])
    return cold.unionByName(spread)
