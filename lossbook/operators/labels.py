"""Targets, casts and column sets of the training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions.expr import clip, ratio
from lossbook.operators.population import defaulted, label_known


def pd_target() -> Column:
    return F.coalesce(F.col("LoanStatus").isin(*V.BAD_STATUSES), F.lit(False)).cast("int")


def ead_label() -> Column:
    """Principal outstanding at default."""
    return clip(F.col("LoanOriginalAmount") - F.col("LP_CustomerPrincipalPayments"), lo=0)


def lgd_label() -> Column:
    """Share of the exposure that was lost; unknown for a zero exposure."""
    return clip(ratio(F.col("LP_NetPrincipalLoss"), ead_label()), 0, 1)


def with_target(loans: DataFrame) -> DataFrame:
    return loans.withColumn(V.TARGET, pd_target())


def categoricals_as_text(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(n).cast("string").alias(n) if n in V.CATEGORICAL_FEATURES else F.col(n)
                          for n in frame.columns])


MACRO_SETS = {
    None: [], "raw": V.MACRO_RAW, "ttc": V.MACRO_TTC, "ttc_geo": V.MACRO_TTC + V.STATE_TTC,
    "state": V.STATE_TTC, "robust": V.MACRO_ROBUST,
}
NEVER_FEATURES = set(V.LABEL_SUPPORT) - {"LoanOriginalAmount"} | set(V.BENCHMARK) | {
    V.TARGET, "ClosedDate", "LoanMonthsSinceOrigination", "LoanOriginationDate"}


def feature_columns(engineered: bool = False, cluster: bool = False, macro: str | None = None) -> list[str]:
    if macro not in MACRO_SETS:
        raise ValueError(f"unknown macro set {macro!r}")
    return (V.MODEL_FEATURES + (V.ENGINEERED_NUMERIC if engineered else [])
            + (["RiskCluster"] if cluster else []) + MACRO_SETS[macro])


def check_features(columns: list[str]) -> list[str]:
    """Refuse outcome, benchmark and label columns as model inputs."""
    leaked = sorted(NEVER_FEATURES & set(columns))
    if leaked:
        raise ValueError(f"not allowed as features: {leaked}")
    return columns


def training_table(frame: DataFrame, metric: str, columns: list[str]) -> DataFrame:
    """(features, label) rows: `pd` on the whole population, `ead` and `lgd` on defaults."""
    columns = check_features(columns)
    if metric == "pd":
        return frame.select("loan_id", *columns, F.col(V.TARGET).alias("label"))
    label = {"ead": ead_label, "lgd": lgd_label}[metric]()
    return label_known(defaulted(frame).select("loan_id", *columns, label.alias("label")), "label")


def decode(column: Column, codes: dict[int, str]) -> Column:
    """Label of a code from a fixed list; an unknown code gives NULL."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), column.cast("int"))
