"""Readers and writers of loan tables, splits, snapshots and small artifacts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossbook.functions.expr import nan_to_null


def read_loans_csv(spark: SparkSession, path: str, schema: T.StructType, rename: Mapping[str, str] | None = None,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Loan table from CSV, matched by header; `rename` maps a book's own headers to ours.

    Columns may come in any order, and further ones are left out; a missing one is an error. Values that
    are no number or date of their column's type are NULL, and time stamps may have fractions.
    """
    ours = {v: k for k, v in (rename or {}).items()}
    text = spark.read.option("header", True).csv(path)
    missing = [f.name for f in schema if ours.get(f.name, f.name) not in text.columns and f.name not in text.columns]
    if missing:
        raise ValueError(f"columns not in the header of {path}: {missing}")
    header = {f.name: ours.get(f.name, f.name) if ours.get(f.name, f.name) in text.columns else f.name for f in schema}
    df = nan_to_null(text.select(*[F.col(f"`{header[f.name]}`").try_cast(f.dataType).alias(f.name) for f in schema]))
    return df.select(*columns) if columns else df


def read_loans(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Loan table from Parquet; only the asked columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_lookup(spark: SparkSession, path: str, values: Sequence[str], keys: Sequence[str] = ("ym",)) -> DataFrame:
    """Keyed lookup from CSV; keys stay text, values are numbers, matched by header name."""
    header = spark.read.option("header", True).csv(path)
    return header.select(*[F.col(k).cast("string").alias(k) for k in keys],
                         *[F.expr(f"try_cast(`{v}` AS DOUBLE)").alias(v) for v in values])


def write_csv(frame: DataFrame, path: str) -> None:
    (frame.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def write_splits(frame: DataFrame, path: str) -> None:
    """One folder per split, so that a reader of one split touches only its files."""
    frame.write.partitionBy("split").parquet(path)


def write_panel(panel: DataFrame, path: str) -> None:
    """Loan-month table by origination year.

    Rows are rebalanced by year: adaptive execution splits a year that is larger than a partition should be, so the number of
    writers of a year follows its size.
    """
    panel.withColumn("vintage", F.year("LoanOriginationDate")).hint("rebalance", F.col("vintage")).write.partitionBy("vintage").parquet(path)


def snapshot_name(name: str, label: str, when: datetime | None = None) -> str:
    """Safe name with a time stamp: every snapshot is kept."""
    stamp = (when or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    return f"{re.sub('[^0-9A-Za-z]+', '_', f'{name}_{label}').strip('_')}_{stamp}"


def save_snapshot(table: DataFrame, folder: str, name: str, label: str, when: datetime | None = None) -> str:
    path = f"{folder.rstrip('/')}/{snapshot_name(name, label, when)}"
    table.write.option("header", True).csv(path)
    return path


def write_artifact(small: DataFrame, path: str) -> None:
    """A small result (a curve, defaults, a configuration) as one JSON file."""
    small.coalesce(1).write.json(path)
