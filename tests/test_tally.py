"""Bins, medians and reports read a column's rows once; what follows reads their tally."""

import pandas as pd
from pyspark.sql import functions as F

from lossbook.operators import binning as BI
from lossbook.operators import collinear as CO
from lossbook.operators.binning import MISSING


def test_edges_come_from_the_tally_of_the_rows(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(BI, "quantile_grid", lambda rows, *more, real=BI.quantile_grid: seen.append((rows, more)) or real(rows, *more))
    values = [(f, None if i % 7 == 0 else float(i * i % m)) for f, m in (("a", 97), ("b", 5), ("c", 31)) for i in range(400)]
    spark.createDataFrame(values, "feature string, value double").write.parquet(f"{tmp_path}/rows")
    got = {r.feature: r.edges for r in BI.bin_edges(spark.read.parquet(f"{tmp_path}/rows"), 10).collect()}
    rows, more = seen[0]
    assert not [f for f in rows.inputFiles() if str(tmp_path) in f] and more[-1] == "_times"
    assert rows.agg(F.sum("_times")).first()[0] == sum(v is not None for f, v in values if f != "b")
    for f in ("a", "c"):
        known = pd.Series([v for g, v in values if g == f and v is not None])
        want = sorted(set(known.quantile([i / 10 for i in range(11)])))
        assert [round(x, 9) for x in got[f]] == [round(x, 9) for x in want]
    assert set(got) == {"a", "c"}


def test_vif_medians_come_from_a_tally(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(CO, "quantile_grid", lambda rows, *more, real=CO.quantile_grid: seen.append(rows) or real(rows, *more))
    rows = spark.createDataFrame([(float(i % 3), float(i % 4) if i % 5 else None) for i in range(60)], "a double, b double")
    assert CO.variance_inflation(rows, ["a", "b"], ["a"]).first().vif >= 1.0
    assert seen[0].count() == seen[0].select("feature", "value").distinct().count() == 7


def test_numbers_and_texts_are_tallied_as_plain_values(spark):
    rows = spark.createDataFrame([(1, 0.0, "x", True), (0, -0.0, None, None), (1, None, MISSING, True), (None, float("nan"), "x", False)],
                                 "y int, a double, s string, f boolean")
    found = BI.tally(rows, ["s", "a", "f"], "y")
    got = {(r.feature, str(r.value), r.key): (r.n, r.bads) for r in found.collect()}
    assert got == {("a", "0.0", None): (2, 1), ("a", "None", None): (1, 1), ("a", "nan", None): (1, 0), ("s", "None", "x"): (2, 1),
                   ("s", "None", MISSING): (2, 1), ("f", "None", "true"): (2, 2), ("f", "None", MISSING): (1, 0), ("f", "None", "false"): (1, 0)}
    assert found.columns == ["feature", "value", "key", "n", "bads"]
