"""Grids that stop and go on, and search by successive halving."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossbook.operators import models as MO
from lossbook.plans.grid import DONE, FAILED, LATE, run_cells, unfinished
from lossbook.sources.keyed import KeyedTable

CELLS = [{"version": v, "model": m} for v in ("a", "b") for m in ("x", "y", "z")]


def state(table):
    return {(r.version, r.model): (r.auc, r.status) for r in table.read().collect()}


def test_failed_and_late_cells_leave_the_others_alone(spark, tmp_path):
    table, calls = KeyedTable(spark, f"file://{tmp_path}/g", ["version", "model"]), []

    def work(cell):
        calls.append((cell["version"], cell["model"]))
        if cell["model"] == "y" and cell["version"] == "a":
            raise ValueError("no such family\nsecond line")
        if cell["model"] == "z" and cell["version"] == "b":
            spark.range(1, numPartitions=1).select(F.udf(lambda i: time.sleep(60) or i, "long")("id")).collect()
        return {"auc": spark.range(10).count() / 20}

    run_cells(spark, CELLS, work, ["auc"], table, at_once=3, seconds=15)
    got = state(table)
    assert got["a", "y"] == (None, FAILED) and got["b", "z"] == (None, LATE) and len(got) == 6
    assert [k for k, v in got.items() if v == (0.5, DONE)].__len__() == 4
    assert {r.message for r in table.read().filter("status = 'failed'").collect()} == {"no such family"}
    assert len(unfinished(table, CELLS)) == 2

    calls.clear()
    run_cells(spark, CELLS, lambda c: calls.append(c["model"]) or {"auc": 0.7}, ["auc"], table, at_once=2)
    assert sorted(calls) == ["y", "z"] and all(v[1] == DONE for v in state(table).values()) and state(table)["a", "x"] == (0.5, DONE)
    calls.clear()
    run_cells(spark, CELLS, lambda c: calls.append(c) or {}, ["auc"], table)
    assert calls == []


def test_no_cells(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/g", ["version", "model"])
    assert run_cells(spark, [], lambda c: {}, ["auc"], table).collect() == []


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(900):
        x = rng.normal(size=3)
        out.append((i, *map(float, x), int(rng.random() < 1 / (1 + np.exp(-2 * x[0] + x[1])))))
    return spark.createDataFrame(out, "loan_id long, StatedMonthlyIncome double, DebtToIncomeRatio double, Term double, is_bad int")


def test_halving_finds_the_best_of_the_full_grid(spark, rows):
    columns = ["StatedMonthlyIncome", "DebtToIncomeRatio", "Term"]
    configs = [{"regParam": r, "elasticNetParam": 1.0} for r in (0.001, 0.05, 0.2, 5.0)]
    best, auc, trials = MO.search_pd(rows, columns, "logistic", configs, (0.3, 1.0), 0.5)
    whole, whole_auc, _ = MO.search_pd(rows, columns, "logistic", configs, (1.0,))
    assert best == whole and auc == pytest.approx(whole_auc) and auc > 0.75
    tried = {(round(r.share, 1), r.config): r.n for r in trials.groupBy("share", "config").agg(F.count("*").alias("n")).collect()}
    assert {c for s, c in tried if s == 0.3} == {0, 1, 2, 3} and len([1 for s, _ in tried if s == 1.0]) == 2 and set(tried.values()) == {3}


def test_search_within_a_time_limit(rows):
    best, _, trials = MO.search_pd(rows, ["StatedMonthlyIncome"], "logistic", [{"regParam": 0.1}, {"regParam": 0.2}], (0.5, 1.0), 0.9, seconds=0.0)
    assert {r.share for r in trials.collect()} == {0.5} and best in ({"regParam": 0.1}, {"regParam": 0.2})
