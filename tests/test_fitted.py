"""Fitted models: contributions add up, drivers and reasons, isotonic maps, bundles in batch and stream, segments."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.operators import models as MO

COLUMNS = ["StatedMonthlyIncome", "DebtToIncomeRatio", "IncomeRange", "EmploymentStatus"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(600):
        income, dti = float(rng.integers(500, 9000)), None if i % 17 == 0 else float(np.round(rng.random(), 2))
        job = ["Employed", "Retired", "Part-time", None][int(rng.integers(0, 4))]
        band = [*V.ORDINAL_ORDERS["IncomeRange"], None, "odd"][int(rng.integers(0, 9))]
        risk = -2 + 3 * (dti or 0.5) - income / 9000 + (job == "Part-time")
        out.append((i, income, dti, band, job, int(rng.random() < 1 / (1 + np.exp(-risk)))))
    return spark.createDataFrame(out, "loan_id long, StatedMonthlyIncome double, DebtToIncomeRatio double, IncomeRange string, EmploymentStatus string, is_bad int").cache()


@pytest.fixture(scope="module", params=["boosted_shallow", "forest", "logistic"])
def fitted(request, rows):
    return request.param, MO.fit_pd(rows, COLUMNS, request.param, {"maxIter": 4} if request.param != "forest" else {"numTrees": 4, "maxDepth": 4})


def test_contributions_sum_to_the_score(fitted, rows):
    family, model = fitted
    raw = {"boosted_shallow": vector_to_array("rawPrediction")[1], "forest": vector_to_array("probability")[1],
           "logistic": vector_to_array("rawPrediction")[1]}[family]
    want = {r.loan_id: r.raw for r in model.pipeline.transform(rows).select("loan_id", raw.alias("raw")).collect()}
    got = MO.contributions(model, rows).collect()
    assert len(got) == 600 and len({r.base for r in got}) == 1
    for r in got:
        assert r.score == pytest.approx(want[r.loan_id], abs=1e-9) and r.base + sum(r.parts) == pytest.approx(r.score)


def test_names_of_inputs(fitted, rows):
    family, model = fitted
    names = MO.feature_names(model, rows)
    assert {"StatedMonthlyIncome", "DebtToIncomeRatio", "IncomeRange_ord"} <= set(names) and any(n.startswith("EmploymentStatus_hot_") for n in names)
    drivers = MO.global_drivers(model, rows, 3).collect()
    assert len(drivers) == 3 and {r.feature for r in drivers} <= set(names)


def test_inputs_of_linear_models_are_centered(rows):
    model = MO.fit_pd(rows, COLUMNS, "logistic")
    means = model.pipeline.transform(rows).select(F.posexplode(vector_to_array("features")).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).collect()
    assert max(abs(r.m) for r in means) < 0.2                       # the pipeline saw 80 % of these rows
    parts = MO.contributions(model, rows).select(F.posexplode("parts").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).collect()
    assert max(abs(r.m) for r in parts) < 0.2


def test_reason_codes_are_the_largest_parts(fitted, rows):
    _, model = fitted
    names = MO.feature_names(model, rows)
    parts = {r.loan_id: dict(zip(names, r.parts)) for r in MO.contributions(model, rows).collect()}
    for r in MO.reason_codes(model, rows, 2).collect():
        sizes = sorted((abs(v) for v in parts[r.loan_id].values()), reverse=True)
        assert r.value == pytest.approx(parts[r.loan_id][r.feature]) and abs(r.value) == pytest.approx(sizes[r["rank"] - 1])


def test_isotonic_scores_rise_and_models_reload(fitted, rows, tmp_path):
    _, model = fitted
    scored = sorted((r.raw_score, r.pd) for r in model.transform(rows).collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(scored, scored[1:])) and all(0 <= p <= 1 for _, p in scored)
    model.save(str(tmp_path / "m"))
    again = MO.CalibratedModel.load(str(tmp_path / "m")).transform(rows)
    assert sorted((r.raw_score, r.pd) for r in again.collect()) == scored


def test_unknown_levels_are_scored(fitted, rows):
    _, model = fitted
    odd = rows.limit(5).withColumn("EmploymentStatus", F.lit("new here")).withColumn("IncomeRange", F.lit(None).cast("string"))
    assert model.transform(odd).filter("pd is null").count() == 0


def test_a_stream_scores_like_a_table(spark):
    import os

    import __spark_entry__ as entry
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("test tables are not here")
    rows = entry.queries()["r1_fitted_stream"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/orders.parquet").count() and all(r.same_as_batch for r in rows)
    assert {r.batch for r in rows} == {0, 1, 2} and all(0 <= r.pd <= 1 and 0 <= r.lgd <= 1 and r.ead >= 0 for r in rows)


def test_defaults_are_looked_up_once(spark):
    from lossbook.plans.scoring import fill_defaults
    rows = spark.createDataFrame([(1, None, "x"), (2, 3.0, None), (None, None, None), (2, 3.0, None)], "loan_id long, a double, t string")
    defaults = spark.createDataFrame([("a", 7.0, None), ("b", 8.0, None), ("t", None, "y"), ("u", None, "z"), (None, 1.0, "w")], "feature string, number double, text string")
    out = fill_defaults(rows, defaults, ["a", "b", "c"], ["t", "u"])
    got = sorted(map(tuple, out.select("loan_id", "a", "b", "c", "t", "u").collect()), key=str)
    assert got == [(1, 7.0, 8.0, None, "x", "z"), (2, 3.0, 8.0, None, "y", "z"), (2, 3.0, 8.0, None, "y", "z"), (None, 7.0, 8.0, None, "y", "z")]
    assert fill_defaults(rows, defaults.limit(0), ["a"], ["u"]).filter("u is null").count() == 4
    assert fill_defaults(rows, defaults, [], []).count() == 4
    assert "subquery" not in out._jdf.queryExecution().toString().lower()          # one for each name would make the plan grow with its square


def test_hazards_of_arrays_equal_those_of_rows(spark):
    from lossbook.operators import panel as PA
    rng = np.random.default_rng(5)
    loans = spark.createDataFrame([(i % 110, float(rng.integers(500, 9000)) if i % 9 else None, ["Employed", "Retired", None][i % 3], [12, 36, 60, 1][i % 4], int(rng.random() < 0.6))
                                   for i in range(120)], "loan_id long, StatedMonthlyIncome double, EmploymentStatus string, Term long, bad int")
    months = PA.expand(loans, "Term").withColumn("event", ((F.col("t") * 7 + F.col("loan_id")) % 5 < F.col("bad")).cast("int"))
    columns = ["StatedMonthlyIncome", "EmploymentStatus", "Term"]
    model = MO.fit_hazard(months.filter("loan_id % 2 = 0"), months, columns, "event")
    odd = loans.unionByName(spark.createDataFrame([(None, 1.0, "new", 36, 0), (7, None, None, None, 1)], loans.schema)).repartition(3)
    want = sorted((str(r.loan_id), str(r.StatedMonthlyIncome), r.bad, r.Term, r.t, round(r.pd, 10)) for r in model.transform(PA.expand(odd, "Term")).collect())
    got = MO.monthly_rates(model, odd, "Term", "h", loans_at_once=7)
    assert got.columns == [*odd.columns, "h"] and len({h for *_, h in want}) > 5
    assert sorted((str(r.loan_id), str(r.StatedMonthlyIncome), r.bad, r.Term, t, round(h, 10)) for r in got.collect() for t, h in enumerate(r.h, 1)) == want
    plan = got._jdf.queryExecution().toString().lower()
    assert "generate" not in plan and MO.monthly_rates(model, odd.limit(0), "Term", "h").count() == 0       # no row for each month
