"""Order statistics and survival metrics cut into many small parts equal brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossbook.operators import metrics as ME
from lossbook.operators import ranking as R
from lossbook.operators import survival as SU
from lossbook.operators.results import nearest_rank_picks

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def values():
    hot = np.concatenate([np.zeros(900), np.full(300, -7.25), np.round(RNG.normal(size=3000), 3)])
    return pd.DataFrame({"feature": ["a"] * 4200 + ["b"] * 3 + ["c"] + [None] * 500,
                         "value": [*hot, 1.0, 5.0, 9.0, 4.0, *np.round(RNG.exponential(size=500), 2)]})


def test_no_part_above_the_budget(spark, values):
    """Parts of a tally hold at most the budget, also after two cuts, and rise with the value."""
    rows = spark.createDataFrame(values).distinct()
    depth = R.depth_of(rows, ["feature"], 10)
    assert depth == 2
    parts = R.with_parts(rows, ["feature"], "value", depth).groupBy("feature", "_part").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).toPandas()
    assert parts.n.max() <= 10
    for _, g in parts.groupby("feature", dropna=False):
        g = g.sort_values("_part")
        assert (g.low.to_numpy()[1:] > g.high.to_numpy()[:-1]).all()


@pytest.mark.parametrize("budget", [10, 60])
def test_quantiles(spark, values, budget):
    got = {r["feature"]: (r["n"], r["grid"]) for r in R.quantile_grid(spark.createDataFrame(values), 10, ["feature"], "value", budget=budget).collect()}
    for f, g in values.groupby("feature", dropna=False):
        n, grid = got[None if pd.isna(f) else f]
        assert n == len(g) and grid == pytest.approx(np.quantile(g["value"], np.arange(11) / 10), abs=1e-12)


def test_quantiles_of_a_tally(spark, values):
    tally = spark.createDataFrame(values).groupBy("feature", "value").agg(F.count("*").alias("c"))
    key = lambda df: sorted((r.feature or "", r.n, tuple(r.grid)) for r in df.collect())       # noqa: E731
    assert key(R.quantile_grid(tally, 4, ["feature"], "value", "c", 10)) == key(R.quantile_grid(spark.createDataFrame(values), 4, ["feature"], "value"))


@pytest.mark.parametrize("budget", [10, 60, 10**6])
def test_running_totals(spark, values, budget):
    tally = values.groupby(["feature", "value"], dropna=False).size().rename("n").reset_index()
    tally["feature"] = tally.feature.astype(object).where(tally.feature.notna(), None)
    got = R.running_totals(spark.createDataFrame(tally), "value", ["n"], ["feature"], budget).toPandas()
    order = lambda df: df.assign(feature=df.feature.fillna("")).sort_values(["feature", "value"])
    want = order(tally)
    want["before"] = want.groupby("feature").n.cumsum() - want.n
    assert order(got)[["n_before", "n_all"]].to_numpy().tolist() == np.stack([want.before, want.groupby("feature").n.transform("sum")], 1).tolist()


def test_metrics(spark, monkeypatch):
    y, s = RNG.integers(0, 2, 3000), np.round(RNG.random(3000), 3)
    frame = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    whole = ME.ranking_metrics(frame, F.col("s"), F.col("y")).first()
    monkeypatch.setattr(R, "BUDGET", 8)
    assert ME.ranking_metrics(frame, F.col("s"), F.col("y")).first().asDict() == pytest.approx(whole.asDict())
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    assert whole["AUC"] == pytest.approx((diff > 0).mean() + (diff == 0).mean() / 2)


@pytest.mark.parametrize("budget", [5, 10**6])
def test_picks_among_many_ties(spark, budget):
    rows = [(i, float(0 if i < 700 else i // 3)) for i in range(1000)] + [(5000, None)]
    got = {r["tenth"]: r["loan_id"] for r in nearest_rank_picks(spark.createDataFrame(rows, "loan_id long, s double"), "s", "loan_id", [1, 5, 9], budget).collect()}
    assert got == {1: 99, 5: 499, 9: 899}


@pytest.mark.parametrize("budget", [6, 10**6])
def test_concordance_and_dynamic_auc(spark, budget):
    n = 220
    pdf = pd.DataFrame({"T_obs": RNG.integers(1, 15, n), "is_event": RNG.random(n) < 0.4, "r": np.round(RNG.random(n), 2)})
    df = spark.createDataFrame(pdf)
    g = {r["t"]: r["G"] for r in SU.censoring_survival(df).collect()}
    num = den = 0.0
    for i in pdf[pdf.is_event].itertuples():
        if g[i.T_obs] > 0:
            later = pdf[(pdf.T_obs > i.T_obs) | ((pdf.T_obs == i.T_obs) & ~pdf.is_event)]
            den += len(later) / g[i.T_obs] ** 2
            num += ((later.r < i.r) + 0.5 * (later.r == i.r)).sum() / g[i.T_obs] ** 2
    assert SU.ipcw_concordance(df, df, "r", budget).first()[0] == pytest.approx(num / den)
    for row in SU.dynamic_auc(df, df, "r", [1, 4, 9, 40], budget).collect():
        cases = pdf[pdf.is_event & (pdf.T_obs <= row.t) & pdf.T_obs.map(lambda t: g[t] > 0)]
        controls = pdf[pdf.T_obs > row.t].r.to_numpy()
        if not len(cases) or not len(controls):
            assert row.auc is None
            continue
        w = 1 / cases.T_obs.map(g).to_numpy()
        wins = (controls[None] < cases.r.to_numpy()[:, None]) + 0.5 * (controls[None] == cases.r.to_numpy()[:, None])
        assert row.auc == pytest.approx((w * wins.sum(1)).sum() / (w.sum() * len(controls)))


def test_concordance_without_events(spark):
    df = spark.createDataFrame([(3, False, 0.5), (4, False, 0.1)], "T_obs long, is_event boolean, r double")
    assert SU.ipcw_concordance(df, df, "r").first()[0] is None
