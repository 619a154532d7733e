"""Queries on fitted models and segments (S12, E1-E14, M11). Most have no SQL: the fit is iterative."""

from __future__ import annotations

from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.operators import metrics as ME
from lossbook.operators import models as MO
from lossbook.operators import panel as PA
from lossbook.operators import risk_tables as RT
from lossbook.operators import segments as SG
from lossbook.operators import splits as SP
from lossbook.operators import validate as VA
from lossbook.operators.features import all_features
from lossbook.operators.labels import categoricals_as_text, ead_label, feature_columns, lgd_label
from lossbook.operators.population import defaulted
from lossbook.plans import jobs
from lossbook.plans import oracle_book as O
from lossbook.plans.catalog_reports import bin_sql
from lossbook.plans.grid import run_cells
from lossbook.plans.registry import query
from lossbook.session import Shared, new_path, packed, side_by_side, stage
from lossbook.sources import book as B
from lossbook.sources.keyed import KeyedTable

BASE = ["CreditScoreRangeLower", "DebtToIncomeRatio", "BankcardUtilization", "StatedMonthlyIncome", "LoanOriginalAmount", "Term",
        "InquiriesLast6Months", "AmountDelinquent", "IncomeRange", "bankcard_util_bucket", "EmploymentStatus"]
ENGINEERED = ["ResidualIncome", "ReferencePTI", "TotalUtilization", "OnTimeRate"]
MACRO = V.MACRO_TTC


def _split_frame(spark, d, columns=(), macro: bool = False):
    frame = jobs.prepared(spark, d) if macro else jobs.feature_table(spark, d)
    cols = dict.fromkeys(["loan_id", V.TARGET, "LoanOriginationDate", *BASE, *ENGINEERED, *(MACRO if macro else []), *columns])
    frame = stage(SP.stratified_split(stage(frame.select(*cols), "features")), "split")
    return frame.filter("split = 'train'").drop("split"), frame.filter("split = 'test'").drop("split")


@query("s12_model_persist_load")
def _(spark, d):
    train, test = _split_frame(spark, d)
    path = new_path(spark, "model")
    MO.fit_pd(train, BASE, "logistic").save(path)
    return MO.CalibratedModel.load(path).transform(test).select("loan_id", "raw_score", "pd")


def _ord_sql(c: str) -> str:
    return f"coalesce(list_position({V.ORDINAL_ORDERS[c]!r}, {c})-1,-1)::DOUBLE AS {c}_ord"


@query("e1_column_encoder", O.features(f"SELECT loan_id, {_ord_sql('IncomeRange')}, {_ord_sql('bankcard_util_bucket')} FROM pop"))
def _(spark, d):
    frame = jobs.feature_table(spark, d)
    stages = MO.encoder(["IncomeRange", "bankcard_util_bucket"])
    return Pipeline(stages=stages).fit(frame).transform(frame).select("loan_id", "IncomeRange_ord", "bankcard_util_bucket_ord")


def _register_family(name: str, family: str) -> None:
    @query(name)
    def _(spark, d):
        train, test = _split_frame(spark, d)
        return MO.evaluate_pd(MO.fit_pd(train, BASE + ENGINEERED, family), test, family)


for _n, _f in {"e2_boosted_trees": "boosted_deep", "e3_random_forest": "forest", "e4_elastic_net": "logistic"}.items():
    _register_family(_n, _f)


@query("e5_parameter_search")
def _(spark, d):
    """Successive halving over nine settings of the elastic net on all model features."""
    train, _test = _split_frame(spark, d, V.MODEL_FEATURES)
    configs = [{"regParam": r, "elasticNetParam": e} for r in (0.0003, 0.01, 0.3) for e in (0.0, 0.5, 1.0)]
    best, auc, _trials = MO.search_pd(train, V.MODEL_FEATURES, "logistic", configs)
    return spark.createDataFrame([(k, float(v), auc) for k, v in best.items()], "parameter string, value double, cv_auc double")


@query("e6_isotonic_calibration")
def _(spark, d):
    train, test = _split_frame(spark, d)
    scored = MO.fit_pd(train, BASE, "boosted_shallow").transform(test)
    return scored.select("loan_id", "raw_score", "pd", V.TARGET)


@query("e7_tune_fit_calibrate")
def _(spark, d):
    train, test = _split_frame(spark, d)
    best, _auc = MO.tune_pd(train, BASE, "boosted_shallow", {"maxDepth": [2, 4]})
    return MO.evaluate_pd(MO.fit_pd(train, BASE, "boosted_shallow", best), test, "boosted_shallow")


@query("e8_ead_lgd_regressors")
def _(spark, d):
    train, test = _split_frame(spark, d, ["LP_CustomerPrincipalPayments", "LP_NetPrincipalLoss"])
    out = None
    for name, label, hi in (("ead", ead_label(), None), ("lgd", lgd_label(), 1.0)):
        tr = packed(stage(defaulted(train).withColumn("label", label).filter("label IS NOT NULL"), "defaults"), fewer=False)
        te = defaulted(test).withColumn("label", label).filter("label IS NOT NULL")
        pred = MO.predict_amount(MO.fit_amount(tr, BASE, "label"), te, "p", 0.0, hi)
        row = ME.reg_metrics(pred, F.col("label"), F.col("p")).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _cluster_frame(spark, d):
    return _split_frame(spark, d, V.CLUSTER_FEATURES)


@query("e9_risk_cluster_fit")
def _(spark, d):
    train, _test = _cluster_frame(spark, d)
    model = SG.fit_segments(train)
    rows = [(k, s, k == model.k) for k, s in model.scores.items()]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")


@query("e10_risk_cluster_assign")
def _(spark, d):
    train, test = _cluster_frame(spark, d)
    model = SG.fit_segments(train, k_range=range(3, 5))
    return VA.segment_rates(model.transform(train.unionByName(test)), "RiskCluster")


def _panel_frame(spark, d):
    columns = list(dict.fromkeys([*V.CREDIT_BUREAU, *V.APPLICATION_NUMERIC, *V.APPLICATION_CATEGORICAL, *V.PRIOR_HISTORY,
                                  "DateCreditPulled", "FirstRecordedCreditLine"]))
    loans = categoricals_as_text(all_features(jobs.panel_loans(spark, d, columns)))
    return stage(loans.select("loan_id", "LoanOriginationDate", "T_obs", "is_event", *BASE, *ENGINEERED), "durations")


@query("e11_hazard_fit")
def _(spark, d):
    parts = SP.out_of_time(PA.loan_months(_panel_frame(spark, d)), B.OOT_CUTOFF)
    train, test = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")
    loans = stage(SP.calibration_loans(train.filter("t = 1")), "calibration")
    fit_pool = train.join(loans.filter("NOT is_cal"), "loan_id", "left_semi").withColumn("row_key", F.col("loan_id") * 1000 + F.col("t"))
    fit = SP.downsample_negatives(fit_pool, PA.EVENT, "row_key")
    cal = train.join(loans.filter("is_cal"), "loan_id", "left_semi")
    model = MO.fit_hazard(fit, cal, BASE + ENGINEERED, PA.EVENT)
    scored = stage(model.transform(test).select(PA.EVENT, F.col("pd").alias("h")), "hazards")
    return ME.ranking_metrics(scored, F.col("h"), F.col(PA.EVENT))


@query("e12_global_drivers")
def _(spark, d):
    train, _test = _split_frame(spark, d, macro=True)
    return MO.global_drivers(MO.fit_pd(train, BASE + ENGINEERED + MACRO, "logistic"), train)


@query("e12_tree_drivers")
def _(spark, d):
    """Mean size of each input's contribution to the score of boosted trees."""
    train, test = _split_frame(spark, d, macro=True)
    return MO.global_drivers(MO.fit_pd(train, BASE + ENGINEERED + MACRO, "boosted_deep"), test)


@query("e12_contributions")
def _(spark, d):
    """Every test loan's score by boosted trees as a base and the sum of its inputs' contributions."""
    train, test = _split_frame(spark, d, macro=True)
    model = MO.fit_pd(train, BASE + ENGINEERED + MACRO, "boosted_deep")
    margin = model.pipeline.transform(test).select("loan_id", vector_to_array("rawPrediction")[1].alias("margin"))
    found = MO.contributions(model, test).join(margin, "loan_id")
    return found.select("loan_id", "base", "margin", (F.abs(F.col("score") - F.col("margin")) < 1e-9).alias("complete"))


@query("e13_reason_codes")
def _(spark, d):
    train, test = _split_frame(spark, d, macro=True)
    return MO.reason_codes(MO.fit_pd(train, BASE + ENGINEERED + MACRO, "logistic"), test)


_MONO = dict(V.RISK_DIRECTIONS)
_SIGN = "CASE feature " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _MONO.items()) + " END"


@query("e14_monotone_check", bin_sql(f"""SELECT feature, direction, count(step) AS steps, count(*) FILTER (WHERE step*direction>0) AS violations,
  count(*) FILTER (WHERE step*direction>0)=0 AS monotone FROM (SELECT feature, {_SIGN} AS direction,
  "WOE"-lag("WOE") OVER (PARTITION BY feature ORDER BY coalesce(bin::DOUBLE, try_cast(key AS DOUBLE))) AS step FROM woe
  WHERE "Count">0 AND coalesce(bin::DOUBLE, try_cast(key AS DOUBLE)) IS NOT NULL) GROUP BY 1,2""", list(_MONO), ["EmploymentStatus"]))
def _(spark, d):
    frame = stage(jobs.feature_table(spark, d).select(*_MONO, V.TARGET), "features")
    return RT.monotone_check(frame, _MONO)


# version -> engineered features, borrower segment, macro set
VERSIONS = {"v1_base": (False, False, None), "v2_cluster": (False, True, None), "v3_engineered": (True, True, None), "v4_macro": (True, True, "ttc")}
MACRO_VERSIONS = {"v3_macro": (False, False), "v5_all": (True, True)}
FAMILIES = ["boosted_deep", "boosted_shallow", "forest", "logistic"]
CONFIGS = {"boosted_deep": [{"maxDepth": 4, "maxIter": 8}], "boosted_shallow": [{"maxDepth": 3, "maxIter": 8}], "forest": [{"maxDepth": 6, "numTrees": 20}],
           "logistic": [{"regParam": 0.01}]}


def _grid_frames(spark, d, splits):
    """Per split its training and test rows, with the segment learned on the training rows."""
    whole = stage(jobs.prepared(spark, d), "prepared")

    def frames(split):
        both = SP.stratified_split(whole) if split == "random" else SP.out_of_time(whole, B.OOT_CUTOFF)
        train = stage(both.filter("split = 'train'").drop("split"), "train")
        segment = SG.fit_segments(train)
        return tuple(side_by_side([lambda: stage(segment.transform(train), "train"),
                                   lambda: stage(segment.transform(both.filter("split = 'test'").drop("split")), "test")]))

    return dict(zip(splits, side_by_side([partial(frames, split) for split in splits])))


@query("m11_experiment_grid")
def _(spark, d):
    """Feature versions by model families: tuned, fitted, calibrated, judged on the test rows."""
    train, test = _grid_frames(spark, d, ["random"])["random"]
    folds, cut = side_by_side([lambda: stage(MO.fold_cut(train), "folds"), lambda: stage(MO.calibration_cut(train), "train")])
    shared = Shared()

    def work(cell):
        columns = feature_columns(*VERSIONS[cell["version"]])
        best, auc, _trials = MO.search_pd(train, columns, cell["model"], CONFIGS[cell["model"]], (0.25, 1.0), 0.5, at_once=2, cut=folds, shared=shared)
        row = MO.evaluate_pd(MO.fit_pd(train, columns, cell["model"], best, cut, shared), test, "cell").filter("model = 'cell_calibrated'").first()
        return {"cv_auc": auc, "test_auc_cal": row.AUC, "gini": row.Gini, "ks": row.KS, "brier": row.Brier, "n_features": len(columns)}

    table = KeyedTable(spark, new_path(spark, "grid"), ["version", "model"])
    cells = [{"version": v, "model": m} for v in VERSIONS for m in FAMILIES]
    return run_cells(spark, cells, work, ["cv_auc", "test_auc_cal", "gini", "ks", "brier", "n_features"], table, at_once=8)


@query("m11_macro_grid")
def _(spark, d):
    """Macro sets under the random and the out-of-time split: calibrated test AUC of every family."""
    frames = _grid_frames(spark, d, ["random", "oot"])
    cuts = dict(zip(frames, side_by_side([partial(lambda train: stage(MO.calibration_cut(train), "train"), train) for train, _test in frames.values()])))
    shared = {split: Shared() for split in frames}

    def work(cell):
        columns = feature_columns(*MACRO_VERSIONS[cell["version"]], cell["macro"])
        train, test = frames[cell["split"]]
        row = MO.evaluate_pd(MO.fit_pd(train, columns, cell["model"], CONFIGS[cell["model"]][0], cuts[cell["split"]], shared[cell["split"]]), test, "cell").filter("model = 'cell_calibrated'").first()
        return {"test_auc_cal": row.AUC}

    table = KeyedTable(spark, new_path(spark, "macro-grid"), ["version", "split", "macro", "model"])
    cells = [{"version": v, "split": s, "macro": x, "model": m} for v in MACRO_VERSIONS for s in ("random", "oot") for x in ("raw", "ttc") for m in FAMILIES]
    return run_cells(spark, cells, work, ["test_auc_cal"], table, at_once=8)
