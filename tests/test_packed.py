"""The partitions that model fits read."""

import pytest
from pyspark.sql import functions as F

from lossbook.operators import models as MO
from lossbook.session import Shared, kept, packed, side_by_side, stage


@pytest.fixture(autouse=True)
def nothing_kept(spark):
    """Other modules cache rows of their own in the session that all tests share."""
    spark.catalog.clearCache()


def test_narrow_tables_are_dealt_out_for_fits(spark):
    narrow = stage(spark.range(1000, numPartitions=1), "narrow")
    sizes = [len(p) for p in packed(narrow, 100).rdd.glom().collect()]
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) <= 200
    assert packed(narrow, 10, 50).rdd.getNumPartitions() == 48 and packed(narrow, 10, 15).rdd.getNumPartitions() == 67
    assert packed(narrow).rdd.getNumPartitions() == 1 and packed(stage(spark.range(1000, numPartitions=4), "four"), 500).count() == 1000


def test_rows_of_a_fit_are_dealt_out_once(spark):
    dealt = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        dealt.add(1)
        return x

    rows = packed(stage(spark.range(300, numPartitions=1).select((F.col("id") % 2).cast("int").alias("is_bad"), "id"), "rows"), 100)
    with kept(rows.select("is_bad", seen("id").alias("id"))) as held:
        assert [held.filter("is_bad = 1").count(), held.count(), held.agg(F.sum("id")).first()[0]] == [150, 300, 44850]
        assert held.storageLevel.useMemory and held.storageLevel.useDisk
    assert dealt.value == 300 and not held.storageLevel.useMemory


def test_a_fit_keeps_its_rows_and_lets_them_go(spark, monkeypatch):
    held = []
    monkeypatch.setattr(MO, "_isotonic", lambda scored: held.append(spark._jsparkSession.sharedState().cacheManager().isEmpty()))
    rows = spark.range(120).select(F.col("id").alias("loan_id"), (F.col("id") % 2).cast("int").alias("is_bad"), (F.col("id") % 7).cast("double").alias("Term"))
    MO.fit_pd(rows, ["Term"], "logistic")
    assert held == [False] and spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_fits_side_by_side_share_the_rows_they_keep(spark):
    staged = stage(spark.range(200), "shared")
    one, two, other = (packed(staged.select("id", *more), 50) for more in ([], [], [F.lit(1).alias("x")]))
    with kept(one):
        with kept(two), kept(other):
            assert one.count() == two.count() == 200
        assert one.storageLevel.useMemory and two.storageLevel.useMemory and not other.storageLevel.useMemory
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def _loans(spark):
    return spark.range(240).select(F.col("id").alias("loan_id"), (F.col("id") % 3 == 0).cast("int").alias("is_bad"), (F.col("id") * 7 % 11).cast("double").alias("Term"))


def test_a_search_keeps_its_rows_and_lets_them_go(spark, monkeypatch):
    held, real = [], MO.pd_estimator
    monkeypatch.setattr(MO, "pd_estimator", lambda *a: held.append(spark._jsparkSession.sharedState().cacheManager().isEmpty()) or real(*a))
    MO.search_pd(_loans(spark), ["Term"], "logistic", [{"regParam": 0.1}, {"regParam": 0.2}], (0.5, 1.0), 0.5, folds=2)
    assert held == [False] * 6 and spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_models_of_the_same_rows_share_one_cut(spark, monkeypatch):
    rows = _loans(spark)
    cut, folds = stage(MO.calibration_cut(rows), "cut"), stage(MO.fold_cut(rows, 2), "folds")
    scores = lambda model: sorted((r.loan_id, r.raw_score, r.pd) for r in model.transform(rows).collect())      # noqa: E731
    alone = scores(MO.fit_pd(rows, ["Term"], "forest", {"numTrees": 3}))
    found = MO.search_pd(rows, ["Term"], "logistic", [{"regParam": 0.1}], (1.0,), folds=2)[:2]
    monkeypatch.setattr(MO, "stratified_split", None)          # neither is cut again
    monkeypatch.setattr(MO, "stratified_folds", None)
    assert scores(MO.fit_pd(rows, ["Term"], "forest", {"numTrees": 3}, cut)) == alone
    assert MO.search_pd(rows, ["Term"], "logistic", [{"regParam": 0.1}], (1.0,), folds=2, cut=folds)[:2] == found


def test_encoded_rows_of_a_search_are_not_written(spark, monkeypatch):
    written, real = [], MO.stage
    monkeypatch.setattr(MO, "stage", lambda df, name: written.append(df.columns) or real(df, name))
    MO.search_pd(_loans(spark), ["Term"], "logistic", [{"regParam": 0.1}, {"regParam": 0.2}], (0.5, 1.0), 0.5, folds=2)
    assert [c for c in written if "features" in c] == [] and spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_encoders_are_fitted_once_for_models_of_the_same_columns(spark, monkeypatch):
    rows, made, real = _loans(spark), [], MO.encoder
    cut, folds, shared = stage(MO.calibration_cut(rows), "cut"), stage(MO.fold_cut(rows, 2), "folds"), Shared()
    monkeypatch.setattr(MO, "encoder", lambda columns, scale=False: made.append(scale) or real(columns, scale))

    def cell(family, params):
        found = MO.search_pd(rows, ["Term"], family, [params], (1.0,), at_once=2, folds=2, cut=folds, shared=shared)
        return found[:2], sorted((r.loan_id, r.pd) for r in MO.fit_pd(rows, ["Term"], family, params, cut, shared).transform(rows).collect())

    cells = [("forest", {"numTrees": 3}), ("boosted_shallow", {"maxIter": 2}), ("boosted_deep", {"maxIter": 2})]
    together = side_by_side([lambda c=c: cell(*c) for c in cells])
    assert made == [False] * 3 and spark._jsparkSession.sharedState().cacheManager().isEmpty()          # two folds and the final fit, not nine
    alone = MO.fit_pd(rows, ["Term"], "forest", {"numTrees": 3}, cut)
    assert together[0][1] == sorted((r.loan_id, r.pd) for r in alone.transform(rows).collect())


def test_what_fails_to_be_made_is_made_by_the_next():
    shared, tries = Shared(), []

    def make():
        tries.append(1)
        if len(tries) == 1:
            raise ValueError("once")
        return 7

    with pytest.raises(ValueError):
        shared.get("k", make)
    assert side_by_side([lambda: shared.get("k", make)] * 4) == [7] * 4 and len(tries) == 2
