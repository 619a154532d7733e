"""Fitted models on pyspark.ml: encoders, PD, EAD, LGD and hazard models, drivers."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook import fixed_values as V
from lossbook.functions.expr import clip
from lossbook.operators import metrics as ME
from lossbook.operators.labels import check_features
from lossbook.operators.splits import stratified_folds, stratified_split
from lossbook.session import Shared, kept, packed, stage

SEED = 42
MISSING_NUMBER = -1.0       # trees take no null; -1 sets missing values apart
_ASSEMBLED, _NUMBERS = "_assembled", "_numbers"


def ordinal_sql(column: str) -> str:
    """Position of a level in its fixed order; unknown and missing levels are -1."""
    def quoted(level: str) -> str:
        return "'" + level.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {quoted(level)} THEN {float(i)}" for i, level in enumerate(V.ORDINAL_ORDERS[column]))
    return f"CASE {column} {cases} ELSE -1.0 END AS {column}_ord"


def split_kinds(columns: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Numeric, ordinal and nominal columns of a feature list."""
    columns = check_features(list(columns))
    ordinal = [c for c in columns if c in V.ORDINAL_ORDERS]
    nominal = [c for c in columns if c in V.CATEGORICAL_FEATURES and c not in ordinal]
    return [c for c in columns if c not in ordinal and c not in nominal], ordinal, nominal


def encoder(columns: Sequence[str], scale: bool = False) -> list:
    """Stages from raw feature columns to `features`; an unseen nominal level becomes all zeros.

    With `scale`, for linear models, numbers have mean 0 and spread 1, and ordinal and one-hot inputs have mean 0.
    """
    numeric, ordinal, nominal = split_kinds(columns)
    number = "CAST({0} AS DOUBLE)" if scale else f"coalesce(CAST({{0}} AS DOUBLE), {MISSING_NUMBER}D)"
    exprs = [number.format(c) + f" AS {c}_num" for c in numeric] + [ordinal_sql(c) for c in ordinal]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")] if exprs else []
    inputs = [f"{c}_num" for c in numeric]
    if scale and numeric:
        stages += [Imputer(strategy="median", inputCols=inputs, outputCols=[f"{c}_imp" for c in numeric]),
                   VectorAssembler(inputCols=[f"{c}_imp" for c in numeric], outputCol=_NUMBERS),
                   StandardScaler(inputCol=_NUMBERS, outputCol="_scaled", withMean=True)]
        inputs = ["_scaled"]
    if nominal:
        stages += [StringIndexer(inputCols=nominal, outputCols=[f"{c}_idx" for c in nominal], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}_idx" for c in nominal], outputCols=[f"{c}_hot" for c in nominal])]
    inputs += [*[f"{c}_ord" for c in ordinal], *[f"{c}_hot" for c in nominal]]
    if not scale:
        return stages + [VectorAssembler(inputCols=inputs, outputCol="features")]
    return stages + [VectorAssembler(inputCols=inputs, outputCol=_ASSEMBLED),
                     StandardScaler(inputCol=_ASSEMBLED, outputCol="features", withMean=True, withStd=False)]


def pd_estimator(family: str, params: dict | None = None):
    """One of the four PD families: two boosted-tree settings, a forest and an elastic net."""
    common = dict(featuresCol="features", labelCol="label", weightCol="weight")
    params = dict(params or {})
    if family == "boosted_deep":
        return GBTClassifier(**common, seed=SEED, **({"maxIter": 15, "maxDepth": 4, "stepSize": 0.15, "subsamplingRate": 0.8} | params))
    if family == "boosted_shallow":
        return GBTClassifier(**common, seed=SEED, **({"maxIter": 15, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 0.8} | params))
    if family == "forest":
        return RandomForestClassifier(**common, seed=SEED, **({"numTrees": 30, "maxDepth": 6, "minInstancesPerNode": 5} | params))
    if family == "logistic":
        return LogisticRegression(**common, **({"elasticNetParam": 0.5, "regParam": 0.001, "maxIter": 50} | params))
    raise ValueError(f"unknown model family {family!r}")


def with_class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight`: positives weigh as many times as negatives outnumber them."""
    n = rows.agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).first()
    ratio = (n["n"] - n["pos"]) / max(n["pos"], 1)
    return rows.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(1.0))


@dataclass
class CalibratedModel:
    """Pipeline and isotonic map; adds `raw_score` and `pd`."""

    pipeline: PipelineModel
    isotonic: IsotonicRegressionModel

    def transform(self, rows: DataFrame) -> DataFrame:
        keep = rows.columns
        scored = self.pipeline.transform(rows).withColumn("raw_score", vector_to_array("probability")[1])
        return self.isotonic.transform(scored).select(*keep, "raw_score", clip(F.col("pd"), 0, 1).alias("pd"))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.isotonic.write().overwrite().save(f"{path}/isotonic")

    @staticmethod
    def load(path: str) -> CalibratedModel:
        return CalibratedModel(PipelineModel.load(f"{path}/pipeline"), IsotonicRegressionModel.load(f"{path}/isotonic"))


def _isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    """Fit on score groups, so that the fit sees distinct scores with their row counts."""
    groups = (scored.select(vector_to_array("probability")[1].alias("raw_score"), F.col("label").cast("double").alias("label"))
              .groupBy("raw_score").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight")))
    return IsotonicRegression(featuresCol="raw_score", labelCol="label", weightCol="weight", predictionCol="pd").fit(groups)


def calibration_cut(train: DataFrame) -> DataFrame:
    """Training rows with `label` and `split`: 80 % are fitted on (`train`), the other 20 % calibrate (`test`)."""
    return stratified_split(train.withColumnRenamed(V.TARGET, "label"), stratum="label")


def _encoded(rows: DataFrame, columns: Sequence[str], scale: bool, keep: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """The encoder fitted on `rows`, and `rows` as it encodes them."""
    model = Pipeline(stages=encoder(columns, scale)).fit(rows)
    return model, model.transform(rows).select(*keep, "features")


def _fit_encoded(model: PipelineModel, rows: DataFrame, estimator) -> PipelineModel:
    """Encoder and estimator fitted on encoded rows, which executors keep: tree fits pass over them several times.

    A linear fit keeps blocks of its own after two passes, so its rows are not kept once more.
    """
    with ExitStack() as held:
        if not isinstance(estimator, LogisticRegression):
            held.enter_context(kept(rows))
        return PipelineModel([*model.stages, estimator.fit(rows)])


def fit_pd(train: DataFrame, columns: Sequence[str], family: str = "boosted_deep", params: dict | None = None,
           cut: DataFrame | None = None, shared: Shared | None = None) -> CalibratedModel:
    """Fit on 80 % of the training rows, calibrate on the other 20 %. Takes training rows only.

    Many models of the same rows share `cut`, the stage table of `calibration_cut(train)`, so rows are cut once, and encoders
    by `shared`.
    """
    names, scale = ["loan_id", "label", "split", *columns], family == "logistic"
    split = stage(calibration_cut(train).select(*names), "train") if cut is None else cut.select(*names)
    with kept(packed(split)) as parts:
        coded, fit = (shared or Shared()).get(("fit", *columns, scale), lambda: _encoded(
            with_class_weight(parts.filter("split = 'train'")), columns, scale, ["label", "weight"]))
        model = _fit_encoded(coded, fit, pd_estimator(family, params))
        return CalibratedModel(model, _isotonic(model.transform(parts.filter("split = 'test'"))))


def fold_cut(train: DataFrame, folds: int = V.CV_FOLDS) -> DataFrame:
    """Training rows with `label`, `weight`, `fold` and their place among nested shares, cut by key hash."""
    folded = with_class_weight(stratified_folds(train.withColumnRenamed(V.TARGET, "label"), stratum="label", folds=folds))
    return folded.withColumn("_place", F.pmod(F.xxhash64(F.lit("share"), "loan_id"), F.lit(1_000_003)) / F.lit(1_000_003.0))


def tune_pd(train: DataFrame, columns: Sequence[str], family: str, grid: dict[str, list]) -> tuple[dict, float]:
    """Best parameters and mean fold AUC; folds are cut by key hash, encoders refit in every fold."""
    folded = with_class_weight(stratified_folds(train.withColumnRenamed(V.TARGET, "label"), stratum="label"))
    rows = stage(folded.select("loan_id", "label", "weight", "fold", *columns), "folds")
    est = pd_estimator(family)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    maps = builder.build()
    cv = CrossValidator(estimator=Pipeline(stages=[*encoder(columns, family == "logistic"), est]), estimatorParamMaps=maps,
                        evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=V.CV_FOLDS, foldCol="fold", parallelism=2)
    scores = cv.fit(rows).avgMetrics
    best = max(range(len(maps)), key=lambda i: scores[i])
    return {p.name: v for p, v in maps[best].items()}, float(scores[best])


def search_pd(train: DataFrame, columns: Sequence[str], family: str, configs: Sequence[dict], shares: Sequence[float] = (1 / 9, 1 / 3, 1.0),
              keep: float = 1 / 3, seconds: float | None = None, at_once: int = 4, folds: int = V.CV_FOLDS,
              cut: DataFrame | None = None, shared: Shared | None = None) -> tuple[dict, float, DataFrame]:
    """The best of `configs` by successive halving: (parameters, mean fold AUC, all trials).

    Every configuration is tried on a small share of the rows; the best `keep` of them go on to the next share. Shares
    are nested by the hash of the key, folds are cut once, and the encoder is fitted again in every fold of every share. Folds
    come one after the other, and the fits of a fold run side by side. Executors keep the rows, and the encoded ones of a fold where
    several fits or the passes of a tree fit read them; those are wide, so they are neither written nor dealt out again. After
    `seconds` no round begins but the first, and the best of the last complete round wins. Trials are (share, config, fold, auc);
    ties go to the earlier configuration. Many searches over the same rows share `cut`, the stage table of
    `fold_cut(train, folds)`, and by `shared` the encoded rows, which are then kept until the last of the searches has ended.
    """
    spark, began = train.sparkSession, time.monotonic()
    names, scale = ["loan_id", "label", "weight", "fold", "_place", *columns], family == "logistic"
    folded = stage(fold_cut(train, folds).select(*names), "folds") if cut is None else cut.select(*names)
    judge = BinaryClassificationEvaluator(labelCol="label", numBins=0)
    alive, trials, mean = list(range(len(configs))), [], {}
    with kept(packed(folded)) as rows:
        for n, share in enumerate(shares):
            if len(alive) == 1 and n + 1 < len(shares):
                continue                                       # nothing to choose: its value comes from the last share
            if mean and seconds is not None and time.monotonic() - began > seconds:
                break
            some, found = rows.filter(F.col("_place") < share), []
            with ExitStack() as round_:
                for k in range(folds):
                    def sides(k: int = k) -> tuple[DataFrame, DataFrame]:
                        coded, fit = _encoded(some.filter(F.col("fold") != k), columns, scale, ["label", "weight"])
                        return fit, coded.transform(some.filter(F.col("fold") == k)).select("label", "weight", "features")

                    fit, rest = (shared or Shared()).get(("fold", *columns, scale, share, folds, k), sides)
                    with ExitStack() as fold:
                        if len(alive) > 1 or not scale:
                            for side in (fit, rest):
                                (fold if shared is None else round_).enter_context(kept(side))

                        def one(c: int) -> tuple[int, int, float]:
                            return c, k, float(judge.evaluate(pd_estimator(family, configs[c]).fit(fit).transform(rest)))

                        with ThreadPoolExecutor(at_once) as pool:
                            found += pool.map(one, alive)
            trials += [(float(share), c, k, auc) for c, k, auc in found]
            mean = {c: sum(auc for d, _, auc in found if d == c) / folds for c in alive}
            alive = sorted(alive, key=lambda c: (-mean[c], c))[:max(1, math.ceil(len(alive) * keep))]
    best = min(mean, key=lambda c: (-mean[c], c))
    return dict(configs[best]), mean[best], spark.createDataFrame(trials, "share double, config int, fold int, auc double")


def evaluate_pd(model: CalibratedModel, test: DataFrame, name: str, target: str = V.TARGET) -> DataFrame:
    """Raw and calibrated metric rows on the test split."""
    scored = stage(model.transform(test).select(F.col(target).alias("y"), "raw_score", "pd"), "scored")
    rows = [ME.pd_metrics(scored, F.col(c), F.col("y")).select(F.lit(f"{name}_{label}").alias("model"), "*")
            for c, label in (("raw_score", "raw"), ("pd", "calibrated"))]
    return rows[0].unionByName(rows[1])


def fit_amount(train: DataFrame, columns: Sequence[str], label: str) -> PipelineModel:
    """EAD or LGD regressor on defaulted rows; predictions are bounded when scored."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=10, maxDepth=4, seed=SEED)
    return _fit_encoded(*_encoded(train, columns, False, [label]), gbt)


def predict_amount(model: Transformer, rows: DataFrame, out: str, lo: float | None = 0.0, hi: float | None = None) -> DataFrame:
    return model.transform(rows).select(*rows.columns, clip(F.col("prediction"), lo, hi).alias(out))


def fit_hazard(fit_rows: DataFrame, calibration_rows: DataFrame, columns: Sequence[str], event: str) -> CalibratedModel:
    """Monthly hazard on down-sampled rows, calibrated back to true rates on un-sampled loans."""
    cols = [*columns, "t", "t_frac"]
    with kept(packed(stage(fit_rows.withColumnRenamed(event, "label").select("label", *cols), "hazard-fit"))) as rows:
        model = _fit_encoded(*_encoded(with_class_weight(rows), cols, False, ["label", "weight"]), pd_estimator("boosted_shallow", {"maxIter": 10}))
    return CalibratedModel(model, _isotonic(model.transform(calibration_rows.withColumnRenamed(event, "label").select("label", *cols))))


def _month_values(node, used: dict[int, int], t: int, t_frac: int):
    """A tree as a function of inputs (loans x used inputs), months and shares of the term (loans x months)."""
    if node.numDescendants() == 0:
        value = node.prediction()
        return lambda x, m, s: value
    split = node.split()
    f = split.featureIndex()
    left, right = (_month_values(child, used, t, t_frac) for child in (node.leftChild(), node.rightChild()))
    if "Continuous" in split.getClass().getName():
        edge = float(split.threshold())
        test = lambda v: v <= edge
    else:
        levels = [float(c) for c in split.leftCategories()]
        test = lambda v: np.isin(v, levels)
    if f == t:
        return lambda x, m, s: np.where(test(m), left(x, m, s), right(x, m, s))
    if f == t_frac:
        return lambda x, m, s: np.where(test(s), left(x, m, s), right(x, m, s))
    at = used.setdefault(f, len(used))
    return lambda x, m, s: np.where(test(x[:, at:at + 1]), left(x, m, s), right(x, m, s))


def monthly_rates(model: CalibratedModel, loans: DataFrame, months: str, out: str, loans_at_once: int = 2000) -> DataFrame:
    """Add `out`: the calibrated rates of a boosted model over `t` and `t_frac` at months 1..`months`, in the order of the months.

    A loan is encoded once, with the inputs that its months share; the trees then meet all its months as arrays, so months are not
    laid out as rows. The rates are those of `model.transform` over `panel.expand`; a loan without a number of months is left out.
    """
    *stages, boosted = model.pipeline.stages
    loans = loans.filter(F.col(months).isNotNull())
    numbered = loans.withColumn("t", F.lit(1).cast("long")).withColumn("t_frac", F.lit(1.0))
    coded = PipelineModel(stages).transform(numbered)
    names, used = feature_names(model, numbered), {}
    trees = [_month_values(tree._call_java("rootNode"), used, names.index("t"), names.index("t_frac")) for tree in boosted.trees]
    weights = [float(w) for w in boosted.treeWeights]
    edges, rates = np.array(model.isotonic.boundaries.toArray()), np.array(model.isotonic.predictions.toArray())

    def calibrated(score: np.ndarray) -> np.ndarray:
        """Straight lines between the points of the map; a score that is a point's but for rounding has its rate."""
        above = np.searchsorted(edges, score)
        hi, lo = np.minimum(above, len(edges) - 1), np.maximum(above - 1, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            between = rates[lo] + (rates[hi] - rates[lo]) * (score - edges[lo]) / (edges[hi] - edges[lo])
        between = np.where(hi == lo, rates[lo], between)
        near = np.where(np.abs(edges[hi] - score) <= np.abs(edges[lo] - score), hi, lo)
        return np.clip(np.where(np.abs(edges[near] - score) <= 1e-14, rates[near], between), 0, 1)

    def curves(rows: pa.Array) -> pa.Array:
        inputs, ends = rows.field("x"), rows.field("t")
        parts = [np.zeros(0)]
        for at in range(0, len(rows), loans_at_once):
            x, t, s = inputs.slice(at, loans_at_once), ends.slice(at, loans_at_once), rows.field("s").slice(at, loans_at_once)
            n = pc.list_value_length(t).to_numpy(zero_copy_only=False)
            there = np.arange(n.max())[None, :] < n[:, None]
            month, share = np.ones(there.shape), np.ones(there.shape)
            month[there], share[there] = t.flatten().to_numpy(zero_copy_only=False), s.flatten().to_numpy(zero_copy_only=False)
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(used))
            margin = sum((w * tree(x, month, share) for w, tree in zip(weights, trees)), np.zeros(there.shape))
            parts.append(calibrated(1 / (1 + np.exp(-2 * margin[there]))))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ends).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))

    x = vector_to_array("features")
    month = F.array_sort(F.sequence(F.lit(1).cast("long"), F.col(months).cast("long")))
    coded = coded.select(*loans.columns, x.alias("_x"), month.alias("_t"))
    inputs = F.array(*[F.get("_x", F.lit(i)) for i in used]) if used else F.array().cast("array<double>")
    row = F.struct(inputs.alias("x"), F.transform("_t", lambda t: t.cast("double")).alias("t"), F.transform("_t", lambda t: t / F.col("Term")).alias("s"))
    return coded.select(*loans.columns, F.arrow_udf(curves, "array<double>")(row).alias(out))


def feature_names(model: CalibratedModel, rows: DataFrame) -> list[str]:
    """Names of the inputs of a fitted model, in the order of its vector."""
    stages = model.pipeline.stages
    outputs = {st.getOutputCol(): st for st in stages if isinstance(st, VectorAssembler)}
    column = _ASSEMBLED if _ASSEMBLED in outputs else "features"
    attrs = model.pipeline.transform(rows.limit(0)).schema[column].metadata["ml_attr"]["attrs"]
    flat = sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])
    names = [a.get("name", f"slot{a['idx']}") for a in flat]
    if _NUMBERS in outputs:                                  # the scaler forgets the names of its inputs
        numbers = [c.removesuffix("_imp").removesuffix("_num") for c in outputs[_NUMBERS].getInputCols()]
        names[:len(numbers)] = numbers
    return [n.removesuffix("_num") for n in names]


@dataclass
class _Leaf:
    """A leaf: its number in the tree and what each input adds on the way from the root to it."""

    at: int
    adds: dict[int, float]


def _tree_value(node, probability: bool) -> float:
    if not probability:
        return node.prediction()
    stats = list(node.impurityStats().stats())
    return stats[1] / max(sum(stats), 1e-300)


def _walk(node, x: Column, probability: bool, adds: dict[int, float], leaves: list[_Leaf]) -> Column:
    """The number of the leaf that a row falls into, as nested conditions; fills `leaves`."""
    if node.numDescendants() == 0:
        leaves.append(_Leaf(len(leaves), dict(adds)))
        return F.lit(len(leaves) - 1)
    split, here = node.split(), _tree_value(node, probability)
    f = split.featureIndex()
    sides = []
    for child in (node.leftChild(), node.rightChild()):
        step = _tree_value(child, probability) - here
        sides.append(_walk(child, x, probability, adds | {f: adds.get(f, 0.0) + step}, leaves))
    if hasattr(split, "threshold") and "Continuous" in split.getClass().getName():
        left = F.get(x, F.lit(f)) <= F.lit(float(split.threshold()))
    else:
        left = F.get(x, F.lit(f)).isin(*[float(c) for c in split.leftCategories()])
    return F.when(left, sides[0]).otherwise(sides[1])


def contributions(model: CalibratedModel, rows: DataFrame, key: str = "loan_id") -> DataFrame:
    """(key, base, score, parts): what each input adds to the uncalibrated score of a row.

    The score is the margin of boosted trees, the probability of a forest and the log-odds of a linear model; `parts` has one
    number per name of `feature_names`, and base plus parts is the score. In a tree, an input adds the change of the node mean
    at each split on it along the row's path; in a linear model its coefficient times its distance from the mean.
    """
    last, names = model.pipeline.stages[-1], feature_names(model, rows)
    encoded = model.pipeline.transform(rows).select(key, vector_to_array("features").alias("_x"))
    x = F.col("_x")
    if hasattr(last, "coefficients"):
        coef = F.array(*[F.lit(float(b)) for b in last.coefficients.toArray()])
        out = encoded.select(key, F.lit(float(last.intercept)).alias("base"), F.zip_with(x, coef, lambda a, b: a * b).alias("parts"))
    else:
        forest = isinstance(last, RandomForestClassificationModel)
        weights = [1.0 / len(last.trees)] * len(last.trees) if forest else last.treeWeights
        base, leaf_columns, terms = 0.0, {}, {}
        for i, (tree, w) in enumerate(zip(last.trees, weights)):
            root, leaves = tree._call_java("rootNode"), []
            base += w * _tree_value(root, forest)
            leaf_columns[f"_leaf{i}"] = _walk(root, x, forest, {}, leaves)
            for f in {f for leaf in leaves for f in leaf.adds}:
                table = F.array(*[F.lit(w * leaf.adds.get(f, 0.0)) for leaf in leaves])
                terms.setdefault(f, []).append(F.get(table, F.col(f"_leaf{i}")))
        parts = [reduce(Column.__add__, terms[f]) if f in terms else F.lit(0.0) for f in range(len(names))]
        out = encoded.select(key, *[c.alias(n) for n, c in leaf_columns.items()]).select(key, F.lit(base).alias("base"), F.array(*parts).alias("parts"))
    return out.select(key, "base", (F.col("base") + F.aggregate("parts", F.lit(0.0), lambda a, b: a + b)).alias("score"), "parts")


def global_drivers(model: CalibratedModel, rows: DataFrame, top: int = 12) -> DataFrame:
    """Strongest model inputs: |coefficient| of a linear model, mean size of the contribution to a tree model's score."""
    last, names = model.pipeline.stages[-1], feature_names(model, rows)
    if hasattr(last, "coefficients"):
        pairs = [(n, float(v)) for n, v in zip(names, last.coefficients.toArray())]
        out = rows.sparkSession.createDataFrame(pairs, "feature string, value double")
    else:
        parts = contributions(model, rows).select(F.posexplode_outer("parts").alias("slot", "part"))
        total = rows.agg(F.count("*")).scalar()
        sizes = parts.groupBy("slot").agg(F.sum(F.abs("part")).alias("size"))
        out = sizes.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1).alias("feature"), (F.col("size") / total).alias("value"))
    return out.orderBy(F.desc(F.abs("value")), "feature").limit(top)


def reason_codes(model: CalibratedModel, rows: DataFrame, top: int = 6, key: str = "loan_id") -> DataFrame:
    """Per row the largest signed contributions to its score, economy excluded: (key, rank, feature, value)."""
    names = feature_names(model, rows)
    kept = [(i, n) for i, n in enumerate(names) if not n.startswith(("macro_", "state_"))]
    items = F.array(*[F.struct((-F.abs(F.get("parts", F.lit(i)))).alias("o"), F.lit(n).alias("feature"), F.get("parts", F.lit(i)).alias("value")) for i, n in kept])
    best = F.slice(F.array_sort(items), 1, top)
    return (contributions(model, rows, key).select(key, F.posexplode_outer(best).alias("pos", "r"))
            .select(key, (F.col("pos") + 1).alias("rank"), "r.feature", "r.value"))
