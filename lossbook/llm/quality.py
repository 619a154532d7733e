"""Quality by Naive Bayes support vectors.

A text becomes the set of n-grams (up to three) of its words' shapes: case pattern, marks before and
after, and whether a word repeats the one before. Shapes do not name words, so the model learns how a
text is written and not what it is about. Class log-count ratios come from all labelled documents of
the training fold; they scale the n-gram indicators. On these a linear hinge-loss model is fitted by
dual coordinate descent, over a sample of at most about SAMPLE labelled documents chosen by a hash of
the id, and its margins are turned into probabilities by a logistic curve.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.text import encode_words, held_out, learned, mixed, only, slices, split_words, texts_of
from lossbook.session import stage

BITS = 18                        # n-gram buckets: 2**BITS bounds the model whatever the data
SAMPLE = 20_000                  # labelled documents that the linear model is fitted on, about
_PARTS = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


def shape(word: str) -> str:
    """Case pattern between the marks of a word; runs of one mark count as one to three."""
    before, core, after = _PARTS.match(word).groups()
    if not core:
        kind = ""
    elif core.isdigit():
        kind = "9"
    elif core.islower():
        kind = "a"
    elif core.isupper():
        kind = "A" if len(core) > 1 else "I"
    elif core[0].isupper() and core[1:].islower():
        kind = "Aa"
    else:
        kind = "x9" if any(c.isdigit() for c in core) else "x"
    return f"{before[:3]} {kind} {after[-3:]}"


def features(texts: pa.Array, grams: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text and its sorted distinct n-gram buckets."""
    ends, flat = split_words(texts)
    index, distinct = encode_words(flat)
    h = xxhash.xxh3_64_intdigest
    shapes = np.fromiter((h(shape(w)) for w in distinct.to_pylist()), np.uint64, len(distinct))
    codes = shapes[index] if len(index) else np.zeros(0, np.uint64)
    again = np.zeros(len(codes), bool)
    again[1:] = index[1:] == index[:-1]
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    with np.errstate(over="ignore"):
        codes = mixed(codes + again.astype(np.uint64))
        keys, gram = [], np.zeros(len(codes), np.uint64)
        for n in range(1, grams + 1):
            if len(codes) < n:
                break
            gram = gram[:len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:]
            inside = doc[:len(gram)] == doc[n - 1:]
            keys.append((doc[:len(gram)][inside] << BITS) | (mixed(gram[inside] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return np.searchsorted(keys, np.arange(len(texts) + 1) << BITS), keys & ((1 << BITS) - 1)


@dataclass
class Model:
    """Weight of every n-gram bucket (ratio times linear weight), intercept, and the logistic curve."""
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, ends: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(self.weight[buckets])])
        margin = run[ends[1:]] - run[ends[:-1]] + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def dual_coordinate_descent(ends: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, size: int,
                            cost: float = 1.0, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model; rows are sparse (index, value), y is -1 or 1."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    rows = [(index[s:e], value[s:e]) for s, e in zip(ends[:-1], ends[1:])]
    norm = [float(v @ v) + 1.0 for _, v in rows]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            k, v = rows[i]
            gradient = y[i] * (w[k] @ v + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[k] += step * v
                b += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, b


def logistic_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, with smoothed labels (Newton steps)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -50, 50)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - float(np.clip(step[0], -2, 2)), c - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return (a, c) if a > 0 else (1.0, c)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents outside the held-out fold. Null labels, ids and unknown ids do not count."""
    y = only(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & learned(F.col("doc_id"), folds, fold)).dropDuplicates(["doc_id"])
    # labels grow with the documents, so the join is the same at every size
    rows = only(docs, "doc_id", "text").join(y.hint("merge"), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ends, buckets = features(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(buckets, pa.int32()))], names=["doc_id", "quality", "buckets"])

    marked = stage(rows.mapInArrow(run, "doc_id long, quality int, buckets array<int>"), "marked")
    counts = marked.select("quality", F.explode("buckets").alias("k")).groupBy("k").agg(
        F.sum("quality").alias("pos"), F.sum(1 - F.col("quality")).alias("neg")).toPandas()
    pos, neg = np.ones(1 << BITS), np.ones(1 << BITS)
    pos[counts.k], neg[counts.k] = pos[counts.k] + counts.pos.to_numpy(float), neg[counts.k] + counts.neg.to_numpy(float)
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    n = marked.count()
    share = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(2**30)) < F.lit(int(2**30 * min(1.0, sample / max(n, 1))))
    got = marked.filter(share).orderBy("doc_id").select("quality", "buckets").toArrow()
    lists = got.column("buckets").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int) if len(lists) else np.zeros(1, int)
    index = lists.flatten().to_numpy().astype(int) if len(lists) else np.zeros(0, int)
    sign = np.where(got.column("quality").to_numpy() == 1, 1.0, -1.0)
    w, b = dual_coordinate_descent(ends, index, ratio[index], sign, 1 << BITS)
    model = Model(ratio * w, b, 1.0, 0.0)
    run_ = np.concatenate([[0.0], np.cumsum(model.weight[index])])
    model.slope, model.shift = logistic_curve(run_[ends[1:]] - run_[ends[:-1]] + b, sign)
    return model


def score(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    A null or empty text has no n-grams and gets the intercept's score. Repeated rows are scored each;
    a null id is not held out. Without any labels the score is 0.5. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = sent.value.score(*features(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """Rows of `docs`, with all their columns, whose score reaches the cut."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(sent.value.score(*features(texts_of(batch))) >= cut))

    return docs.mapInArrow(run, docs.schema)
