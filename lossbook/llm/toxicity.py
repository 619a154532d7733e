"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score on its distinct words and their
beginnings (a stem takes many endings), and the document is toxic unless every sentence is innocent:
noisy-or, 1 - prod(1 - p). Only documents are labelled; the gradient through the noisy-or lets the most
suspicious sentences of a toxic document carry its label. Document frequencies by class come from all
labelled documents of the training fold; buckets that lean to toxic documents by more than chance enter
the model and start at their log-ratio. The weights are fitted on at most about SAMPLE
labelled documents, chosen by a hash of the id. The scores then point at the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.text import encode_words, held_out, learned, only, slices, split_words, texts_of
from lossbook.session import stage

BITS = 20                        # feature buckets: 2**BITS bounds the model whatever the data
SAMPLE = 10_000                  # labelled documents that the weights are fitted on, about
SENTENCE = r"[.!?]+\s+|\n+"


BEGINNINGS = (3, 4, 5, 6)        # letters of a word's beginnings


@dataclass
class Bags:
    """Sentences of texts: offsets of sentences per text, of distinct words per sentence, the words (numbers
    of rows of `features`: the word's bucket and those of its beginnings), and the sentences."""
    per_doc: np.ndarray
    per_sentence: np.ndarray
    words: np.ndarray
    features: np.ndarray
    sentences: pa.Array


def bags(texts: pa.Array) -> Bags:
    lists = pc.split_pattern_regex(texts, SENTENCE)
    per_doc = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    sentences = lists.flatten()
    ends, flat = split_words(sentences)
    index, distinct = encode_words(flat)
    plain, distinct = encode_words(pc.replace_substring_regex(pc.utf8_lower(distinct), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    h = xxhash.xxh3_64_intdigest
    words = distinct.to_pylist()
    buckets = [[h(w) for w in words]] + [[h(w[:n] + "-") for w in words] for n in BEGINNINGS]
    features = (np.array(buckets, np.uint64).reshape(len(buckets), -1).T >> np.uint64(64 - BITS)).astype(np.int64)
    of = np.repeat(np.arange(len(sentences)), np.diff(ends))
    keys = np.unique(of * max(len(words), 1) + plain[index]) if len(index) else np.zeros(0, np.int64)
    of, word = keys // max(len(words), 1), keys % max(len(words), 1)
    return Bags(per_doc, np.searchsorted(of, np.arange(len(sentences) + 1)), word, features, sentences)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def sentence_scores(self, b: Bags) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(self.weight[b.features].sum(1)[b.words])])
        return 1 / (1 + np.exp(-np.clip(run[b.per_sentence[1:]] - run[b.per_sentence[:-1]] + self.bias, -40, 40)))


def noisy_or(per_doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    """1 - prod(1 - p) over each document's sentences; 0 without sentences."""
    run = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    return np.maximum(-np.expm1(run[per_doc[1:]] - run[per_doc[:-1]]), 0.0)


def train(per_doc: np.ndarray, per_sentence: np.ndarray, buckets: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 150,
          rate: float = 0.1, decay: float = 2e-5) -> Model:
    """Adam on the noisy-or log-loss; buckets with a NaN start stay out of the model."""
    used = np.flatnonzero(~np.isnan(start))
    place = np.full(len(start), -1)
    place[used] = np.arange(len(used))
    n_words = np.diff(per_sentence)
    word = place[buckets]
    sentence = np.repeat(np.arange(len(n_words)), n_words)[word >= 0]
    word = word[word >= 0]
    doc = np.repeat(np.arange(len(y)), np.diff(per_doc))
    w, b = start[used].copy(), -6.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[word], len(n_words)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        whole = np.clip(noisy_or(per_doc, p), 1e-9, 1 - 1e-9)
        g = np.where(y[doc] == 1, -(1 - whole[doc]) / whole[doc] * p, p) / max(len(y), 1)
        gw = np.bincount(word, g[sentence], len(used)) + decay * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weight = np.zeros(len(start))
    weight[used] = w
    return Model(weight, float(b))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE, least: int = 3, surplus: float = 4.0) -> Model:
    """Fit on labelled documents outside the held-out fold. Null labels, ids and unknown ids do not count.

    A bucket enters with `least` documents, and `surplus` standard deviations more toxic ones than chance gives.
    """
    y = only(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & learned(F.col("doc_id"), folds, fold)).dropDuplicates(["doc_id"])
    # labels grow with the documents, so the join is the same at every size
    rows = only(docs, "doc_id", "text").join(y.hint("merge"), "doc_id").select("doc_id", "text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b = bags(texts_of(batch))
            toxic = batch.column("toxic").to_numpy().astype(np.int64)
            doc = np.searchsorted(b.per_doc, np.repeat(np.arange(len(b.sentences)), np.diff(b.per_sentence)), "right") - 1
            keys = np.unique(((doc << BITS)[:, None] | b.features[b.words]).ravel())
            bucket, label = keys & ((1 << BITS) - 1), toxic[keys >> BITS]
            pos, every = np.bincount(bucket[label == 1], minlength=1 << BITS), np.bincount(bucket, minlength=1 << BITS)
            k = np.flatnonzero(every)
            one = pa.array([0], pa.int64()), pa.array([int(toxic.sum())]), pa.array([batch.num_rows])
            yield pa.RecordBatch.from_arrays(list(one), names=["k", "pos", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(k + 1), pa.array(pos[k]), pa.array(every[k])], names=["k", "pos", "n"])

    counts = stage(rows.mapInArrow(count, "k long, pos long, n long").groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")), "counts")
    whole = counts.filter("k = 0").first()
    n_pos, n = (whole.pos, whole.n) if whole else (0, 0)
    if not 0 < n_pos < n:
        return Model(np.zeros(1 << BITS), -6.0)
    share = n_pos / n
    lean = (F.col("pos") - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n")) > surplus
    chosen = counts.filter((F.col("k") > 0) & (F.col("n") >= least) & lean).toPandas()      # the few buckets that lean to toxic documents
    pos, every = chosen.pos.to_numpy(float), chosen.n.to_numpy(float)
    ratio = np.log((pos + 0.5) / (n_pos + 1)) - np.log((every - pos + 0.5) / (n - n_pos + 1))
    start = np.full(1 << BITS, np.nan)
    start[chosen.k.to_numpy(int) - 1] = ratio / (1 + len(BEGINNINGS))
    known = np.flatnonzero(~np.isnan(start))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b = bags(texts_of(batch))
            got = np.isin(b.features, known)
            run = np.concatenate([[0], np.cumsum(got.sum(1)[b.words])])
            inner = pa.ListArray.from_arrays(pa.array(run[b.per_sentence], pa.int32()), pa.array(b.features[b.words][got[b.words]], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()),
                                              pa.ListArray.from_arrays(pa.array(b.per_doc, pa.int32()), inner)], names=["doc_id", "toxic", "bags"])

    part = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(2**30)) < F.lit(int(2**30 * min(1.0, sample / n)))
    got = rows.filter(part).mapInArrow(mark, "doc_id long, toxic int, bags array<array<int>>").orderBy("doc_id").select("toxic", "bags").toArrow()
    if not len(got):
        return Model(np.zeros(1 << BITS), -6.0)
    lists = got.column("bags").combine_chunks()
    ends = lambda a: np.concatenate([[0], np.cumsum(pc.list_value_length(a).to_numpy(zero_copy_only=False))]).astype(np.int64)
    inner = lists.flatten()
    return train(ends(lists), ends(inner), inner.flatten().to_numpy().astype(np.int64), got.column("toxic").to_numpy(), start)


def score(docs: DataFrame, model: Model, folds: int = 4, fold: int = 2, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) for every row.

    `sentences` lists (number, score, text) of the sentences whose own score reaches the cut. A null or
    empty text has one empty sentence and gets the bias's score. A null id is not held out. Repeated rows
    are scored each. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, sentences array<struct<number:int,score:double,text:string>>"
    kind = pa.list_(pa.struct([("number", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b = bags(texts_of(batch))
            p = sent.value.sentence_scores(b)
            bad: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(p >= cut):
                row = int(np.searchsorted(b.per_doc, k, "right")) - 1
                bad[row].append({"number": int(k - b.per_doc[row]), "score": float(p[k]), "text": b.sentences[int(k)].as_py()})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(noisy_or(b.per_doc, p)), pa.array(bad, kind)], names=["doc_id", "score", "sentences"])

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, schema).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                                               (F.col("score") >= cut).cast("int").alias("predicted"), "sentences")
