"""Language by multilingual mixture inference.

Every language is a distribution over letter trigrams (hashed to a fixed number of buckets), counted over
all training documents. A document is a mixture of languages: expectation-maximisation estimates the
proportions that make its trigrams likeliest. The languages that belong to it are chosen by penalised
likelihood: with languages in order of their proportion, the set grows as long as another one raises the
likelihood by more than its penalty. The prediction is the set's largest language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.text import held_out, learned, mixed, only, slices, texts_of

BITS = 16
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every letter trigram; other signs count as one gap between letters."""
    strings = [s.lower() for s in texts.to_pylist()]
    codes = np.frombuffer(" ".join([*strings, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    doc = np.repeat(np.arange(len(strings)), lengths)
    letter = _LETTER[np.minimum(codes, 0xFFFF)]
    far = codes >= 0x10000
    if far.any():
        signs, which = np.unique(codes[far], return_inverse=True)
        letter[far] = np.array([chr(c).isalpha() for c in signs])[which]
    codes = np.where(letter, codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, doc = codes[keep].astype(np.uint64), doc[keep]
    padded = np.concatenate([np.zeros(1, np.uint64), codes])           # a gap before the first letter
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    whole = (b != 0) & (doc[:-1] == doc[1:])
    key = (a[whole] << np.uint64(42)) | (b[whole] << np.uint64(21)) | c[whole]
    return doc[1:][whole], (mixed(key + np.uint64(7)) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """Languages and the probability of each bucket in each (buckets x languages)."""
    langs: list[str]
    prob: np.ndarray


def fit(docs: DataFrame, folds: int = 5, fold: int = 0, smooth: float = 0.5) -> Model:
    """Trigram counts by language over all training documents that have a language. Null ids do not count.

    The model has 2**BITS rows and a column per language, whatever the data.
    """
    rows = only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned(F.col("doc_id"), folds, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            coded = batch.column("lang").dictionary_encode()
            lang = coded.indices.to_numpy().astype(np.int64)
            doc, bucket = trigrams(texts_of(batch))
            key, n = np.unique((lang[doc] << BITS) | bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key >> BITS)), pa.array(key & ((1 << BITS) - 1)), pa.array(n)],
                                             names=["lang", "bucket", "n"])

    got = rows.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got.lang.unique(), key=lambda s: s.encode())
    prob = np.full((1 << BITS, len(langs)), smooth)
    at = got.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    np.add.at(prob, (got.bucket.to_numpy(int), at), got.n.to_numpy(float))
    return Model(langs, prob / prob.sum(0))


def _em(prob: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of all documents; languages with share 0 stay out."""
    total = np.add.reduceat(n, starts)
    for k in range(rounds + 1):
        part = np.repeat(share, sizes, 0) * prob
        whole = part.sum(1)
        if k == rounds:
            break
        share = np.add.reduceat(part * (n / whole)[:, None], starts) / total[:, None]
    return share, np.add.reduceat(n * np.log(whole), starts)


def infer(texts: pa.Array, model: Model, penalty: float = 3.0, rounds: int = 12) -> np.ndarray:
    """(texts, languages) proportions of the chosen languages; zeros where a text has no letters.

    `penalty` times the logarithm of the number of trigrams is what another language has to gain.
    """
    out = np.zeros((len(texts), len(model.langs)))
    doc, bucket = trigrams(texts)
    if not len(doc) or not model.langs:
        return out
    key, n = np.unique((doc << BITS) | bucket, return_counts=True)
    doc, n = key >> BITS, n.astype(float)
    prob = model.prob[key & ((1 << BITS) - 1)]
    docs, starts, sizes = np.unique(doc, return_index=True, return_counts=True)
    uniform = np.full((len(docs), len(model.langs)), 1 / len(model.langs))
    share, _ = _em(prob, n, starts, sizes, uniform, rounds)
    rank = np.argsort(np.argsort(-share, 1, kind="stable"), 1)
    cost = penalty * np.log(np.add.reduceat(n, starts) + 1)
    best, value, growing = None, None, np.ones(len(docs), bool)
    for k in range(1, len(model.langs) + 1):
        inside = np.where(rank < k, np.maximum(share, 1e-6), 0.0)
        inside, like = _em(prob, n, starts, sizes, inside / inside.sum(1, keepdims=True), 0 if k == 1 else rounds)
        like = like - cost * (k - 1)
        if best is None:
            best, value = inside, like
        else:
            growing &= like > value
            best[growing], value[growing] = inside[growing], like[growing]
        if not growing.any():
            break
    out[docs] = best
    return out


def predict(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) for every row.

    `score` is the share of the predicted language, `languages` all chosen ones with their shares. A null
    text or one without letters gives `und`, 0 and no languages; so does a model without languages. Ties go
    to the first language. A null id is not held out. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text", 4_000_000):
            share = infer(texts_of(batch), m)
            top = share.max(1) if len(m.langs) else np.zeros(batch.num_rows)
            first = share.argmax(1) if len(m.langs) else np.zeros(batch.num_rows, int)
            pred = [m.langs[k] if s > 0 else "und" for k, s in zip(first, top)]
            found = [[{"lang": m.langs[k], "share": float(row[k])} for k in np.flatnonzero(row)] for row in share]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred), pa.array(np.minimum(top, 1.0)), pa.array(found, kind)],
                                             names=["doc_id", "lang_pred", "score", "languages"])

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>").select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score", "languages")
