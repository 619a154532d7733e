"""Ranked lexical search without random access (NRA).

Documents are cut into blocks of a bounded number of postings, items into blocks of a bounded number of terms, and
each pair of blocks is a task. In it every term has a list of its documents, sorted by impact. The lists of an item
are read from the top, all to the same depth. Each document met has a lower bound (the impacts read) and an upper one
(the impacts read, and for each list in which it was not met the impact that the list has come down to). Reading goes
on until no document outside the k best can reach them, and the score of each document that can is final, so ties are
final too. A first wave of blocks gives the other blocks a score that the item's k best documents have at least.

Only terms that occur in items are kept of a document; a slot table of fixed size tells them, so nothing that
grows with the data is sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossbook.llm.slots import places, seed_of, slot_table
from lossbook.llm.text import byte_table, cut, encode_words, only, slices, texts_of
from lossbook.session import stage

TABLE = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))      # words are of ASCII letters, digits and all else beyond ASCII
FIRST_READ = 64                                                               # postings of each list in the first read; later reads double


@dataclass(frozen=True)
class SearchPlan:
    """Documents returned for an item; postings of a block of documents; terms of a block of items."""
    k: int = 50
    postings: int = 500_000
    terms: int = 200_000


def packed_terms(frame: DataFrame, key: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, salt, n, terms, counts) of each text with a term: all its terms with repeats counted in n, and its
    distinct terms (of those that the slot table wants) joined by blanks, with their occurrences as 32-bit integers.

    `salt` differs from row to row, also between equal rows.
    """
    seed = seed_of("")
    held = frame.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            ends, words, _ = cut(texts_of(batch), TABLE)
            codes, distinct = encode_words(words)
            n = np.diff(ends)
            row = np.repeat(np.arange(len(n)), n)
            if held is not None:
                good = held.value[places(distinct, seed)][codes] > 0
                row, codes = row[good], codes[good]
            pairs, counts = np.unique(row * max(len(distinct), 1) + codes, return_counts=True)
            row, codes = np.divmod(pairs, max(len(distinct), 1))
            at = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), distinct.take(pa.array(codes)))
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(counts.astype("<u4"))])
            salts = pa.array(salt + np.arange(len(n)))
            salt += len(n)
            out = pa.record_batch({key: batch.column(key), "salt": salts, "n": pa.array(n, pa.int64()),
                                   "terms": pc.binary_join(lists, " "), "counts": packed})
            yield out.filter(pa.array(n > 0))

    return frame.mapInArrow(run, f"{key} long, salt long, n long, terms string, counts binary")


class Block:
    """Impact-sorted lists of the terms of one block of documents."""

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: pa.Array, counts: pa.Array, documents: int, all_terms: int):
        self.ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        self.unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        tf = np.frombuffer(b"".join(counts.to_pylist()), "<u4").astype(np.int64)
        size = pc.binary_length(counts).to_numpy(zero_copy_only=False) // 4
        lists = pc.split_pattern(terms.filter(pa.array(size > 0)), " ")
        codes, distinct = encode_words(lists.flatten())
        doc = np.repeat(np.arange(len(n)), size)
        m = 50 + 50 * n * documents // all_terms
        gain = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order = np.lexsort((-gain, codes))
        self.doc, self.gain = doc[order], gain[order]
        self.starts = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
        self.code = {t: i for i, t in enumerate(distinct.to_pylist())}

    def best(self, terms: list[str], weights: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best documents with a score of `least` or more, and above 0, best first."""
        known = [(self.code[t], w) for t, w in zip(terms, weights) if w > 0 and t in self.code]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists, w = (np.array(x, np.int64) for x in zip(*known))
        start, end = self.starts[lists], self.starts[lists + 1]
        size = len(self.ids)
        low = np.zeros(size, np.int64)
        read_doc, read_list = [], []
        depth, step = 0, FIRST_READ
        while True:
            take = np.minimum(end - start, depth + step) - np.minimum(end - start, depth)
            which = np.repeat(np.arange(len(lists)), take)
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(start + depth, take)
            read_doc.append(self.doc[at])
            read_list.append(which)
            # sums of impacts stay far below 2^53, so they are exact
            low += np.bincount(self.doc[at], self.gain[at] * w[which], size).astype(np.int64)
            depth, step = depth + step, 2 * step
            more = start + depth < end
            front = np.where(more, self.gain[np.minimum(start + depth, end) - 1] * w, 0)      # what a list has come down to
            rest = int(front.sum())
            met = np.bincount(np.concatenate(read_doc), front[np.concatenate(read_list)], size).astype(np.int64)
            high = low + rest - met
            reach = max(least, 1)
            if size > k:
                reach = max(reach, int(np.partition(low, size - k)[size - k]))
            able = high >= reach                                  # a document never met has the upper bound `rest`
            if not more.any() or (rest < reach and bool((low[able] == high[able]).all())):
                break
        found = np.flatnonzero(low >= reach)
        best = np.lexsort((self.ids[found], self.unnamed[found], -low[found]))[:k]
        return found[best], low[found[best]]


def rank(documents: DataFrame, items: DataFrame, plan: SearchPlan = SearchPlan()) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of the highest score above 0, equal scores by
    ascending id, documents without id last.

    `documents` is (doc_id, text, ...), `items` (item_id, text, ...). A null or empty text has no terms: such a document
    is found by none, such an item finds none. Every row of `documents` is a document, also where ids repeat; rows of
    `items` with one id (or none) are one item with the terms of all of them. Empty tables give an empty result. Other
    columns are ignored.
    """
    spark = documents.sparkSession
    seed_rows = stage(packed_terms(only(items, "item_id", "text"), "item_id").select(
        "item_id", F.explode(F.split("terms", " ")).alias("term")).distinct(), "item_terms")
    wanted = slot_table(seed_rows.select(F.lit("").alias("group"), F.col("term").alias("word"), F.lit(1).alias("level")).distinct())
    docs = stage(packed_terms(only(documents, "doc_id", "text"), "doc_id", wanted), "postings")
    size = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("counts")), F.lit(0))).first()
    total, all_terms, postings = size[0], size[1], size[2] // 4
    frequency = docs.filter(F.col("terms") != "").select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    asked = stage(seed_rows.join(frequency.select("term", weight.alias("w")), "term").groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t")).select("item_id", F.col("t.term").alias("terms"), F.col("t.w").alias("w")), "items")
    terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks, rounds = max(1, -(-postings // plan.postings)), max(1, -(-terms // plan.terms))
    first = math.isqrt(blocks - 1) + 1

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if have.num_rows and want.num_rows:
            have = have.combine_chunks()
            column = {c: have.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "counts")}
            block = Block(column["doc_id"], column["n"].to_numpy(), column["terms"], column["counts"], total, all_terms)
            names = column["doc_id"].to_pylist()
            for item, t, w, least in zip(*(want.column(c).to_pylist() for c in ("item_id", "terms", "w", "least"))):
                at, score = block.best(t, w, plan.k, least)
                out += [(item, names[a], int(s)) for a, s in zip(at, score)]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("item_id", "doc_id", "score"), cols)})

    whole = docs.withColumn("block", F.pmod(F.xxhash64("salt"), F.lit(blocks).cast("long"))).withColumn(
        "round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))))

    def wave(low: int, high: int, items: DataFrame) -> DataFrame:
        right = items.withColumn("round", F.pmod(F.xxhash64("item_id"), F.lit(rounds).cast("long"))).withColumn(
            "block", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))))
        left = whole.filter(F.col("block").between(low, high - 1)).drop("salt")
        near = left.groupBy("block", "round").cogroup(right.groupBy("block", "round")).applyInArrow(run, "item_id long, doc_id long, score long")
        return best_of(near)

    def best_of(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        return rows.withColumn("rank", place).filter(F.col("rank") <= plan.k).select("item_id", "rank", "doc_id", "score")

    early = wave(0, first, asked.withColumn("least", F.lit(0).cast("long")))
    if first == blocks:
        return early
    early = stage(early, "first_wave")
    least = early.filter(F.col("rank") == plan.k).select(F.col("item_id").alias("of"), F.col("score").alias("least"))
    later = asked.join(least, F.col("item_id").eqNullSafe(F.col("of")), "left").select("item_id", "terms", "w", F.coalesce("least", F.lit(0)).alias("least"))
    return best_of(early.drop("rank").unionByName(wave(first, blocks, later).drop("rank")))
