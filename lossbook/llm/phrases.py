"""Collocations by vertical partitioning of a word suffix tree.

A suffix is the run of up to `longest` words that starts at a word and ends with its piece. The tree of all suffixes
does not fit into one task, so it is cut by prefixes: suffixes are dealt into groups by the hash of their first word, and
a word that alone is too large for a group's memory budget is extended to two words, and such a pair to three. A
pass that extends a prefix also counts it, as the passes over a text by prefix length do in ERA. Every group then
builds its subtree alone: its distinct suffixes in word order, in which a node is a run that shares its first words; the
count of a node is the total of the leaves in its run.

A phrase as frequent as `least` has only words as frequent as that, so suffixes end before a rarer word. Classes of words
and pairs come from slot tables of fixed size (`slots.py`): a rare word in a slot with a frequent one is kept, an ordinary
prefix in a slot with a large one is extended, and both only cost work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossbook.llm.slots import SLOTS, hashes, places, seed_of, slot_table
from lossbook.llm.text import byte_table, cut, encode_words, mixed, only, slices, texts_of
from lossbook.session import stage

TABLE = byte_table(b" \t", b".,;:!?\n\x0b\x0c\r")
COUNTED = ""                         # stands for all words of a language in the table of words
LARGE, FREQUENT = 2, 1


@dataclass(frozen=True)
class PhrasePlan:
    """Words of the longest phrase, its least count, phrases per language, share (percent) of a longer candidate's
    count that drops a phrase inside it, and suffixes a group may hold."""
    longest: int = 3
    least: int = 10
    first: int = 2_000
    cover: int = 50
    budget: int = 1_000_000


class Slice:
    """Words of one slice of texts of one language, as codes, with their pieces."""

    def __init__(self, lang: str, texts: pa.Array):
        self.lang, self.seed = lang, seed_of(lang)
        _, words, self.piece = cut(texts, TABLE)
        self.codes, self.words = encode_words(words)

    def runs(self, length: int, classes: np.ndarray) -> np.ndarray:
        """(words, length) codes of the words that follow, from each word of a class on; -1 after the piece's end or before a rare word."""
        code = np.where(classes[self.codes] > 0, self.codes, -1)
        out = np.full((len(code), length), -1, np.int64)
        if len(code):
            out[:, 0] = code
        for k in range(1, length):
            same = self.piece[k:] == self.piece[:-k]
            out[:len(code) - k, k] = np.where(same & (out[:len(code) - k, k - 1] >= 0), code[k:], -1)
        return out[out[:, 0] >= 0] if len(code) else out

    def phrase(self, codes: np.ndarray) -> pa.Array:
        """Rows of codes as words joined by blanks; -1 ends a row."""
        lists = [self.words.take(pa.array(np.maximum(codes[:, k], 0))) for k in range(codes.shape[1])]
        size = (codes >= 0).sum(1)
        out = lists[0]
        for k in range(1, codes.shape[1]):
            longer = pc.binary_join_element_wise(out, lists[k], " ")
            out = pc.if_else(pa.array(size > k), longer, out)
        return out


def distinct_rows(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of codes from -1 to width - 1, in order, and their counts."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    key = rows[:, 0]
    for k in range(1, rows.shape[1]):
        if k > 1:                                                    # keeps keys far below 2^63
            key = np.unique(key, return_inverse=True)[1]
        key = key * (width + 1) + rows[:, k] + 1
    _, at, counts = np.unique(key, return_index=True, return_counts=True)
    return rows[at], counts


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in slices(batches, "text"):
        lang, texts = pc.fill_null(batch.column("lang").cast(pa.string()), "und"), texts_of(batch)
        for name in pc.unique(lang).to_pylist():
            yield Slice(name, texts.filter(pc.equal(lang, name)))


def word_counts(documents: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of the words that occur `least` times, and one row (lang, COUNTED, n) per language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _by_language(batches):
            if len(s.codes):
                f = np.append(np.bincount(s.codes, minlength=len(s.words)), len(s.codes))
                yield pa.record_batch({"lang": pa.array([s.lang] * len(f), pa.string()), "phrase": pa.concat_arrays([s.words, pa.array([COUNTED])]),
                                       "f": pa.array(f, pa.int64())})

    counts = documents.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counts.filter((F.col("f") >= least) | (F.col("phrase") == COUNTED))


def pair_counts(documents: DataFrame, classes, least: int) -> DataFrame:
    """(lang, phrase, f) of the pairs of words that occur `least` times and start with a large word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _by_language(batches):
            of = classes.value[places(s.words, s.seed)]
            rows = s.runs(2, of)
            rows, f = distinct_rows(rows[(rows[:, 1] >= 0) & (of[rows[:, 0]] == LARGE)], len(s.words))
            if len(rows):
                yield pa.record_batch({"lang": pa.array([s.lang] * len(f), pa.string()), "phrase": s.phrase(rows), "f": pa.array(f, pa.int64())})

    counts = documents.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counts.filter(F.col("f") >= least)


def pair_places(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first + mixed(second + np.uint64(0x9E3779B97F4A7C15)))


def dealt_suffixes(documents: DataFrame, classes, pairs, groups: int, longest: int) -> DataFrame:
    """(lang, deep, cell, leaves, counts): per slice and group the distinct suffixes of two words and more, one to a line, with
    their counts. `deep` tells that the prefix was extended, so that its pairs are counted already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _by_language(batches):
            h = hashes(s.words, s.seed)
            of = classes.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
            rows = s.runs(longest, of)
            rows, f = distinct_rows(rows[rows[:, 1] >= 0], len(s.words))
            if not len(rows):
                continue
            deep = of[rows[:, 0]] == LARGE
            at = mixed(h[rows[:, 0]])
            two = pair_places(h[rows[:, 0]], h[rows[:, 1]])
            at = np.where(deep, two, at)
            if longest > 2:
                big = deep & (pairs.value[(two & np.uint64(SLOTS - 1)).astype(np.int64)] > 0) & (rows[:, 2] >= 0)
                at = np.where(big, pair_places(two, h[rows[:, 2]]), at)
                useful = ~deep | (rows[:, 2] >= 0)                   # a pair with a large first word is counted already
            else:
                useful = ~deep
            cell = (mixed(at + np.uint64(1)) % np.uint64(groups)).astype(np.int64) * 2 + deep
            order = np.flatnonzero(useful)
            order = order[np.argsort(cell[order], kind="stable")]
            if not len(order):
                continue
            cell = cell[order]
            start = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(start, pa.int32()), s.phrase(rows[order])), "\n")
            counts = pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer((4 * start).astype(np.int32)), pa.py_buffer(f[order].astype("<u4"))])
            found = cell[start[:-1]]
            yield pa.record_batch({"lang": pa.array([s.lang] * len(found), pa.string()), "deep": pa.array(found % 2 == 1), "cell": pa.array(found // 2),
                                   "leaves": lines, "counts": counts})

    return documents.mapInArrow(run, "lang string, deep boolean, cell long, leaves string, counts binary")


def subtree(leaves: pa.Array, counts: np.ndarray, shortest: int, longest: int, least: int) -> tuple[pa.Array, np.ndarray]:
    """Phrases of `shortest` to `longest` words that occur `least` times, and their counts, from the leaves of one group."""
    code, distinct = encode_words(leaves)
    total = np.bincount(code, counts, len(distinct)).astype(np.int64)
    lists = pc.split_pattern(distinct, " ")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words, names = encode_words(lists.flatten())
    row = np.repeat(np.arange(len(distinct)), size)
    place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    tree = np.full((len(distinct), longest), -1, np.int64)
    tree[row, place] = words
    order = np.lexsort(tree.T[::-1])
    tree, total, size = tree[order], total[order], size[order]
    parts, sums = [], []
    new = np.zeros(len(tree), bool)
    new[:1] = True
    for depth in range(1, longest + 1):
        new[1:] |= tree[1:, depth - 1] != tree[:-1, depth - 1]
        if depth < shortest or not len(tree):
            continue
        start = np.flatnonzero(new)
        f = np.add.reduceat(total, start)
        good = (f >= least) & (size[start] >= depth)
        start, f = start[good], f[good]
        flat = names.take(pa.array(tree[start, :depth].ravel()))
        parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1) * depth, pa.int32()), flat), " "))
        sums.append(f)
    if not parts:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    return pa.concat_arrays([p.cast(pa.string()) for p in parts]), np.concatenate(sums)


def phrase_counts(documents: DataFrame, plan: PhrasePlan = PhrasePlan()) -> tuple[DataFrame, DataFrame]:
    """Stage tables (lang, phrase, f) of all phrases of 1 to `longest` words that occur `least` times within pieces,
    and (lang, n) of all words."""
    spark = documents.sparkSession
    docs = only(documents, "lang", "text")
    words = stage(word_counts(docs, plan.least), "words")
    n = words.filter(F.col("phrase") == COUNTED).select("lang", F.col("f").alias("n"))
    words = words.filter((F.col("phrase") != COUNTED) & (F.col("f") >= plan.least))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups, large = max(1, -(-2 * total // plan.budget)), plan.budget // 8
    level = F.when(F.col("f") > large, LARGE).otherwise(FREQUENT)
    classes = slot_table(words.select(F.col("lang").alias("group"), F.col("phrase").alias("word"), level.alias("level")))
    classes = spark.sparkContext.broadcast(classes)
    pairs = stage(pair_counts(docs, classes, plan.least), "pairs")

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = {name: seed_of(name) for name in pc.unique(batch.column("lang")).to_pylist()}
            out = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                a, b = hashes(pa.array(phrase.split(" ")), seeds[lang])
                out.append(int(pair_places(a[None], b[None])[0] & np.uint64(SLOTS - 1)))
            yield pa.record_batch({"slot": pa.array(out, pa.int64())})

    table = np.zeros(SLOTS, np.uint8)
    # pairs above an eighth of a group's budget; the slots are at most SLOTS, and far fewer in practice
    for row in pairs.filter(F.col("f") > large).mapInArrow(two, "slot long").distinct().toLocalIterator():
        table[row.slot] = 1
    suffixes = dealt_suffixes(docs, classes, spark.sparkContext.broadcast(table), groups, plan.longest)

    def build(t: pa.Table) -> pa.Table:
        lines = pc.split_pattern(t.column("leaves").combine_chunks(), "\n").flatten()
        counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), "<u4")
        shortest = 3 if t.column("deep")[0].as_py() else 2
        phrase, f = subtree(lines, counts, shortest, plan.longest, plan.least)
        return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * len(f), pa.string()), "phrase": phrase, "f": pa.array(f, pa.int64())})

    nodes = suffixes.groupBy("lang", "deep", "cell").applyInArrow(build, "lang string, phrase string, f long")
    return stage(words.unionByName(pairs).unionByName(nodes), "phrases"), n


def collocations(documents: DataFrame, plan: PhrasePlan = PhrasePlan()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the first phrases of 2 to `longest` words by the score of
    their worst cut, floor(1000000 a a / (l r)), then by count, then by phrase.

    `documents` is (lang, text, ...). A null or empty text has no words; a null language is `und`, together with a
    language of that name. Repeated rows count each. A phrase inside a longer candidate with at least `cover` percent of its count is
    dropped. Counts may pass 32 bits and products 64: they are decimals of 38 digits. An empty table gives an empty
    result. Other columns are ignored.
    """
    counts, n = phrase_counts(documents, plan)
    split = counts.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))
    candidates = split.filter(F.col("size") > 1)
    joined = lambda low, size: F.array_join(F.slice("words", low, size), " ")                     # noqa: E731
    inner = candidates.filter(F.col("size") > 2).withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    covers = inner.select("lang", joined(F.col("at"), F.col("k")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(covers, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < plan.cover * F.col("f"))).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")                                              # noqa: E731
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).select(
        "lang", "phrase", "a", "l", "r", "k", F.expr("1000000BD").alias("m"),
        whole("a").alias("da"), whole("l").alias("dl"), whole("r").alias("dr")).selectExpr(
        "lang", "phrase", "a", "l", "r", "k", "CAST((m * da * da) div (dl * dr) AS long) AS score")
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("w")).select("lang", "phrase", "a", "w.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return worst.withColumn("rank", place).filter(F.col("rank") <= plan.first).join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
