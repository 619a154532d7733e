"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters and digits. Documents and benchmark items meet through the
seeds (runs of `tile` tokens) they share. For every such pair the longest common runs that do not
overlap earlier ones are marked, again and again, until none of at least `tile` tokens is left; runs of
a given length are found by rolling hashes and checked token by token. The share of the item's tokens
under tiles is its coverage, so passages whose parts come in another order are found as well. An item shorter than a tile is
found where a document holds it whole.

The benchmark is a stated query set. It goes to the tasks in blocks of bounded size; documents are
read where they lie and never shuffled, so neither long texts nor shared passages make a hot task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossbook.llm.text import encode_words, hash_words, mixed, only, slices, texts_of, unused
from lossbook.session import stage

BLOCK_BYTES = 16_000_000         # benchmark text in one broadcast
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
OUT = "doc_id long, item_id long, item_tokens int, covered int, tiles int, coverage double, spans array<struct<doc_start:int,item_start:int,length:int>>"


@dataclass(frozen=True)
class TilePlan:
    """Fewest tokens of a tile, the coverage of an item from which a document is contaminated, and fewest tokens of an item."""
    tile: int = 4
    coverage: float = 0.5
    shortest: int = 1


UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text and flat tokens: runs of letters and digits, single letters in scripts without blanks."""
    texts = pc.utf8_lower(texts)
    if len(texts) and not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.replace_substring_regex(texts, UNSPACED, r" \1 ")
    lists = pc.split_pattern_regex(texts, r"[^\p{L}\p{N}]+")
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    keep = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return before[ends], flat.filter(keep)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids: each follows from the one before by dropping and adding an id."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        down = np.cumprod(np.full(len(ids), BACK))
        up = np.cumprod(np.full(len(ids), STEP))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * down)])
        return (prefix[n:] - prefix[:-n]) * up[:len(prefix) - n]


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id sequences: (doc start, item start, length), longest first.

    Equal lengths go by doc start, then item start.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def runs(free: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(total[n:] - total[:-n] == n) if len(free) >= n else np.zeros(0, np.int64)

    n = min(len(doc), len(item))
    low = least
    # the longest common run halves the search: lengths with no common hash are skipped
    while n >= low:
        hi = n
        lo = low
        best = 0
        while lo <= hi:
            mid = (lo + hi) // 2
            if len(np.intersect1d(rolling(doc, mid)[runs(free_d, mid)], rolling(item, mid)[runs(free_i, mid)])):
                best, lo = mid, mid + 1
            else:
                hi = mid - 1
        if not best:
            break
        n = best
        at = defaultdict(list)
        hashed = rolling(item, n)
        for i in runs(free_i, n):
            at[int(hashed[i])].append(int(i))
        hashed = rolling(doc, n)
        starts = runs(free_d, n)
        starts = starts[np.isin(hashed[starts], np.fromiter(at, np.uint64, len(at)))]
        found = False
        for d in starts:
            if not free_d[d:d + n].all():
                continue
            for i in at[int(hashed[d])]:
                if free_i[i:i + n].all() and np.array_equal(doc[d:d + n], item[i:i + n]):
                    free_d[d:d + n] = free_i[i:i + n] = False
                    out.append((int(d), i, n))
                    found = True
                    break
        if not found:
            n -= 1
    return out


class _Block:
    """Seeds and tokens of one block of items, as sent to the tasks."""

    def __init__(self, items: list[tuple[int, str]], plan: TilePlan):
        ends, flat = tokens_of(pa.array([t for _, t in items], pa.string()))
        index, self.words = encode_words(flat)
        self.ids = [i for i, _ in items]
        with np.errstate(over="ignore"):
            self.coded = mixed(hash_words(self.words)) | np.uint64(1)
            self.tokens = [self.coded[index[s:e]] if e > s else np.zeros(0, np.uint64) for s, e in zip(ends[:-1], ends[1:])]
        seeds, owner, at = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}          # tokens -> hash of all tokens -> items
        for k, t in enumerate(self.tokens):
            if max(plan.shortest, 1) <= len(t) < plan.tile:
                self.short.setdefault(len(t), {}).setdefault(int(rolling(t, len(t))[0]), []).append(k)
            h = rolling(t, plan.tile)
            seeds.append(h)
            owner.append(np.full(len(h), k))
            at.append(np.arange(len(h)))
        seeds, owner, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, owner, at))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.at, self.plan = seeds[order].astype(np.uint64), owner[order], at[order], plan

    def match(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, flat = tokens_of(texts_of(batch))
        code = pc.index_in(flat, value_set=self.words)
        known = pc.fill_null(code, -1).to_numpy(zero_copy_only=False)
        ids = np.where(known >= 0, self.coded[known], np.uint64(0)) if len(self.coded) else np.zeros(len(known), np.uint64)
        doc_ids, rows = batch.column("doc_id").to_pylist(), []
        n = self.plan.tile
        hit = np.zeros(len(ids), bool)
        if len(ids) >= n and len(self.seeds):
            run = np.concatenate([[0], np.cumsum(ids != 0)])
            starts = np.flatnonzero(run[n:] - run[:-n] == n)
            hashed = rolling(ids, n)[starts]
            hit[starts[np.isin(hashed, self.seeds)]] = True
        where = np.flatnonzero(hit)
        for row in np.unique(np.searchsorted(ends, where, side="right") - 1):
            start, end = ends[row], ends[row + 1]
            mine = where[(where >= start) & (where + n <= end)]
            if not len(mine):
                continue
            hashed = np.unique(rolling(ids[start:end], n)[mine - start])
            left, right = np.searchsorted(self.seeds, hashed, "left"), np.searchsorted(self.seeds, hashed, "right")
            spots = np.concatenate([np.arange(a, b) for a, b in zip(left, right)])
            for k in np.unique(self.owner[spots]):
                item = self.tokens[k]
                under = np.zeros(len(item) + 1, np.int64)      # tokens under any shared seed: no tiling covers more
                for a in self.at[spots[self.owner[spots] == k]]:
                    under[a:a + n] = 1
                if under.sum() < self.plan.coverage * len(item):
                    continue
                found = tiles(ids[start:end], item, n)
                covered = sum(x[2] for x in found)
                if covered >= self.plan.coverage * len(item):
                    rows.append((doc_ids[row], self.ids[k], len(item), covered, len(found), covered / len(item),
                                 [dict(zip(("doc_start", "item_start", "length"), x)) for x in found]))
        rows += self._whole(ids, ends, doc_ids)
        kinds = [batch.column("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(),
                 pa.list_(pa.struct([(c, pa.int32()) for c in ("doc_start", "item_start", "length")]))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)],
                                          names=["doc_id", "item_id", "item_tokens", "covered", "tiles", "coverage", "spans"])

    def _whole(self, ids: np.ndarray, ends: np.ndarray, doc_ids: list) -> list[tuple]:
        """Rows for items shorter than a tile that a document holds as one run."""
        out = []
        for n, items in self.short.items():
            if len(ids) < n:
                continue
            known = np.fromiter(items, np.uint64, len(items))
            hashed = rolling(ids, n)
            spots = np.flatnonzero(np.isin(hashed, known))
            row = np.searchsorted(ends, spots, side="right") - 1
            inside = spots + n <= ends[row + 1]
            first: dict[tuple[int, int], int] = {}
            for spot, r in zip(spots[inside].tolist(), row[inside].tolist()):
                for k in items[int(hashed[spot])]:
                    if (r, k) not in first and np.array_equal(ids[spot:spot + n], self.tokens[k]):
                        first[r, k] = spot - int(ends[r])
            out += [(doc_ids[r], self.ids[k], n, n, 1, 1.0, [{"doc_start": at, "item_start": 0, "length": n}]) for (r, k), at in sorted(first.items())]
        return out


def blocks_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, block): items in blocks of about BLOCK_BYTES of text (at most one item more), as a stage table.

    Running sums of the text's bytes go through all partitions, so the number of blocks, and of passes over
    the documents, follows from the benchmark's size and not from how many files it lies in.
    """
    items = only(benchmark, "item_id", "text").filter("text is not null")
    sized = stage(items.withColumn("part", F.spark_partition_id()).withColumn("n", F.octet_length("text").cast("long")), "benchmark")
    # one row per partition of the benchmark
    parts = sized.groupBy("part").agg(F.sum("n").alias("n")).select(
        F.col("part").alias("of"), (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = sized.withColumn("own", own).join(parts, F.col("part") == F.col("of"))
    return stage(placed.select("item_id", "text", F.floor((F.col("before") + F.col("own")) / BLOCK_BYTES).alias("block")), "blocks")


def _matched(texts: DataFrame, benchmark: DataFrame, plan: TilePlan, kind: str) -> DataFrame:
    """Matches of all blocks; `texts` is (doc_id, text), with an id of any type that `kind` names.

    With one block the matches are a plan over the documents. With more, each block's matches are written before the next
    block is sent, so the driver and the tasks hold one block at a time.
    """
    spark = texts.sparkSession
    blocks = blocks_of(benchmark)
    keys = [r.block for r in blocks.select("block").distinct().orderBy("block").toLocalIterator()]
    out = None
    for key in keys:
        items = blocks.filter(F.col("block") == key).select("item_id", "text")
        sent = spark.sparkContext.broadcast(_Block([(r.item_id, r.text) for r in items.collect()], plan))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                yield sent.value.match(batch)

        part = texts.mapInArrow(run, OUT.replace("doc_id long", f"doc_id {kind}", 1))
        if len(keys) > 1:
            part = stage(part, "matches")
            sent.destroy()
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], OUT.replace("doc_id long", f"doc_id {kind}", 1))


def contaminated(docs: DataFrame, benchmark: DataFrame, plan: TilePlan = TilePlan()) -> DataFrame:
    """One row (doc_id, item_id, item_tokens, covered, tiles, coverage, spans) for each leaked item of a document.

    Null and empty texts, on either side, match nothing. An item with fewer tokens than a tile counts when a document
    holds all its tokens as one run. Repeated documents and repeated items each give their rows. Other columns are ignored. Without
    documents or items the result is empty.
    """
    return _matched(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), benchmark, plan, "long")


def clean(docs: DataFrame, benchmark: DataFrame, plan: TilePlan = TilePlan(shortest=TilePlan.tile)) -> DataFrame:
    """Rows of `docs`, all columns, that hold no benchmark item.

    Items shorter than a tile do not count here unless the plan says so: their few words stand in many clean documents.
    A text decides for itself: rows without an id, and rows that repeat one, stay or go by their own text; rows of one text
    go together. A null or empty text stays. Columns of any name are kept as they are. Without items all rows stay.
    """
    text = only(docs, "text").filter("text is not null").select(_print("text").alias("doc_id"), "text")
    bad = stage(_matched(text, benchmark, plan, "string").select("doc_id").distinct(), "leaks")
    key = unused("leak", docs.columns)
    return docs.join(bad.withColumnRenamed("doc_id", key), _print("text").eqNullSafe(F.col(key)), "left_anti")


def _print(column: str) -> Column:
    """128 bits of a text."""
    return F.concat_ws("-", F.xxhash64(F.lit(1), column).cast("string"), F.xxhash64(F.lit(2), column).cast("string"))
