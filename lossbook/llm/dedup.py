"""Near-duplicate groups by SetSketch registers: band, estimate jointly, verify, connect.

1. Each text becomes its set of distinct word shingles and a sketch. A register holds the
   exponentially spaced, truncated minimum of one exponential hash over the set:
   floor(1 - log_b(min)). Sketches of two sets merge by the larger register, and two registers are
   equal with a probability close to the sets' similarity.
2. Texts with the same set are one class; only classes go on. Groups of exact copies cost one row.
3. Runs of registers are hashed into buckets. First every member of a bucket is compared with the
   bucket's smallest id only, then, where that leaves it apart, with a hub of the bucket's own: a large
   group of near copies gives a pair or two for each member and bucket.
4. What these links leave apart inside a bucket is compared in cells of bounded size; only links leave a cell.
   In every comparison the joint likelihood of the registers, given both set sizes, drops pairs that
   cannot reach the similarity; the others are verified on the full sets of the whole texts.
5. Components of the verified links give the groups.

A link is missed only if all bands differ (0.56^24, below 1e-6, at a similarity of 0.85).
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.components import components
from lossbook.llm.text import encode_words, hash_words, mixed, only, slices, split_words, texts_of, unused
from lossbook.session import stage

BASE, RATE, LAST = 1.001, 20.0, 65534        # spacing of register values, rate of the hashes, largest plain value
SLACK = 12.0                                 # log-likelihood below the best at which a pair is given up
CELL = 1024                                  # members of a bucket's block


@dataclass(frozen=True)
class DedupPlan:
    """Shingle width, similarity in per cent, bands and registers per band."""
    width: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 5

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles.

    Only A-Z are lowered. A text with fewer words than `width` has its whole sequence as the one
    shingle; one without words has none.
    """
    ends, flat = split_words(pc.ascii_lower(texts))
    index, distinct = encode_words(flat)
    words = mixed(hash_words(distinct) + np.uint64(0x9E3779B97F4A7C15))[index] if len(index) else np.zeros(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * step + words[k:k + len(rolled)]
        rolled = mixed(rolled)
        for start, end in zip(ends[:-1], ends[1:]):
            n = end - start
            if n >= width:
                out.append(np.unique(rolled[start:end - width + 1]))
            elif n:
                h = np.uint64(n)
                for w in words[start:end]:
                    h = h * step + w
                out.append(mixed(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _keys(count: int) -> tuple[np.ndarray, np.ndarray]:
    seed = np.random.default_rng(20_240_607)
    return seed.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), seed.integers(0, 2**63, count, dtype=np.uint64)


def sketch(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """(sets, registers) 16-bit register values; an empty set has zeros."""
    mul, flip = _keys(registers)
    low = np.zeros((len(sets), registers), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):                    # blocks that stay in the processor's cache
        block, size = [], 0
        while at < len(full) and (not block or size + len(sets[full[at]]) <= 32_768):
            block.append(full[at])
            size += len(sets[full[at]])
            at += 1
        values = np.concatenate([sets[i] for i in block])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in block])[:-1]])
        for j in range(registers):
            low[block, j] = np.minimum.reduceat((values ^ flip[j]) * mul[j], starts)
    share = (low.astype(np.float64) + 1.0) * 2.0**-64
    least = -np.log1p(-np.minimum(share, 1 - 2.0**-53)) / RATE
    value = np.clip(np.floor(1.0 - np.log(least) / math.log(BASE)), 0, LAST + 1).astype(np.uint16)
    value[[i for i, s in enumerate(sets) if not len(s)]] = 0
    return value


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity j, given set sizes and how many registers of a are larger, smaller, equal."""
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))


def may_link(na, nb, more, less, equal, percent: int) -> np.ndarray:
    """False where no similarity from `percent` on is nearly as likely as the best one."""
    bound = percent / 100
    top = np.minimum(na, nb) / np.maximum(na, nb)
    ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    best = np.full(len(na), -np.inf)
    within = np.full(len(na), -np.inf)
    for step in np.linspace(0, 1, 33):
        value = log_likelihood(step * top, na, nb, more, less, equal)
        best = np.maximum(best, value)
        at = bound + step * np.maximum(top - bound, 0)
        value = log_likelihood(at, na, nb, more, less, equal)
        within = np.maximum(within, value)
    return ok & (within >= np.maximum(best, within) - SLACK)


def _signatures(docs: DataFrame, plan: DedupPlan) -> DataFrame:
    """(doc_id, n_shingles, print, registers, buckets) of every row."""
    schema = "doc_id long, n_shingles long, print binary, registers binary, buckets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch), plan.width)
            regs = sketch(sets, plan.registers)
            bands = np.ascontiguousarray(regs.reshape(len(sets), plan.bands, plan.rows))
            keys = [[xxhash.xxh3_64_intdigest(bands[i, k].tobytes(), seed=k + 1) >> 1 for k in range(plan.bands)] if len(s) else []
                    for i, s in enumerate(sets)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([regs[i].tobytes() if len(s) else None for i, s in enumerate(sets)], pa.binary()),
                pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "registers", "buckets"])

    return only(docs, "doc_id", "text").mapInArrow(run, schema)


def _compare(batch: pa.RecordBatch, percent: int) -> np.ndarray:
    def registers(name: str) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
    a, b = registers("ra"), registers("rb")
    more, less = (a > b).sum(1), (a < b).sum(1)
    na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
    return may_link(na, nb, more, less, a.shape[1] - more - less, percent)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity."""
    regs = classes.select("id", "n_shingles", "registers")
    side = lambda c: regs.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_compare(batch, percent))).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, plan: DedupPlan) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets of the whole texts."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, np.ndarray] = OrderedDict()
        size = 0
        for batch in slices(batches, "ta"):
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            fresh = [t for t in dict.fromkeys(left + right) if t not in known]
            for t, s in zip(fresh, shingle_sets(pa.array(fresh, pa.string()), plan.width)):
                known[t] = s
                size += len(s)
            good = []
            for x, y in zip(left, right):
                sx, sy = known[x], known[y]
                common = len(np.intersect1d(sx, sy, assume_unique=True))
                good.append(100 * common >= plan.percent * (len(sx) + len(sy) - common))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])
            while size > 4_000_000:
                size -= len(known.popitem(last=False)[1])

    return both.mapInArrow(run, "a long, b long")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, band, id, label) of the buckets whose members are not yet all connected, with the
    bucket's smallest id, a hub of its own and its size."""
    labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).select("bucket", "band", "id", "label")
    open_ = labelled.groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("first"), F.count("*").alias("n"),
        F.min_by("id", F.struct(F.xxhash64("bucket", "id"), "id")).alias("hub")).filter("lo < hi and n > 2")
    return labelled.join(open_.drop("lo", "hi"), "bucket")


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """Each member with its bucket's own hub, where their labels differ."""
    hubs = rows.filter("id = hub").select("bucket", F.col("label").alias("hub_label")).distinct()
    return rows.join(hubs, "bucket").filter("id <> hub and label <> hub_label").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _cell_links(rows: DataFrame, classes: DataFrame, texts: DataFrame, plan: DedupPlan) -> DataFrame:
    """Verified links between members of different labels, but for those compared with a hub already.

    A bucket is cut into blocks; a cell is a pair of blocks. Only links leave a cell, and within it
    labels that a link has joined are not compared again, so a large group costs no pairs.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / CELL).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "first", "hub", "band", "label", "id")
    cells = cells.join(classes.select("id", "n_shingles", "registers"), "id").join(texts, "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
        ids, labels, sizes, block = (table.column(c).to_numpy() for c in ("id", "label", "n_shingles", "block"))
        first, hub, band, i, j = (table.column(c)[0].as_py() for c in ("first", "hub", "band", "i", "j"))
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(ids), -1)
        text = table.column("text")
        tested = (ids == first) | (ids == hub)
        root: dict[int, int] = {}

        def top(label: int) -> int:
            while label in root:
                label = root[label]
            return label

        sets: dict[int, np.ndarray] = {}
        a, b, held = [], [], []

        def settle() -> None:
            """Judge the comparisons held back, by their sketches and then on the full sets."""
            if not held:
                return
            x, y, more, equal = (np.concatenate(c) for c in zip(*held))
            held.clear()
            ok = may_link(sizes[x].astype(float), sizes[y].astype(float), more, plan.registers - more - equal, equal, plan.percent)
            x, y, equal = x[ok], y[ok], equal[ok]
            for k in np.argsort(-equal, kind="stable"):
                p, q = int(x[k]), int(y[k])
                lp, lq = top(int(labels[p])), top(int(labels[q]))
                if lp == lq:
                    continue
                fresh = [r for r in (p, q) if r not in sets]
                sets.update(zip(fresh, shingle_sets(pa.array([text[r].as_py() for r in fresh], pa.string()), plan.width)))
                common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * common >= plan.percent * (len(sets[p]) + len(sets[q]) - common):
                    root[max(lp, lq)] = min(lp, lq)
                    a.append(int(ids[p]))
                    b.append(int(ids[q]))

        waiting = 0
        for x in np.flatnonzero(~tested[:-1]):
            y = np.arange(x + 1, len(ids))
            y = y[(labels[y] != labels[x]) & ~tested[y] & (100 * np.minimum(sizes[y], sizes[x]) >= plan.percent * np.maximum(sizes[y], sizes[x]))]
            if i != j:
                y = y[block[y] != block[x]]
            if not len(y):
                continue
            same = regs[y] == regs[x]
            earlier = same[:, :band * plan.rows].reshape(len(y), band, plan.rows).all(2).any(1) if band else np.zeros(len(y), bool)
            y, same = y[~earlier], same[~earlier]       # a pair counts in the first band that it shares
            if len(y):
                held.append((np.full(len(y), x), y, (regs[y] < regs[x]).sum(1), same.sum(1)))
                waiting += len(y)
                if waiting > 200_000:
                    settle()
                    waiting = 0
        settle()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    spread = cells.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j")
    return spread.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, plan: DedupPlan = DedupPlan()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text, ...).

    Null, empty and white-space texts have no shingles, are linked with nothing and stay. Rows that
    repeat an id are one node, with the links of all its texts. A null id has a null component and stays. Other columns are ignored.
    An empty table gives an empty result.
    """
    signed = stage(_signatures(docs, plan), "signatures")
    classes = stage(signed.filter("n_shingles > 0").groupBy("print").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"),
        F.first("buckets").alias("buckets")).filter("id is not null"), "classes")
    spread = classes.select("id", F.posexplode("buckets").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
    members = stage(spread.join(shared, "bucket"), "members")
    # texts of the classes that share a bucket: those of the class's smallest id
    wanted = members.select("id").distinct()
    texts = stage(only(docs, "doc_id", "text").join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
                  .select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "texts")
    check = lambda pairs: stage(_verified(_likely(pairs, classes, plan.percent), texts, plan), "links")
    links = check(members.filter("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    left = stage(_open_buckets(members, components(links)), "open")
    links = stage(links.union(check(_hub_pairs(left))), "links")
    # labels change with every round: buckets whose members are connected by now are done
    merged = components(links)
    left = left.drop("label").join(merged, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    ends = left.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    links = links.union(stage(_cell_links(left.join(ends, "bucket"), classes, texts, plan), "links"))
    final = components(links).withColumnRenamed("id", "class_id")
    by_print = classes.select("print", F.col("id").alias("class_id"))
    return (signed.join(by_print, "print", "left").join(final, "class_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, plan: DedupPlan = DedupPlan()) -> DataFrame:
    """Rows of `docs`, all columns, but one document for each group: that with the smallest id.

    Of rows that repeat an id one stays, any of them. Rows without an id stay as they are. Columns of any name are kept as they are.
    """
    own = unused("kept", docs.columns)
    kept = near_duplicates(docs, plan).filter("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    chosen = docs.join(kept, F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull()))
