"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source wants the same number of copies, target / source size. The whole part is
given at once; the fractional part is a probability that dependent rounding turns into 0 or 1:

* a pair of documents (pivot and newcomer) moves word mass between them until one probability is
  integral; which of the two possible moves is made is drawn so that expectations stay, and a move keeps
  the pair's expected words (probability times size);
* a bucket of documents is folded this way, the longest first, and leaves one (short) fractional document
  at most;
* what the buckets leave is folded again, level by level, until one document of a source is left, which
  is rounded by a draw of its own. So a source misses its target by less than one document's words.

Buckets come from hashes of ids and hold a bounded number of documents on average, so a hot source is
many buckets. Draws are hashes of ids: reruns and other partitionings give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossbook.llm.text import WORD, only, unused
from lossbook.session import stage

MOST = 3                 # times a source's size that its target may reach
FAN = 128                # documents that meet in a bucket, on average
EPS = 1e-9


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes.
    A target stops at MOST times its size; the excess goes to the others by weight. With sources in
    order of size / weight the stopped ones come first, so running sums say where stopping ends.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    n = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(n, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    all_w = F.sum("w").over(Window.partitionBy(F.lit(0)))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    share = (total - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (all_w - F.coalesce(F.sum("w").over(before), F.lit(0)))
    stopped = F.col("share") * F.col("w") > MOST * F.col("source_size")
    ranked = ranked.withColumn("share", share.cast("double"))
    ranked = ranked.withColumn("stopped", stopped)
    # shares fall from the first source that does not stop; its share is the level of all after it
    level = F.max(F.when(~F.col("stopped"), F.col("share"))).over(Window.partitionBy(F.lit(0)))
    return ranked.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("stopped"), F.col("source_size") * float(MOST)).otherwise(F.col("level") * F.col("w")).alias("target"))


def _draw(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**40)) / F.lit(float(2**40))


def _fold(items: Column) -> Column:
    """Dependent rounding along an array of (key, p, size, u): an array of (key, p), all but one integral.

    The state holds the pivot; every step decides the pivot or the newcomer and keeps the other.
    """
    decided = "array<struct<key:bigint,p:double>>"
    start = F.struct(F.lit(None).cast("bigint").alias("key"), F.lit(0.0).alias("p"), F.lit(0.0).alias("size"),
                     F.array().cast(decided).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        pm, xm = acc["p"] * acc["size"], x["p"] * x["size"]
        # words that can go from newcomer to pivot, and from pivot to newcomer
        up = F.least((1 - acc["p"]) * acc["size"], xm)
        down = F.least(pm, (1 - x["p"]) * x["size"])
        to_pivot = x["u"] * (up + down) < down
        gain = F.when(to_pivot, up).otherwise(-down)
        return F.struct(acc["key"].alias("ak"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), acc["p"] + gain / acc["size"])).alias("ap"), acc["size"].alias("as"),
                        x["key"].alias("xk"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["p"] - gain / x["size"])).alias("xp"), x["size"].alias("xs"),
                        acc["done"].alias("done"))

    def settle(m: Column) -> Column:
        open_a = (m["ap"] > EPS) & (m["ap"] < 1 - EPS)
        keep = lambda k, p, s, dk, dp: F.struct(m[k].alias("key"), m[p].alias("p"), m[s].alias("size"),
                                                F.concat(m["done"], F.array(F.struct(m[dk].alias("key"), m[dp].alias("p")))).alias("done"))
        return F.when(open_a, keep("ak", "ap", "as", "xk", "xp")).otherwise(keep("xk", "xp", "xs", "ak", "ap"))

    def merge(acc: Column, x: Column) -> Column:
        first = F.struct(x["key"].alias("key"), x["p"].alias("p"), x["size"].alias("size"), acc["done"].alias("done"))
        return F.when(acc["key"].isNull(), first).otherwise(
            F.element_at(F.transform(F.array(step(acc, x)), settle), 1))

    return F.aggregate(items, start, merge, lambda acc: F.concat(
        acc["done"], F.when(acc["key"].isNotNull(), F.array(F.struct(acc["key"].alias("key"), acc["p"].alias("p")))).otherwise(F.array().cast(decided))))


def rounded(units: DataFrame, group: str, seed: int) -> DataFrame:
    """(group, key, copy 0 or 1) for units (group, key unique in the group, p in (0, 1), size > 0).

    A reduction tree: each level folds buckets of about FAN units and sends on what is still fractional.
    """
    state, level, settled = units, 0, None
    while True:
        n = state.groupBy(group).agg(F.count("*").alias("n"))
        last = (n.agg(F.max("n")).first()[0] or 0) <= 1
        if last:
            end = state.select(group, "key", (_draw(F.lit(seed), F.lit(-1), "key") < F.col("p")).cast("int").alias("copy"))
            return end if settled is None else settled.union(end)
        buckets = n.withColumn("buckets", F.ceil(F.col("n") / FAN)).drop("n")
        placed = state.join(buckets, state[group].eqNullSafe(buckets[group])).drop(buckets[group]).withColumn(
            "bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key"), F.col("buckets")))
        item = F.struct((-F.col("size")).alias("o"), "key", "p", "size",
                        _draw(F.lit(seed), F.lit(level), F.lit("u"), "key").alias("u"))
        folded = placed.groupBy(group, "bucket").agg(_fold(F.array_sort(F.collect_list(item))).alias("done"), F.collect_list(
            F.struct("key", "size")).alias("sizes"))
        rows = folded.select(group, F.explode(F.arrays_zip(F.array_sort("done").alias("done"), F.array_sort("sizes").alias("sizes"))).alias("z")).select(
            group, F.col("z.done.key").alias("key"), F.col("z.done.p").alias("p"), F.col("z.sizes.size").alias("size"))
        state = stage(rows, "pivotal")
        done = state.filter((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)).select(group, "key", (F.col("p") > 0.5).cast("int").alias("copy"))
        settled = done if settled is None else settled.union(done)
        state, level = state.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS)), level + 1


def _numbered(rows: DataFrame, mark: str, name: str) -> DataFrame:
    """Add `name`, which counts rows of equal doc_id and `mark` from 1.

    Rows are counted within the input partition they lie in, then partitions of a key are prefix-summed, so a key that
    repeats in many partitions is not numbered in one task. Only keys that lie in several partitions have an offset.
    """
    own = {c: unused(c, rows.columns) for c in ("part", "whole", "before", "of", "in", "at")}
    # a null id counts as 0: `mark` tells them apart, and the join has the partitioning of the window
    placed = rows.withColumn(own["part"], F.spark_partition_id()).withColumn(own["whole"], F.coalesce("doc_id", F.lit(0)).cast("long"))
    keys = [own["whole"], mark, own["part"]]
    order = Window.partitionBy(own["whole"], mark).orderBy(own["part"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.sum("n").over(order).alias(own["before"])).filter(
        F.col(own["before"]).isNotNull()).withColumnsRenamed(dict(zip(keys, (own["of"], own["in"], own["at"]))))
    local = placed.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    same = (F.col(own["whole"]) == F.col(own["of"])) & (F.col(mark) == F.col(own["in"])) & (F.col(own["part"]) == F.col(own["at"]))
    return local.join(offsets, same, "left").select(*[F.col(f"`{c}`") for c in rows.columns],
                                                    (F.col(name) + F.coalesce(F.col(own["before"]), F.lit(0))).alias(name))


def _mixed(docs: DataFrame, seed: int, weights: tuple[int, ...]) -> DataFrame:
    """mix() with what tells repeated rows apart: print, number."""
    base = stage(only(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                                              F.xxhash64("doc_id", "source", "text").alias("print")), "sizes")
    targets = stage(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    numbered = _numbered(base, "print", "number").withColumn("key", F.xxhash64("doc_id", "print", "number"))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    rows = numbered.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "t.source_size", "t.target", rate.alias("rate"))
    rows = stage(rows.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))), "rates")
    units = rows.filter((F.col("size") > 0) & (F.col("p") > EPS)).select("source", "key", "p", F.col("size").cast("double").alias("size"))
    picked = rounded(units, "source", seed).select("key", "copy")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + F.coalesce("copy", F.lit(0))).cast("long")
    return rows.join(picked, "key", "left").withColumn("copies", copies)


def mix(docs: DataFrame, seed: int = 20, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of `docs`.

    Null and empty texts have size 0 and get one copy, worth no words. A null source is a source.
    Rows that repeat an id and a text are told apart by their number, so each gets its own copies.
    A source without words has target 0. Other columns are ignored. An empty table gives an empty result.
    """
    return _mixed(docs, seed, weights).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 20, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rows of `docs`, all columns, each as often as the mix takes it (not at all, or up to MOST times).

    Nulls, empty texts, repeated rows and the empty table are as in `mix`. Rows equal in id, source and text are interchangeable:
    which of them is taken more often is not stated. Columns of any name are kept as they are.
    """
    own = {c: unused(c, docs.columns) for c in ("print", "number", "id", "same", "nth", "times", "time")}
    taken = _mixed(docs, seed, weights).select(F.col("doc_id").alias(own["id"]), F.col("print").alias(own["same"]),
                                               F.col("number").alias(own["nth"]), F.col("copies").cast("int").alias(own["times"]))
    marked = docs.withColumn(own["print"], F.xxhash64("doc_id", "source", "text"))
    rows = _numbered(marked, own["print"], own["number"])
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col(own["id"])) & (F.col(own["print"]) == F.col(own["same"]))
                       & (F.col(own["number"]) == F.col(own["nth"])))
    return joined.withColumn(own["time"], F.explode(F.array_repeat(F.lit(0), F.col(own["times"])))).select(*[F.col(f"`{c}`") for c in docs.columns])
