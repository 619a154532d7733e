"""A table of one byte for each of 2^21 hash slots: the highest level of the words in a slot.

It has the same 2 MB for any number of words, so it can be sent to every task. A word of a lower level may share
a slot with one of a higher level; users of the table must be right for that too, it only costs them work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, PAGE = 1 << 21, 1 << 13


def seed_of(group: str) -> int:
    """The seed that words of a group (a language, say) are hashed with."""
    return xxhash.xxh64_intdigest(group, seed=42)


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """64-bit hashes of words, the same as Spark's xxhash64(group, word)."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def places(words: pa.Array, seed: int) -> np.ndarray:
    """Slots of words."""
    return (hashes(words, seed) & np.uint64(SLOTS - 1)).astype(np.int64)


def slot_table(words: DataFrame) -> np.ndarray:
    """The table of (group, word, level) rows with levels 1 to 255; 0 is a slot without words."""
    slot = F.xxhash64("group", "word").bitwiseAND(F.lit(SLOTS - 1).cast("long"))
    top = words.select(slot.alias("slot"), F.col("level").cast("int").alias("level")).groupBy("slot").agg(F.max("level").alias("level"))

    def page(t: pa.Table) -> pa.Table:
        at = t.column("slot").to_numpy()
        out = np.zeros(PAGE, np.uint8)
        out[at % PAGE] = t.column("level").to_numpy()
        return pa.table({"page": pa.array([int(at[0]) // PAGE], pa.int64()), "levels": pa.array([out.tobytes()], pa.binary())})

    pages = top.withColumn("page", F.floor(F.col("slot") / PAGE)).groupBy("page").applyInArrow(page, "page long, levels binary")
    table = np.zeros(SLOTS, np.uint8)
    for row in pages.collect():                                  # at most 256 pages of 8 KB
        table[row.page * PAGE:(row.page + 1) * PAGE] = np.frombuffer(row.levels, np.uint8)
    return table
