"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt by ranges of their id and sorted within. Each partition is a shard: `ids` (one
unsigned integer per token, the narrowest width that holds the vocabulary), `offsets` (int64, where each
document begins, and the end) and `docs` (int64 ids). Shards are written apart, then a prefix sum over
their totals gives each the number of tokens before it. Reading memory-maps the files.

A task writes under a name of its own and renames at the end, so a task that is run again, or twice,
leaves one whole shard. The folder is one that all executors reach; it is opened through pyarrow's
file systems, and memory-mapped where it is a mounted path.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossbook.llm.text import encode_words, only, slices, split_words, texts_of
from lossbook.llm.vocab import gather, word_encoder
from lossbook.session import new_path, stage

ENDING = 2
BYTES_PER_SHARD = 8_000_000
NULL_ID = -2**63


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Reader:
    """One shard's arrays."""

    def __init__(self, folder: str, shard: str, width: int):
        kinds = {"ids": f"<u{width}", "offsets": "<i8", "docs": "<i8"}
        self.ids, self.offsets, self.docs = (self._open(f"{folder}/{shard}.{n}", k) for n, k in kinds.items())

    @staticmethod
    def _open(path: str, kind: str) -> np.ndarray:
        store, name = _place(path)
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
        with store.open_input_stream(name) as f:
            return np.frombuffer(f.read(), kind)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def write(docs: DataFrame, path: str, folder: str, ending: int = ENDING, width: int = 2) -> DataFrame:
    """Write the shards of `docs` (doc_id, text, ...) and return their manifest.

    Manifest: shard, first (its range's place), n_docs, n_tokens, base (tokens of all shards before).
    Null and empty texts have the end id only. Repeated ids follow each other, by text. A null id comes
    first. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // BYTES_PER_SHARD))
    store, name = _place(folder)
    store.create_dir(name, recursive=True)
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        part = TaskContext.get().partitionId()
        shard, store = f"shard-{part:06d}", _place(folder)[0]
        base = _place(folder)[1]
        own = f"{base}/.{shard}-{uuid.uuid4().hex}"
        files = {k: store.open_output_stream(f"{own}.{k}") for k in ("ids", "offsets", "docs")}
        at, n = 0, 0
        for batch in slices(batches, "text", 4_000_000):
            ends, flat = split_words(texts_of(batch))
            index, distinct = encode_words(flat)
            lengths, ids = encoder(distinct)
            index = np.insert(index, ends[1:], len(lengths))        # the end id after each document
            lengths, ids = np.append(lengths, 1), np.append(ids, ending)
            out = gather(lengths, ids, index)
            per_word = np.concatenate([[0], np.cumsum(lengths[index])])
            starts = per_word[ends + np.arange(len(ends))]
            files["ids"].write(out.astype(f"<u{width}").tobytes())
            files["offsets"].write((at + starts[:-1]).astype("<i8").tobytes())
            files["docs"].write(batch.column("doc_id").to_numpy().astype("<i8").tobytes())
            at, n = at + len(out), n + batch.num_rows
        files["offsets"].write(np.array([at], "<i8").tobytes())
        for f in files.values():
            f.close()
        if n:
            for k in files:
                store.move(f"{own}.{k}", f"{base}/{shard}.{k}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "first": pa.array([part], pa.int64()), "n_docs": [n], "n_tokens": [at]})
        else:
            for k in files:
                store.delete_file(f"{own}.{k}")

    shards = stage(dealt.mapInArrow(run, "shard string, first long, n_docs long, n_tokens long"), "shards")
    # one row per shard: a prefix sum over few rows
    before = Window.partitionBy(F.lit(0)).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards of a manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                r = Reader(folder, shard, width)
                sums = [zlib.crc32(r.document(i).astype("<u4").tobytes()) for i in range(len(r.docs))]
                docs = pa.array(r.docs, mask=r.docs == NULL_ID)
                yield pa.RecordBatch.from_arrays([docs, pa.array(base + r.offsets[:-1]), pa.array(np.diff(r.offsets)), pa.array(sums, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("shard", "base")
    return spread.repartition("shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write `docs` to a new shared folder and read the documents back from the files."""
    folder = new_path(docs.sparkSession, "tokens")
    return read(write(docs, path, folder), folder)
