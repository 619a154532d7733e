"""Helpers on Arrow text columns: words, dictionaries of words, row groups of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 8_000_000


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % n


def held_out(doc_id: Column, n: int, r: int = 0) -> Column:
    """Whether the id belongs to the held-out fold; a NULL id does not."""
    return F.coalesce(remainder(doc_id, n) == r, F.lit(False))


def learned(doc_id: Column, n: int, r: int = 0) -> Column:
    """Whether labels of the id may be learned from; those of a NULL id may not."""
    return F.coalesce(remainder(doc_id, n) != r, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `size` bytes of the text column, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        edges = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(start, end - start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column without nulls (null: empty)."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text and the flat words between ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    keep = pc.not_equal(flat, "")            # leading and trailing white space give empty strings
    if pc.all(keep, min_count=0).as_py():
        return ends, flat
    mask = keep.to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(mask)])
    return before[ends], flat.filter(keep)


def byte_table(separators: bytes, breaks: bytes = b"") -> bytes:
    """For `cut`: A-Z are lower-cased, separators end a word, breaks end a word and a piece."""
    out = bytearray(range(256))
    out[65:91] = bytes(range(97, 123))
    for c in separators:
        out[c] = 32
    for c in breaks:
        out[c] = 10
    return bytes(out)


def cut(texts: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of texts without nulls: offsets per text, the flat words, and for each word the number of its piece."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(len(texts) + 1, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    raw = np.frombuffer(memoryview(texts.buffers()[2])[offsets[0]:offsets[-1]].tobytes().translate(table), np.uint8)
    offsets -= offsets[0]
    keep = (raw != 32) & (raw != 10)
    edge = np.ones(len(raw) + 1, bool)                    # whether a word cannot go on across the place before byte i
    edge[1:-1] = ~keep[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(keep & edge[:-1])
    ends_at = np.ones(len(raw), bool)
    ends_at[:-1] = ~keep[1:]
    ends_at[offsets[(offsets > 0)] - 1] = True
    ends = np.flatnonzero(keep & ends_at) + 1
    lengths = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(np.ascontiguousarray(raw[keep])))
    per_text = np.searchsorted(starts, offsets)
    text_of = np.repeat(np.arange(len(texts)), np.diff(per_text))
    return per_text, words, np.searchsorted(np.flatnonzero(raw == 10), starts) + text_of


def encode_words(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of every word in the list of distinct words, and that list."""
    if len(flat) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not among `columns`, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
