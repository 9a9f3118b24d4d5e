"""Blocks of documents and messages between them: the frame of the operators that compare passages across a whole corpus.

Documents are dealt into blocks of about BLOCK_BYTES of text by a hash of id and text, so copies of a text with different ids part. A block
sends packed arrays to buckets of keys and gets answers back, aligned with what it sent; texts never travel again: every use of
the blocks is the same exchange of the plan, which Spark makes once. A block orders its rows by id and text, so what it sends does not depend
on the order of arrival, and a task that is run again sends the same.

A message is a row: bucket, block, kind and up to three columns of plain bytes, cut out of one array for all messages of a block without a step of
Python for each. Only buckets that a block has keys for get a message, so there are never more messages than keys: as a corpus grows, a row holds
fewer keys, down to one, and the cost stays in proportion to the keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 24 << 20
LAST_ID = np.iinfo(np.int64).max  # stands for a null id, and ties with a real id of that value
ZSTD = zstandard.ZstdCompressor(level=3)
MESSAGE = "bucket long, block long, kind int, a binary, b binary, c binary"


def counts(docs: DataFrame) -> tuple[int, int]:
    """How many blocks and buckets: by bytes of text, and never fewer than spark.sql.shuffle.partitions. Buckets are larger, which keeps messages few."""
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // BLOCK_BYTES)), max(least, -(-total // BUCKET_BYTES))


def blocked(docs: DataFrame, names: list[str], blocks: int) -> GroupedData:
    """doc_id, text and the columns of these names, as in_0, in_1 and so on, grouped by block. Numbers in place of names keep clashes out."""
    inputs = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)]
    return docs.select(*inputs, "doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block_")).groupBy(F.col("block_").alias("block"))


def rows_of(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """The rows of a block in order, their ids and their texts as bytes."""
    ids = table["doc_id"].to_pylist()
    texts = [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return table.take(order), np.array([LAST_ID if ids[i] is None else ids[i] for i in order], np.int64), [texts[i] for i in order]


def cut(values: np.ndarray | bytes, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of an array, up to the ends (counted in its elements), as binary values that share its memory."""
    data, width = (values, 1) if isinstance(values, bytes) else (np.ascontiguousarray(values), values.dtype.itemsize)
    offsets = np.concatenate([[0], np.asarray(ends, np.int64) * width])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def narrow(values: np.ndarray) -> np.ndarray:
    """The values as the narrowest unsigned type that holds them all."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def _byte_places(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the lowest byte of each step, distance to its next byte) in messages of these sizes."""
    begin = np.cumsum(sizes) - sizes
    return np.repeat(begin * (width - 1), sizes) + np.arange(sizes.sum()), np.repeat(sizes, sizes)


def cut_steps(steps: np.ndarray, ends: np.ndarray) -> tuple[int, pa.Array]:
    """(bytes of a step, steps as binary values up to the ends): the lowest bytes of all steps of a message, then the next ones. Few steps need the highest byte, so that it compresses to next to nothing."""
    steps = steps.astype(np.uint64)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    at, apart = _byte_places(np.diff(ends, prepend=0), width)
    out = np.empty(len(steps) * width, np.uint8)
    for k in range(width):
        out[at + k * apart] = (steps >> np.uint64(8 * k)).astype(np.uint8)
    return width, cut(out, np.asarray(ends) * width)


def joined_steps(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the steps of all messages, how many each message has) from such a column."""
    data, sizes = joined(column, np.dtype(np.uint8))
    sizes = sizes // width
    at, apart = _byte_places(sizes, width)
    steps = np.zeros(len(at), np.uint64)
    for k in range(width):
        steps |= data[at + k * apart].astype(np.uint64) << np.uint64(8 * k)
    return steps, sizes


def squeezed(data: bytes) -> bytes:
    """data as a zstandard frame if that is shorter, else as it is."""
    frame = ZSTD.compress(data)
    return frame if len(frame) < len(data) else data


def opened(data: bytes, size: int) -> bytes:
    """What was squeezed, of this size."""
    return data if len(data) == size else zstandard.decompress(data, max_output_size=size)


def cut_counts(counts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts, most of them small, as two columns: a byte for each, and those from 255 on in full."""
    large = counts >= 255
    return cut(np.minimum(counts, 255).astype(np.uint8), ends), cut(counts[large].astype(np.int64), np.append(0, np.cumsum(large))[ends])


def joined_counts(small: pa.ChunkedArray, large: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of all messages, how many each message has) from the two columns."""
    bytes_, sizes = joined(small, np.dtype(np.uint8))
    counts = bytes_.astype(np.int64)
    counts[bytes_ == 255] = joined(large, np.dtype(np.int64))[0]
    return counts, sizes


def messages(bucket, block, kind: int = 0, a: pa.Array | None = None, b: pa.Array | None = None, c: pa.Array | None = None) -> pa.Table:
    """Messages as a table; bucket or block may be one number for all, columns that are not given are null."""
    n = len(bucket) if isinstance(bucket, np.ndarray) else len(block) if isinstance(block, np.ndarray) else 1
    whole = lambda x, t: pa.array(x if isinstance(x, np.ndarray) else np.full(n, x), t)
    empty = pa.nulls(n, pa.binary())
    return pa.table({"bucket": whole(bucket, pa.int64()), "block": whole(block, pa.int64()), "kind": whole(kind, pa.int32()), **{k: empty if x is None else x for k, x in (("a", a), ("b", b), ("c", c))}})


def no_messages() -> pa.Table:
    return messages(np.zeros(0, np.int64), 0)


def joined(column: pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(the elements of all values of a binary column, how many each value has)."""
    parts = [c.cast(pa.large_binary()) for c in column.chunks if len(c)]
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    bounds = [np.frombuffer(p.buffers()[1], np.int64, len(p) + 1, p.offset * 8) for p in parts]
    data = [np.frombuffer(p.buffers()[2], np.uint8)[o[0] : o[-1]] if p.buffers()[2] else np.zeros(0, np.uint8) for p, o in zip(parts, bounds, strict=True)]
    return np.concatenate(data).view(dtype), np.concatenate([np.diff(o) for o in bounds]) // np.dtype(dtype).itemsize


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranges of keys of that many bits; ascending keys have ascending buckets."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, end) of each run of equal numbers."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append(np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, len(sorted_values))
    return sorted_values[ends - 1].astype(np.int64), ends


def first_of(bucket: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The least key that can lie in each bucket."""
    return (-(-bucket.astype(object) * (1 << 32) // buckets)).astype(np.uint64) << np.uint64(bits - 32)


def packed_keys(keys: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending keys as (bucket, end, steps): the steps from key to key inside a bucket, the first one from the bucket's begin."""
    bucket, ends = runs(bucket_of(keys, bits, buckets))
    steps = np.diff(keys, prepend=np.uint64(0))
    if len(ends):
        first = np.append(0, ends[:-1])
        steps[first] = keys[first] - first_of(bucket, bits, buckets)
    return bucket, ends, narrow(steps)


def unpacked_keys(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The keys of messages of one bucket, counted from its begin; sizes: keys of each message, none of them empty."""
    keys = np.cumsum(steps, dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    return keys - np.repeat(keys[first] - steps[first].astype(np.uint64), sizes)
