"""Splitting texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Bytes of text that become Python strings at a time; a batch of Spark's can hold hundreds of times as many.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold up to SLICE_BYTES of text in the column at this place; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(batch):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def chunks(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces between the first separator that occurs (else characters), packed up to `size`, the next chunk beginning with the last pieces of
    the one before until they reach `overlap`. Lengths are code points. A piece longer than `size` stays whole, and the overlap comes on top."""
    if not text:
        return []
    if len(text) <= size:
        return [text]
    sep = next((s for s in separators if s in text), "")
    pieces = text.split(sep) if sep else list(text)
    out: list[str] = []
    held: list[str] = []
    length = 0
    for number, piece in enumerate(pieces):
        cost = len(piece) + (len(sep) if number < len(pieces) - 1 else 0)
        if held and length + cost > size:
            out.append(sep.join(held))
            tail, length = [], 0
            while held and length < overlap:
                length += len(held[-1]) + len(sep)
                tail.append(held.pop())
            held = tail[::-1]
        held.append(piece)
        length += cost
    out.append(sep.join(held))
    return out


def chunked(df: DataFrame, size: int = 1000, overlap: int = 200, text: str = "text") -> DataFrame:
    """One row per chunk with the columns of df, chunk_id (from 0) and the chunk in place of the text."""
    schema = df.withColumn("chunk_id", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text))):
            at = batch.schema.get_field_index(text)
            parts = [chunks(t or "", size, overlap) for t in batch.column(at).to_pylist()]
            rows = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            columns = [c.take(rows) for c in batch.columns]
            columns[at] = pa.array([c for p in parts for c in p], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k for p in parts for k in range(len(p))], pa.int32())], names=[*batch.schema.names, "chunk_id"])

    return df.mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    """SQL table function split_chunks(text, size, overlap) for LATERAL joins."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_id int, chunk string")
    class SplitChunks:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(chunks(text or "", size, overlap))

    spark.udtf.register("split_chunks", SplitChunks)
