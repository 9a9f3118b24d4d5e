"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

An item's windows of `window` consecutive words (or all its words, when fewer) are the patterns. Patterns of one length m are
searched together: a shift table over hashed blocks of two words says how far the search may jump when a block ends at the current
word (blocks of no pattern: m - 1 words); a shift of zero selects the test strings whose last block has the same hash, in order of the hash of the
whole window, and comparing the words themselves confirms an occurrence.

The tables are arrays: some 60 bytes for each word of the benchmark. Items are cut into pieces of at most PIECE windows, pieces are dealt into
shards of about SHARD_WORDS words by a hash, and only one shard travels at a time, whatever the size of the benchmark and of its items. Documents are
scanned where they are read; with more than one shard the scans follow one another over a table in the shared folder.

Defined cases: null and empty texts have no words; items without words or without id are never found; items with the same id
count once; repeated documents each give a row; an empty benchmark leaves every document clean, an empty table gives an empty result; texts of any
length are scanned whole; input columns named as the added ones are replaced, all other names stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import ALNUM_TABLE, SEPARATORS, UPPER, column

SHARD_WORDS, PIECE = 1 << 20, 1 << 15
BLOCK, SPREAD = 2, 0x9E3779B1
#: Entries of a shift table for each block of a pattern, at least: the fewer blocks share an entry, the further the search jumps.
ROOM = 8


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


class WuManber:
    """The search tables of patterns of one length, each pattern with the items that hold it."""

    def __init__(self, length: int, pieces: list[tuple[str, list[bytes]]]):
        self.length, self.block = length, min(BLOCK, length)
        self.items = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.items)}
        self.mask = (1 << max(10, (ROOM * sum(len(words) for _, words in pieces)).bit_length())) - 1
        self.shift = bytearray([min(255, length - self.block + 1)]) * (self.mask + 1)
        keys, owner, begin, end, data, size = [], [], [], [], [], 0
        for item, words in pieces:
            codes = [crc32(w) for w in words]
            blocks = [(a * SPREAD + b) & self.mask for a, b in zip(codes, codes[1:], strict=False)] if self.block == BLOCK else [c & self.mask for c in codes]
            upto = np.cumsum([len(w) + 1 for w in words]) + size
            for first in range(len(words) - length + 1):
                for last in range(self.block, length + 1):
                    at, jump = blocks[first + last - self.block], length - last
                    if jump < self.shift[at]:
                        self.shift[at] = jump
                keys.append(self.key(words[first : first + length]))
                owner.append(number[item])
                begin.append(int(upto[first]) - len(words[first]) - 1)
                end.append(int(upto[first + length - 1]) - 1)
            data.append(b" ".join(words) + b" ")
            size += len(data[-1])
        self.data = b"".join(data)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys, self.owner = np.array(keys, np.uint64)[order], np.array(owner, np.int32)[order]
        self.begin, self.end = np.array(begin, np.int64)[order], np.array(end, np.int64)[order]

    def key(self, words: list[bytes]) -> int:
        """The bucket of a test string, by the hash of its last block, and behind it its place there, by the hash of all its words."""
        return crc32(b" ".join(words[-self.block :])) << 32 | crc32(b" ".join(words))

    @property
    def nbytes(self) -> int:
        return len(self.shift) + len(self.data) + sum(x.nbytes for x in (self.keys, self.owner, self.begin, self.end))

    def holders(self, words: list[bytes]) -> list[str]:
        """The items that hold these words, by direct comparison."""
        key = np.uint64(self.key(words))
        a, b = np.searchsorted(self.keys, [key, key], "left")[0], np.searchsorted(self.keys, key, "right")
        if a == b:
            return []
        text = b" ".join(words)
        return [self.items[self.owner[i]] for i in range(a, b) if self.data[self.begin[i] : self.end[i]] == text]

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of every occurrence."""
        m, shift, mask, hash_ = self.length, self.shift, self.mask, crc32
        at, n = m - 1, len(words)
        while at < n:
            jump = shift[((hash_(words[at - 1]) * SPREAD + hash_(words[at])) & mask)] if m > 1 else shift[hash_(words[at]) & mask]
            if jump:
                at += jump
                continue
            if items := self.holders(words[at - m + 1 : at + 1]):
                yield at - m + 1, items
            at += 1


def build(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    """The searches for items (id, text): one for each length that a pattern has, none for lengths without."""
    by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
    for item, text in items:
        if words := words_of(text):
            by_length.setdefault(min(window, len(words)), []).append((item, words))
    return [WuManber(n, pieces) for n, pieces in sorted(by_length.items())]


def pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, text, words): the items in pieces of at most PIECE windows, which together have the windows of the whole."""
    words = F.array_remove(F.split(F.translate("text", UPPER, UPPER.lower()), SEPARATORS), "")
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(PIECE))
    parts = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(PIECE + window - 1)))).alias("w"))
    return parts.select("item", F.array_join("w", " ").alias("text"), F.size("w").alias("words"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 8) -> DataFrame:
    """docs (all columns) with hit_spans, disjoint [first, end) word ranges in order, hit_items, sorted as text, and hit_words."""
    spark = docs.sparkSession
    parts = pieces(benchmark, window)
    total = parts.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_WORDS))
    made = {"hit_spans", "hit_items", "hit_words"}
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]).withColumns({
        "hit_spans": F.lit(None).cast("array<struct<first:int,end:int>>"), "hit_items": F.lit(None).cast("array<string>"), "hit_words": F.lit(0).cast("long"),
    })
    for shard in range(shards):
        mine = parts.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard) if shards > 1 else parts
        tables = spark.sparkContext.broadcast(build(sorted((r.item, r.text) for r in mine.collect()), window))
        out = _pass(out, tables)
        if shard + 1 < shards:
            out = materialize(out)
    return out


def _pass(docs: DataFrame, tables) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = tables.value
        for batch in batches:
            spans_out, items_out, words_out = [], [], []
            for text, spans, found in zip(column(batch, "text"), column(batch, "hit_spans"), column(batch, "hit_items"), strict=True):
                words = words_of(text)
                ranges = [(s["first"], s["end"]) for s in spans or []]
                found = set(found or [])
                for search in searches:
                    if len(words) >= search.length:
                        for first, items in search.occurrences(words):
                            ranges.append((first, first + search.length))
                            found.update(items)
                merged: list[list[int]] = []
                for first, end in sorted(ranges):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([first, end])
                spans_out.append([{"first": a, "end": b} for a, b in merged])
                items_out.append(sorted(found))
                words_out.append(len(words))
            arrays = dict(zip(batch.schema.names, batch.columns, strict=True))
            arrays["hit_spans"] = pa.array(spans_out, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
            arrays["hit_items"] = pa.array(items_out, pa.list_(pa.string()))
            arrays["hit_words"] = pa.array(words_out, pa.int64())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return docs.mapInArrow(run, docs.schema)


def digest(scanned: DataFrame, least_items: int = 2) -> DataFrame:
    """The columns of the contract: n_words, n_hit, n_items, items_sha256, contaminated."""
    return scanned.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"]).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_items") >= least_items).alias("contaminated"),
    )


def reference(text: str | None, items: list[tuple[str, str]], window: int = 8) -> tuple[int, int, int, str]:
    """Brute force for tests: (n_words, n_hit, n_items, items_sha256)."""
    words, hit, found = words_of(text), set(), set()
    for item, other in items:
        for p in windows_of(words_of(other), window):
            for i in range(len(words) - len(p) + 1):
                if tuple(words[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
