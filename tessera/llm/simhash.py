"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are made where the documents are read. Distinct fingerprints are then linked at up to `distance` differing bits:
two such fingerprints agree in at least one of distance + 1 blocks of bits, so each fingerprint goes once to every block's
partition, keyed by the block's value (an exact rule, no cap). A partition rotates its fingerprints so that the block leads,
sorts them by Gray rank (neighbours in that order differ in few bits) and folds runs of them into nodes level by level: a node keeps the
bits all its members share, as (mask, pattern), with the bits already stated by its parent left out. A search walks down from the top
and adds up the differences on the stated bits; a node whose sum exceeds the distance is dropped with all it holds.

A block value that many fingerprints share is split: its fingerprints are within the distance in the remaining bits, so those are cut into blocks again,
and so on. No group grows past HOT but by bits that LEVELS rounds of splitting leave, and partitions are sized by the number of fingerprints.

Inside a partition the links are reduced at once to (fingerprint, smallest fingerprint reached), so what leaves it is at most one
row per fingerprint and block however dense a group of copies is. Components are then found among linked fingerprints by
repeated minimum exchange in tables in the shared folder.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle of them all; equal texts share a fingerprint; repeated rows each give a row; a null doc_id never becomes a component id
unless all ids of the component are null; texts of any length are read whole, in slices that bound memory; an empty table gives an empty result; input
columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import column, sized_partitions

BITS = 64
SEED = 42
FANOUT = 16
CHUNK = 4096
#: Pairs of query and node whose members are looked at together.
NODES = 1 << 16
#: Fingerprints of a block value from which it is split, how often, and fingerprints in a partition.
HOT, LEVELS, PART_ROWS = 1 << 15, 3, 1 << 17
ONE = np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of every shingle in order; no words: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; without any: zero."""
    n = len(h)
    if not n:
        return 0
    # as bytes of unpacked bits, in slices that bound the memory of a very long text
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `fp`, a long that holds the 64 bits."""
    source = docs.select(*keep, "text")
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, shingle) for x in column(batch, "text")], np.uint64).view(np.int64)
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(fp, pa.int64())], names=[*keep, "fp"])

    return source.mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: the prefix XOR of its bits."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Levels of (mask, pattern) nodes over fingerprints in Gray order; level 0 holds the fingerprints themselves."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.codes, self.fanout = codes[np.argsort(gray_rank(codes), kind="stable")], fanout
        ones, zeros = self.codes, ~self.codes  # bits that are one, or zero, in all members
        shared = [ones | zeros]
        patterns = [self.codes]
        while len(patterns[-1]) > fanout:
            at = np.arange(0, len(ones), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            shared.append(ones | zeros)
            patterns.append(ones)
        # what a node states itself: its shared bits without those that its parent states
        own = [m & ~np.repeat(up, fanout)[: len(m)] for m, up in zip(shared, shared[1:], strict=False)] + [shared[-1]]
        self.levels = list(zip(own, patterns, strict=True))[::-1]

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, code index) of all pairs at up to `distance` bits."""
        top = len(self.levels[0][1])
        q = np.repeat(np.arange(len(queries)), top)
        open_ = [(0, q, np.tile(np.arange(top), len(queries)), np.zeros(len(q), np.uint8))]
        found = []
        while open_:
            # one part at a time down to the fingerprints: what is held does not grow with the levels
            depth, q, node, seen = open_.pop()
            mask, pattern = self.levels[depth]
            if depth:
                width = np.minimum(self.fanout, len(pattern) - node * self.fanout)
                first = np.repeat(node * self.fanout, width)
                step = np.arange(len(first)) - np.repeat(np.cumsum(width) - width, width)
                q, seen, node = np.repeat(q, width), np.repeat(seen, width), first + step
            seen = seen + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            kept = seen <= distance
            q, node, seen = q[kept], node[kept], seen[kept]
            if depth + 1 == len(self.levels):
                found.append((q, node))
            else:
                open_ += [(depth + 1, q[at : at + NODES], node[at : at + NODES], seen[at : at + NODES]) for at in range(0, len(q), NODES)]
        return tuple(np.concatenate([np.empty(0, np.int64), *(x[i] for x in found)]) for i in range(2))


def least_reached(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """root (one per node, root[i] <= i) after joining the pairs (a, b): every node points at the smallest of its set."""
    while True:
        ra, rb = root[a], root[b]
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        if not (high != low).any():
            return root
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def link_group(codes: np.ndarray, distance: int) -> np.ndarray:
    """For sorted distinct codes that share a block: the place of the smallest code each one reaches."""
    root = np.arange(len(codes))
    index = GrayIndex(codes)
    place = np.searchsorted(codes, index.codes)
    size = max(1, min(CHUNK, (1 << 22) // max(1, len(index.levels[0][1]))))
    for at in range(0, len(codes), size):
        q, found = index.search(codes[at : at + size], distance)
        root = least_reached(len(codes), q + at, place[found], root)
    return root


def parts_of(mask: int, n: int) -> list[int]:
    """The bits of a mask in n runs of about equal size."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grouped(fps: DataFrame, distance: int) -> tuple[DataFrame, int]:
    """(rows (block, key, fp) in which all pairs within the distance share a block and key; their number)."""
    blocks = distance + 1
    paths = {(): (1 << 64) - 1}  # blocks taken so far -> bits left

    def dealt(rows: DataFrame, level: int) -> DataFrame:
        """rows (path, key, fp) -> for each block of the bits left: its path and the key that its value adds."""
        taken = sorted(p for p in paths if len(p) == level)
        masks = F.array(*[F.lit(_signed(m)) for p in taken for m in parts_of(paths[p], blocks)])
        for p in taken:
            for i, m in enumerate(parts_of(paths[p], blocks)):
                paths[(*p, i)] = paths[p] & ~m
        each = rows.withColumn("next", F.explode(F.array(*[F.lit(i) for i in range(blocks)]))).withColumn("path", F.col("path") * blocks + F.col("next"))
        return each.select("path", F.xxhash64("key", "path", F.col("fp").bitwiseAND(F.element_at(masks, F.col("path") + 1))).alias("key"), "fp")

    rows, whole, total = dealt(fps.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"), "fp"), 0), None, 0
    for level in range(LEVELS):
        first = F.floor(F.col("path") / blocks**level).cast("int").alias("block")
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("n"))
        hot = materialize(sizes.where(F.col("n") > HOT).select("path", "key")) if level + 1 < LEVELS else None
        n = sizes.agg(F.sum("n")).first()[0] or 0
        split = hot is not None and hot.limit(1).count()
        kept = (rows.join(hot, ["path", "key"], "left_anti") if split else rows).select(first, "key", "fp")
        whole, total = kept if whole is None else whole.union(kept), total + n
        if not split:
            break
        rows = materialize(dealt(rows.join(hot, ["path", "key"], "left_semi"), level + 1))
    return whole, total


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Distinct fingerprints `fp` -> edges (a, b) that connect the same sets as all pairs within the distance."""
    blocks = distance + 1
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    rows, n = grouped(fps, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.array([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)]) for b in batches]
        if not parts:
            return
        block, fp = np.concatenate(parts, axis=1)
        for k in range(blocks):
            # one index over all groups of this block in the partition: the block (counted from the lowest bit) leads, so groups part near the top
            turn = BITS - bounds[k + 1]
            turned = np.unique(rotate(fp[block == k].view(np.uint64), turn))
            if len(turned) < 2:
                continue
            root = link_group(turned, distance)
            moved = np.flatnonzero(root != np.arange(len(root)))
            back = (BITS - turn) % BITS
            a, b = rotate(turned[moved], back), rotate(turned[root[moved]], back)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    parts = sized_partitions(fps.sparkSession, n, PART_ROWS)
    return rows.repartition(parts, "block", "key").select(F.col("block").cast("long"), "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, label): label is the same for the nodes of a component, one of them.

    Large-star and small-star steps: each round hangs every neighbour of a node on the smallest one around. Every round is a table in the
    shared folder; the number of edges never grows, and rounds end when every component is a star.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node hang on the smallest of its neighbourhood
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: neighbours below a node, and the node, hang on the smallest of them
        low = large.where("b < a")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialize(small)
        # done when all edges are stars: nobody has two centres, and no centre has one
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e"))
        if not ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or (ups > 0 and n > ups)").limit(1).count():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per document with the smallest id it reaches over links of fingerprints."""
    marked = materialize(fingerprints(docs, shingle))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(label, distinct.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    # as a table: the join then reads two exchanges, so adaptive execution can split the rows of a very large component
    roots = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(roots, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
