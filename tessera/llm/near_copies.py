"""SimHash near-dedup by similarity: the Gray-order index of `simhash` finds links, exact Jaccard similarity of word shingles confirms them, and a
prefix filter adds what lies too far apart for 64 bits, so that no pair at or above the threshold is missed (up to 64-bit hash collisions).

1. Every text gets its fingerprint over the same shingles; fingerprints within DISTANCE bits are linked by the Gray index.
2. Two sets with a Jaccard similarity of t share at least one of their first n - ceil(t * n) + 1 shingles in any order common to all sets (prefix
   filter). The order puts shingles that a bounded sample holds often last, so that common passages seldom lead; which ones the sample finds
   changes the cost, never the result. Neighbours in each leading shingle are candidates as well.
3. The texts confirm or reject the candidates of both kinds. A shingle that leads no more sets than the neighbours reach has all its pairs compared by
   then. Sets that share any other leading shingle and are still in different components are compared in a last round; that connects the same sets as all pairs do.

Before a pair becomes a candidate, sizes, places and parity bitmaps must allow the similarity: a bitmap has the parity of how many shingles fall on each of
PARITY bits, so two bitmaps never differ in more bits than the sets differ in shingles. That bound rejects no pair wrongly. PARITY bits say little about
long texts, so candidates are checked by bitmaps of about a bit for each shingle before their texts are sent.

At a similarity of 0.8 two fingerprints differ in 10 of 64 bits on average, which is why the index alone finds but the closest copies.

Defined cases: null, empty and blank texts have no shingles and are copies of each other; fewer words than a shingle make one shingle of
them all; repeated rows each give a row; a null doc_id never becomes a component id unless all ids of the component are null; texts of any length are
read whole; an empty table gives an empty result; input columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, released
from .blocks import MESSAGE, cut, cut_steps, joined, joined_steps, messages, no_messages, packed_keys, unpacked_keys
from .common import column, sized_partitions
from .simhash import SEED, components, fingerprint_of, links, shingle_hashes

#: Texts sampled for the order, how often a shingle must occur among them to be put last, and how many such shingles travel.
SAMPLE, OFTEN, COMMON = 8192, 3, 1 << 16
#: Pairs compared at once, texts of a batch that are taken as strings at once.
CHUNK, SLICE = 1 << 18, 512
#: Numbers of rows that are broadcast at once at most, and how often.
SENT, SLICES = 1 << 18, 64
#: Neighbours that the first round compares a set with, for each leading shingle.
NEAR = 4
#: Bits that linked fingerprints may differ in, and rows of a partition.
DISTANCE, PART_ROWS = 3, 1 << 18
#: Bits of the parity bitmap that travels with each leading shingle, and its columns; most bits of the one that pairs are checked by.
PARITY, BITMAP, MOST_BITS = 256, ["b0", "b1", "b2", "b3"], 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a leading shingle's hash by which it is looked up elsewhere, shingles of a block and of a bucket.
KEY_BITS, BLOCK_KEYS, BUCKET_KEYS = 40, 1 << 20, 1 << 21
#: Kind of message: a row that stands for its set; the others are bytes of a step.
CHOSEN = 9
#: A leading shingle of a set.
ROW = ["h", "set_id", "n", "pos", *BITMAP]
ROWS, ROW_TYPES = "h long, set_id long, n int, pos int, b0 long, b1 long, b2 long, b3 long", [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * len(BITMAP)]


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles as sorted hashes."""
    return np.unique(shingle_hashes(text, shingle))


def common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank from 1) of the shingles that a sample of the distinct texts holds most often."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, shingle) for x in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.empty(0, np.uint64)]).view(np.int64))], names=["h"])

    rows = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON).collect()
    hashes = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(rows) - np.arange(len(rows)))[order]


def marked(docs: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """doc_id, text, set_id, the fingerprint, the number of shingles and the leading ones in order."""
    hashes, ranks = common(docs, shingle)
    last = docs.sparkSession.sparkContext.broadcast((hashes, ranks))
    schema = docs.select("doc_id", "text").withColumns({"set_id": F.lit(0).cast("long"), "fp": F.lit(0).cast("long"), "n": F.lit(0), **{b: F.lit(0).cast("long") for b in BITMAP}, "parity": F.lit(b""), "lead": F.array().cast("array<long>")}).schema
    over, under = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = last.value
        for batch in batches:
            ids, sizes, leads, prints, parity, whole = [], [], [], [], [], []
            for text in (x for at in range(0, batch.num_rows, SLICE) for x in column(batch.slice(at, SLICE), "text")):
                h = shingle_hashes(text, shingle)
                prints.append(fingerprint_of(h))
                h = np.unique(h)
                n = len(h)
                ids.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) if n else 0)
                sizes.append(n)
                parity.append(np.packbits(np.bincount((h % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).view(np.int64))
                whole.append(parity_of(h))
                rank = np.zeros(n, np.int64)
                if len(hashes) and n:
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    rank = np.where(hashes[at] == h, ranks[at], 0)
                leads.append(h[np.argsort(rank, kind="stable")][: n - -(-over * n // under) + 1 if n else 0].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in leads])]).astype(np.int32)
            lead = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(leads) if leads else np.empty(0, np.int64)))
            made = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, prints)), pa.array(sizes, pa.int32()), *(pa.array(x) for x in np.array(parity, np.int64).reshape(-1, len(BITMAP)).T), pa.array(whole, pa.binary()), lead]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["doc_id", "text", "set_id", "fp", "n", *BITMAP, "parity", "lead"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def parity_of(h: np.ndarray) -> bytes:
    """The parity bitmap of a set with about a bit for each shingle: PARITY bits or a power of two beyond, MOST_BITS at most."""
    bits = min(MOST_BITS, max(PARITY, 1 << (len(h) - 1).bit_length() if len(h) else 0))
    return np.packbits(np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def parities_apart(x: bytes, y: bytes) -> int:
    """In how many bits two such bitmaps differ; the longer one is folded to the length of the other, which is the bitmap of that many bits."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(len(names))]


def _leading(table: pa.Table, chosen: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The chosen rows of a block in order of their numbers, their leading shingles one after the other, and how many each row has."""
    table = table.take(pa.array(np.argsort(table["row_"].to_numpy())))
    table = table.filter(pa.array(np.isin(table["row_"].to_numpy(), chosen)))
    h = np.concatenate([np.empty(0, np.int64), *(c.flatten().to_numpy() for c in table["lead"].chunks)]).view(np.uint64)
    return table, h, np.concatenate([np.empty(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in table["lead"].chunks)])


def _send_keys(buckets: int):
    def send(group: tuple[pa.Scalar, ...], table: pa.Table, first: pa.Table) -> pa.Table:
        _, h, _ = _leading(table, first["bucket"].to_numpy())
        if not len(h):
            return no_messages()
        keys, times = np.unique(h >> np.uint64(64 - KEY_BITS), return_counts=True)
        bucket, ends, steps = packed_keys(keys, KEY_BITS, buckets)
        width, column = cut_steps(steps, ends)
        return messages(bucket, group[0].as_py(), width, column, cut((times > 1).astype(np.uint8), ends))

    return send


def _answer_keys(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    kinds = table["kind"].to_numpy()
    blocks, sizes, keys, twice = [], [], [], []
    for kind in np.unique(kinds).tolist():
        mine = table.filter(pa.array(kinds == kind))
        steps, n = joined_steps(mine["a"], kind)
        blocks.append(mine["block"].to_numpy())
        sizes.append(n)
        keys.append(unpacked_keys(steps, n))
        twice.append(joined(mine["b"], np.dtype(np.uint8))[0])
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    meets = np.bincount(back, 1 + np.concatenate(twice).astype(np.int64), len(distinct)) > 1
    return messages(group[0].as_py(), np.concatenate(blocks), 0, cut(meets.astype(np.uint8)[back], np.cumsum(np.concatenate(sizes))))


def _send_rows(group: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
    kinds = answers["kind"].to_numpy()
    table, h, sizes = _leading(table, answers["bucket"].to_numpy()[kinds == CHOSEN])
    answers = answers.filter(pa.array(kinds != CHOSEN))
    meets = joined(answers["a"].take(pa.array(np.argsort(answers["bucket"].to_numpy()))), np.dtype(np.uint8))[0].astype(bool)
    keys = h >> np.uint64(64 - KEY_BITS)
    at = np.flatnonzero(meets[np.searchsorted(np.unique(keys), keys)]) if len(h) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)[at]
    pos = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[at]
    others = table.select(["set_id", "n", *BITMAP]).take(pa.array(row, pa.int64()))
    return others.append_column("h", pa.array(h[at].view(np.int64))).append_column("pos", pa.array(pos, pa.int32())).select(ROW)


def _rows_that_meet(all_docs: DataFrame, first: DataFrame, count: int) -> DataFrame:
    """The rows (h, set_id, n, pos, bitmap) whose shingle leads more than one set, and a few that share KEY_BITS of its hash only.

    Blocks of rows send the sorted hashes of their leading shingles to buckets, packed as in `blocks`, and learn which of them others sent as well, so
    that the sizes and bitmaps of a set travel with the few shingles that meet. Of equal sets the row of the smallest number counts; blocks are dealt by
    numbers of rows, so very many copies part.
    """
    least = int(all_docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = max(least, -(-count // BLOCK_KEYS)), max(least, -(-count // BUCKET_KEYS))
    block = F.pmod(F.xxhash64("row_"), F.lit(blocks)).alias("block_")
    by_block = all_docs.select("row_", "set_id", "n", *BITMAP, "lead", block).groupBy(F.col("block_").alias("block"))
    nothing = F.lit(None).cast("binary")
    chosen = first.select(F.col("row_").alias("bucket"), block.alias("block"), F.lit(CHOSEN).alias("kind"), nothing.alias("a"), nothing.alias("b"), nothing.alias("c"))
    keys = by_block.cogroup(chosen.groupBy("block")).applyInArrow(_send_keys(buckets), MESSAGE)
    answers = keys.groupBy("bucket").applyInArrow(_answer_keys, MESSAGE).unionByName(chosen)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_send_rows, ROWS)


def _compared(columns: list[np.ndarray], least: tuple[int, int], all_pairs: bool) -> Iterator[np.ndarray]:
    """Pairs of sets that may be similar, in parts, from sorted columns (h, label, n, set_id, pos, bitmap): neighbours in each shingle, or all of different labels."""
    over, under = least
    h, label, n, ids, pos, *bitmap = columns
    size = len(h)
    if not size:
        return
    new_h = np.append(True, h[1:] != h[:-1])
    group_end = _ends(new_h)
    first = _ends(new_h | np.append(True, label[1:] != label[:-1])) if all_pairs else np.arange(1, size + 1)
    width = np.minimum(group_end - first, size if all_pairs else NEAR)
    before = np.append(0, np.cumsum(width))
    found, held = [], 0
    done = 0
    while done < size:
        # whole rows up to the chunk, one at least
        stop = max(done + 1, int(np.searchsorted(before, before[done] + CHUNK, side="right")) - 1)
        w = width[done:stop]
        i = np.repeat(np.arange(done, stop), w)
        j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        done = stop
        bound = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
        ok = (over * np.maximum(n[i], n[j]) <= under * np.minimum(n[i], n[j])) & ((over + under) * bound >= over * (n[i] + n[j]))
        i, j = i[ok], j[ok]
        apart = sum(np.bitwise_count((b[i] ^ b[j]).view(np.uint64)).astype(np.int64) for b in bitmap)
        ok = (over + under) * apart <= (under - over) * (n[i] + n[j])
        i, j = i[ok], j[ok]
        found.append(_distinct(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])])))
        held += found[-1].shape[1]
        if held > CHUNK or done >= size:
            pairs = _distinct(np.concatenate(found, axis=1))
            found, held = [pairs], pairs.shape[1]
            if held > CHUNK // 2 or done >= size:
                yield pairs
                found, held = [], 0


def _ends(new: np.ndarray) -> np.ndarray:
    """Where the group of each row ends; new: the rows that begin one."""
    return np.append(np.flatnonzero(new), len(new))[np.cumsum(new)]


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    return pairs[:, np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))[: pairs.shape[1]]]


def _neighbours(rows: DataFrame, count: int, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs (a, b) of neighbours in each shingle; the rows whose shingle leads so many sets that not all of its pairs are among those)."""
    names = ["kind", "a", "b", *ROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, ids, *rest = _columns(batches, ROW)
        # neighbours are the same for all shingles, so that a dense group gets a few links for each set, not for each shingle of it
        mixed = ids.view(np.uint64) * MIX
        order = np.lexsort((ids, mixed ^ (mixed >> np.uint64(32)), h))
        h, ids, n, pos, *bitmap = (x[order] for x in (h, ids, *rest))
        for a, b in _compared([h, ids, n.astype(np.int64), ids, pos.astype(np.int64), *bitmap], least, False):
            empty = [pa.nulls(len(a), t) for t in ROW_TYPES]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b), *empty], names=names)
        _, group, times = np.unique(h, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[group] > NEAR + 1) if len(times) else np.empty(0, np.int64)
        for start in range(0, len(at), 1 << 16):
            mine = at[start : start + (1 << 16)]
            none = pa.nulls(len(mine), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(mine), np.int32)), none, none, *(pa.array(x[mine], t) for x, t in zip((h, ids, n, pos, *bitmap), ROW_TYPES, strict=True))], names=names)

    parts = sized_partitions(rows.sparkSession, count, PART_ROWS)
    both = materialize(rows.repartition(parts, "h").mapInArrow(run, f"kind int, a long, b long, {ROWS}"))
    return both.where("kind = 0").select("a", "b"), both.where("kind = 1").select(*ROW)


def _candidates(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of sets of different labels that may be similar, from rows (h, label, set_id, n, pos, bitmap)."""
    names = ["h", "label", "n", "set_id", "pos", *BITMAP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, label, n, ids, pos, *bitmap = _columns(batches, names)
        order = np.lexsort((ids, label, h))
        columns = [x[order] for x in (h, label, n.astype(np.int64), ids, pos.astype(np.int64), *bitmap)]
        for a, b in _compared(columns, least, True):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    parts = sized_partitions(rows.sparkSession, rows.count(), PART_ROWS)
    return rows.repartition(parts, "h").select(*names).mapInArrow(run, "a long, b long").distinct()


def _texts(all_docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and text of the wanted rows (row_). Up to SENT of them are broadcast for each stretch of rows, so no text travels that is not wanted; beyond SLICES stretches the texts are joined."""
    slices = -(-wanted.count() // SENT)
    if slices > SLICES:
        return all_docs.join(wanted, "row_", "left_semi").select("set_id", "text")
    bounds = [int(x) for x in wanted.approxQuantile("row_", [i / slices for i in range(1, slices)], 0.01)] if slices > 1 else []
    parts = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        here = F.lit(True) if low is None else F.col("row_") >= low
        here = here if high is None else here & (F.col("row_") < high)
        parts.append(all_docs.where(here).join(F.broadcast(wanted.where(here)), "row_", "left_semi").select("set_id", "text"))
    return reduce(DataFrame.union, parts)


def _plausible(pairs: DataFrame, first: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose bitmaps of about a bit for each shingle allow the similarity. PARITY bits tell nothing about sets of over twice as many shingles."""
    over, under = least
    end = lambda x: first.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (column(batch, c) for c in ("n_a", "n_b", "parity_a", "parity_b"))
            ok = [(over + under) * parities_apart(x, y) <= (under - over) * (n + m) for n, m, x, y in zip(*columns, strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, all_docs: DataFrame, first: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """The pairs whose texts are similar; first: set_id, n, parity and the number of the row that stands for the set."""
    pairs = materialize(_plausible(pairs, first, least))
    wanted = materialize(first.join(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id").select("row_"))
    texts = materialize(_texts(all_docs, wanted))
    both = pairs.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
    over, under = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, last = [], (None, None)
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for x, text, b in zip(column(part, "text_a"), column(part, "text_b"), column(part, "b"), strict=True):
                    if b != last[0]:
                        last = b, shingles(text, shingle)
                    x, y = shingles(x, shingle), last[1]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    same.append((over + under) * shared >= over * (len(x) + len(y)))
            yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _linked_by_index(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints the Gray index links: sets of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    first = materialize(sets.where("n > 0").groupBy("fp").agg(F.min("set_id").alias("first")))
    same = sets.join(first, "fp").where("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    edges = links(first.select("fp"), DISTANCE)
    ends = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"set_{name}"))
    apart = edges.join(ends("a"), "a").join(ends("b"), "b").select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"))
    return same.union(apart)


def near_copies(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, component_id): one row per document with the smallest id it reaches over pairs of similarity least[0] / least[1] and more."""
    all_docs = materialize(marked(docs, shingle, least).withColumn("row_", F.monotonically_increasing_id()))
    first = materialize(all_docs.groupBy("set_id").agg(F.min("row_").alias("row_"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("parity").alias("parity")))
    count = all_docs.agg(F.sum(F.size("lead"))).first()[0] or 0
    near, crowded = _neighbours(_rows_that_meet(all_docs, first, count), count, least)
    near = _linked_by_index(first).union(near)
    pairs = released(lambda: _confirmed(near.distinct(), all_docs, first, shingle, least))
    label = components(pairs)
    labelled = crowded.join(label, crowded.set_id == label.node, "left").select(*ROW, F.coalesce("label", "set_id").alias("label"))
    pairs = pairs.union(released(lambda: _confirmed(_candidates(labelled, least), all_docs, first, shingle, least)))
    distinct = all_docs.groupBy("set_id").agg(F.min("doc_id").alias("least"))
    label = components(pairs)
    rooted = distinct.join(label, distinct.set_id == label.node, "left").select("set_id", "least", F.coalesce("label", "set_id").alias("root"))
    # as a table: the join then reads two exchanges, so adaptive execution can split the rows of a very large component
    roots = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(roots, "root").select("set_id", "component_id")
    return all_docs.select("doc_id", "set_id").join(named, "set_id").select("doc_id", "component_id")
