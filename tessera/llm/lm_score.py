"""Stupid-backoff scores of documents under an n-gram model of the rest of the corpus.

The count tables are relations of (n-gram hash, block, count), partitioned by hash range and stored as arrays: a row holds all n-grams of one block in
one range. Blocks of documents send their distinct n-grams of all orders with their counts; a partition groups them by hash, adds them up and joins the
totals back to the rows it got; the block joins them to its exploded n-grams and sums per document. A document's own counts are taken off first, so
that it is scored by the others. One row for each n-gram would say the same in several times the bytes (README).

Keys are hashes of KEY_BITS bits and as many more as keep the expected share of n-grams that share their key with another at 2^-SPARE_BITS at most,
whatever the size of the corpus.

score(w | context) = c(context w) / c(context) at the longest context for which both are counted elsewhere, times `backoff`
for every order left out; a word that no other document holds counts as half an occurrence. Counts cover all documents. Messages are
pre-aggregated per block, so the most frequent n-gram is one row of each block.

Defined cases: null and empty texts have no tokens, log_score 0 and a null mean; repeated rows are documents of their own; a corpus of one
document scores each of its words as unseen; an empty table gives an empty result; texts of any length are counted whole, by their block;
input columns named as the added ones or `text` are left out, all other names stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, MESSAGE, blocked, counts, cut, cut_counts, joined, joined_counts, messages, no_messages, packed_keys, rows_of, unpacked_keys
from .common import ALNUM_TABLE

KEY_BITS, SPARE_BITS = 48, 16
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Kinds of messages: the number of tokens, or n-grams with the width of their steps.
TOKENS, TYPES = -1, [np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64)]


def key_bits(blocks: int, order: int) -> int:
    """A block has fewer distinct n-grams than bytes times orders; that bounds those of the corpus."""
    return min(64, max(KEY_BITS, (blocks * BLOCK_BYTES * order).bit_length() - 2 + SPARE_BITS))


class Grams:
    """The n-grams of a block: per order the keys in text order with their document, and the distinct keys of all orders, ascending."""

    def __init__(self, texts: list[bytes], order: int, bits: int):
        digest = xxhash.xxh3_64_intdigest
        words = [np.fromiter(map(digest, t.translate(ALNUM_TABLE).split()), np.uint64) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        number = np.repeat(np.arange(len(words)), self.sizes)
        word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.keys, self.numbers, rolled = [], [], np.zeros(len(word), np.uint64)
        for n in range(1, order + 1):
            # the n-gram that ends at each word, where it lies in one document
            rolled = rolled[: len(word) - n + 1] * MULTIPLIERS[0] + word[n - 1 :] if n > 1 else word.copy()
            mixed = (rolled ^ (rolled >> np.uint64(31)) ^ np.uint64(n)) * MULTIPLIERS[1]
            inside = number[n - 1 :] == number[: len(number) - n + 1]
            self.keys.append((mixed ^ (mixed >> np.uint64(29))) * MULTIPLIERS[2] >> np.uint64(64 - bits))
            self.numbers.append(np.where(inside, number[n - 1 :], -1))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The distinct keys of all orders, ascending; how often each occurs; and per order the number of each n-gram's key among them, -1 where none is."""
        valid = [d >= 0 for d in self.numbers]
        keys = np.concatenate([k[v] for k, v in zip(self.keys, valid, strict=True)])
        order = np.argsort(keys)
        ascending = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ascending[1:] != ascending[:-1]
        first = np.flatnonzero(new)
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(new) - 1
        places, at = [], 0
        for v in valid:
            place = np.full(len(v), -1)
            place[v] = back[at : at + v.sum()]
            places.append(place)
            at += v.sum()
        return ascending[first], np.diff(np.append(first, len(keys))), places

    def others(self, place: np.ndarray, totals: np.ndarray, n: int) -> np.ndarray:
        """For each word position: in how many places outside the document the n-gram that ends there occurs; -1 where there is none."""
        numbers = self.numbers[n - 1]
        left = np.where(place >= 0, 0, -1)
        # what occurs once in the corpus occurs here alone; only the rest is counted by document
        more = np.flatnonzero((place >= 0) & (totals[place] > 1)) if len(totals) else np.zeros(0, np.int64)
        pair = place[more] * (len(self.sizes) + 1) + numbers[more]
        order = np.argsort(pair)
        ascending = pair[order]
        new = np.ones(len(pair), bool)
        new[1:] = ascending[1:] != ascending[:-1]
        times = np.diff(np.append(np.flatnonzero(new), len(pair)))
        left[more[order]] = totals[place[more[order]]] - np.repeat(times, times)
        return np.concatenate([np.full(min(n - 1, int(self.sizes.sum())), -1), left])


def _send(order: int, buckets: int, bits: int):
    def send(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams = Grams(rows_of(table)[2], order, bits)
        keys, counts, _ = grams.distinct()
        block = group[0].as_py()
        bucket, ends, steps = packed_keys(keys, bits, buckets)
        tokens = messages(0, block, TOKENS, cut(np.array([grams.sizes.sum()], np.int64), np.array([1])))
        return pa.concat_tables([tokens, messages(bucket, block, TYPES.index(steps.dtype), cut(steps, ends), *cut_counts(counts, ends))])

    return send


def _answer(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    here, kinds = group[0].as_py(), table["kind"].to_numpy()
    out, blocks, sizes, keys, counts = [no_messages()], [], [], [], []
    for kind in np.unique(kinds).tolist():
        mine = table.filter(pa.array(kinds == kind))
        if kind == TOKENS:
            total = int(joined(mine["a"], np.dtype(np.int64))[0].sum())
            out.append(messages(here, mine["block"].to_numpy(), TOKENS, cut(np.full(len(mine), total), np.arange(1, len(mine) + 1))))
            continue
        steps, n = joined(mine["a"], TYPES[kind])
        blocks.append(mine["block"].to_numpy())
        sizes.append(n)
        keys.append(unpacked_keys(steps, n))
        counts.append(joined_counts(mine["b"], mine["c"])[0])
    if keys:
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(back, np.concatenate(counts), len(distinct)).astype(np.int64)[back]
        out.append(messages(here, np.concatenate(blocks), 0, *cut_counts(totals, np.cumsum(np.concatenate(sizes)))))
    return pa.concat_tables(out)


def _totals(answers: pa.Table) -> tuple[int, np.ndarray]:
    """(tokens of the corpus, totals of the block's keys in order)."""
    kinds, buckets = answers["kind"].to_numpy(), answers["bucket"].to_numpy()
    tokens = joined(answers.filter(pa.array(kinds == TOKENS))["a"], np.dtype(np.int64))[0]
    order = np.flatnonzero(kinds != TOKENS)
    rows = answers.take(pa.array(order[np.argsort(buckets[order])]))
    return int(tokens[0]) if len(tokens) else 0, joined_counts(rows["a"], rows["b"])[0]


def _score(order: int, backoff: float, names: list[str], bits: int):
    def score(group: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        table, _, texts = rows_of(table)
        grams = Grams(texts, order, bits)
        tokens, totals = _totals(answers)
        places = grams.distinct()[2]
        number = np.repeat(np.arange(len(texts)), grams.sizes)
        place = np.arange(len(number)) - np.repeat(np.cumsum(grams.sizes) - grams.sizes, grams.sizes)
        outside = np.maximum(1, tokens - grams.sizes)[number]
        lower = grams.others(places[0], totals, 1)
        scores = np.log(np.where(lower > 0, lower, 0.5) / outside)
        for n in range(2, order + 1):
            these = grams.others(places[n - 1], totals, n)
            before = np.concatenate([[-1], lower[:-1]])[: len(lower)]  # the context ends one word earlier
            better = (these > 0) & (before > 0)
            longer = np.log(np.where(better, these, 1) / np.where(better, before, 1))
            scores = np.where(better, longer, np.where(place >= n - 1, scores + np.log(backoff), scores))
            lower = these
        summed = np.bincount(number, scores, len(texts))
        columns = {n: table[f"in_{i}"] for i, n in enumerate(names)}
        columns["n_tokens"] = pa.array(grams.sizes, pa.int64())
        columns["log_score"] = pa.array(summed, pa.float64())
        columns["mean_log_score"] = pa.array([s / n if n else None for s, n in zip(summed.tolist(), grams.sizes.tolist(), strict=True)], pa.float64())
        return pa.table(columns)

    return score


def scored(docs: DataFrame, order: int = 3, backoff: float = 0.4) -> DataFrame:
    """docs without text plus n_tokens, log_score (natural logarithms, summed over the words) and mean_log_score."""
    made = {"n_tokens", "log_score", "mean_log_score", "text"}
    names = [c for c in docs.columns if c.lower() not in made]
    blocks, buckets = counts(docs)
    bits = key_bits(blocks, order)
    by_block = blocked(docs, names, blocks)
    sent = by_block.applyInArrow(_send(order, buckets, bits), MESSAGE)
    answers = sent.groupBy("bucket").applyInArrow(_answer, MESSAGE)
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).withColumns({"n_tokens": F.lit(0).cast("long"), "log_score": F.lit(0.0), "mean_log_score": F.lit(None).cast("double")}).schema
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_score(order, backoff, names, bits), schema)
