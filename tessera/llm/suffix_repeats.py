"""Removal of repeated passages by maximal repeats of an enhanced suffix array.

A byte goes when a string of `length` bytes around it also starts in a document with a smaller id. All suffixes of the corpus in one array
would not fit a machine, so equal strings are first brought together. Every window of `length` bytes has a minimizer, the
least hash among its strings of SEED bytes, and equal windows have equal minimizers; neighbouring windows mostly share theirs, so a
text falls into contexts of up to length - SEED + 1 windows each.

1. Blocks send the hashes of their minimizers to key buckets, which answer which of them occur in more than one document.
   Keys are KEY_BITS of a hash; of n keys a share of n / 2^KEY_BITS is taken for shared without being so, which costs messages and changes no result.
2. Blocks send the contexts of those, once each and compressed as far as that makes them shorter, with the smallest id that holds it. A bucket sorts the suffixes of its contexts, computes the
   common prefixes of neighbours and scans them with a stack: each interval of the common-prefix tree of at least `length` bytes is a
   repeat, and it is maximal when the bytes to the left of its occurrences differ (the start of a context counts as different).
   Every maximal repeat gives all its occurrences the smallest id among them.
3. Blocks compare these ids with their own and cut.

A length below SEED is a seed of its own size; lengths beyond LONGEST are refused.

Hot groups: a minimizer in more than HOT_DOCUMENTS documents doesn't send contexts, which edits make distinct, but single windows, dealt by
their own hash; equal ones meet as one row per block. So no bucket gathers more than one row per block and distinct window, and
nothing is capped. Minimizers only choose candidates; a removal always rests on compared bytes.

Defined cases: null and empty texts are zero bytes; texts shorter than `length` lose nothing; rows with the same id don't count against each other;
a null id comes after all others (and ties with the largest long); repeated rows give equal results; a document of any length is handled in pieces that
overlap; an empty table gives an empty result; input columns named as the added ones or `text` are left out, all other names stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, blocked, bucket_of, counts, cut, cut_steps, joined, joined_steps, messages, narrow, no_messages, opened, packed_keys, rows_of, squeezed, unpacked_keys

SEED, LONGEST = 16, 1 << 15
HOT_DOCUMENTS = 4096
PIECE, SUFFIXES, LOWERED = 1 << 18, 1 << 17, 1 << 20
PLACE_BITS, KEY_BITS = 24, 40
BYTE = np.random.RandomState(7).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
CODE_ONE, CODE_SHARED, CODE_HOT = 0, 1, 2
#: Kind of message: contexts; the others are keys, by the bytes of their steps, and what became of them.
CONTEXTS = 9


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STEPS[0]
    return h ^ (h >> np.uint64(29))


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of `size` bytes, from hashes of powers of two that double."""
    powers, h, width = {}, BYTE[data], 1
    while width <= size:
        powers[width] = h
        if width * 2 <= size:
            h = h[:-width] * STEPS[width.bit_length() % 5] + h[width:]
        width *= 2
    out, at, n = None, 0, len(data) - size + 1
    for width in sorted(powers, reverse=True):
        if size & width:
            part = powers[width][at : at + n]
            out = part if out is None else out * STEPS[4] + part
            at += width
    return _mix(out)


def context_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(document number, first window, windows, minimizer key) of all contexts, in order."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            found.append(_runs(group, length))
        group, held = [], 0

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[at : at + PIECE + length - 1]
            if len(piece) >= length:
                group.append((number, at, piece))
                held += len(piece)
                if held >= PIECE:
                    flush()
    flush()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate([x[i] for x in found]) for i in range(4))


def _runs(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
    sizes = np.array([len(x[2]) for x in group])
    starts = np.cumsum(sizes) - sizes
    seed = min(SEED, length)
    h = string_hashes(data, seed)
    least = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - seed + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    windows = sizes - length + 1
    at = np.arange(windows.sum()) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    place = least[at] & np.uint64((1 << PLACE_BITS) - 1)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    piece = np.searchsorted(starts, at[first], "right") - 1
    number, offset = (np.array([x[i] for x in group])[piece] for i in (0, 1))
    # least hashes are small: mixed once more, they spread over the buckets
    key = _mix(h[place[first].astype(np.int64)]) >> np.uint64(64 - KEY_BITS)
    return number, at[first] - starts[piece] + offset, np.diff(np.append(first, len(at))), key


def _ascending(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order; by sorting, which is faster here than the hashing of np.unique."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def _documents_by_key(number: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and in how many documents each occurs."""
    order = np.lexsort((number, key))
    k, d = key[order], number[order]
    own = np.ones(len(k), bool)
    own[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.unique(k[own], return_counts=True)


def _send_keys(buckets: int, length: int):
    def send(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, texts = rows_of(table)
        number, _, _, key = context_runs(texts, length)
        keys, count = _documents_by_key(number, key)
        bucket, ends, steps = packed_keys(keys, KEY_BITS, buckets)
        width, column = cut_steps(steps, ends)
        return messages(bucket, group[0].as_py(), width, column, cut(np.minimum(count, 65535).astype(np.uint16), ends))

    return send


def _answer_keys(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    kinds = table["kind"].to_numpy()
    blocks, sizes, keys, counts = [], [], [], []
    for kind in np.unique(kinds).tolist():
        mine = table.filter(pa.array(kinds == kind))
        steps, n = joined_steps(mine["a"], kind)
        blocks.append(mine["block"].to_numpy())
        sizes.append(n)
        keys.append(unpacked_keys(steps, n))
        counts.append(joined(mine["b"], np.dtype(np.uint16))[0])
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts), len(distinct))
    code = np.where(total < 2, CODE_ONE, np.where(total > HOT_DOCUMENTS, CODE_HOT, CODE_SHARED)).astype(np.uint8)[back]
    return messages(group[0].as_py(), np.concatenate(blocks), 0, cut(code, np.cumsum(np.concatenate(sizes))))


class Contexts:
    """The contexts that a block sends: runs of windows, and for each bucket the distinct strings in order with their smallest id."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], codes: np.ndarray, length: int, buckets: int):
        number, first, windows, key = context_runs(texts, length)
        code = codes[np.searchsorted(_ascending(key), key)] if len(key) else np.zeros(0, np.uint8)
        shared, hot = code == CODE_SHARED, code == CODE_HOT
        spread = windows[hot]
        inside = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        self.number = np.concatenate([number[shared], np.repeat(number[hot], spread)])
        self.first = np.concatenate([first[shared], np.repeat(first[hot], spread) + inside])
        self.windows = np.concatenate([windows[shared], np.ones(len(inside), np.int64)])
        strings = [texts[i][a : a + n + length - 1] for i, a, n in zip(self.number.tolist(), self.first.tolist(), self.windows.tolist(), strict=True)]
        plain = int(shared.sum())
        bucket = np.concatenate([bucket_of(key[shared], KEY_BITS, buckets), _window_buckets(strings[plain:], length, buckets)])
        self.entries: dict[int, dict[bytes, int]] = {}
        self.least: dict[int, list[int]] = {}
        self.bucket, self.entry = bucket, np.empty(len(strings), np.int64)
        own = ids[self.number].tolist()
        for k, (b, string) in enumerate(zip(bucket.tolist(), strings, strict=True)):
            known = self.entries.setdefault(b, {})
            at = known.setdefault(string, len(known))
            least = self.least.setdefault(b, [])
            if at == len(least):
                least.append(own[k])  # rows are in order of id, but hot windows come after the rest
            elif own[k] < least[at]:
                least[at] = own[k]
            self.entry[k] = at


def _window_buckets(strings: list[bytes], length: int, buckets: int) -> np.ndarray:
    out = []
    for at in range(0, len(strings), 1 << 15):
        part = strings[at : at + (1 << 15)]
        h = string_hashes(np.frombuffer(b"".join(part), np.uint8), length)[::length]
        out.append(bucket_of(h >> np.uint64(64 - KEY_BITS), KEY_BITS, buckets))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _codes(table: pa.Table) -> np.ndarray:
    """What became of the block's keys, in order."""
    mine = table.filter(pa.array(table["kind"].to_numpy() != CONTEXTS))
    return joined(mine["a"].take(pa.array(np.argsort(mine["bucket"].to_numpy()))), np.dtype(np.uint8))[0]


def _send_contexts(buckets: int, length: int):
    def send(group: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return no_messages()
        _, ids, texts = rows_of(table)
        c = Contexts(ids, texts, _codes(answers), length, buckets)
        order = sorted(c.entries)
        strings = [x for b in order for x in c.entries[b]]
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(np.fromiter((len(c.entries[b]) for b in order), np.int64, len(order)))
        texts = pa.array([squeezed(b"".join(c.entries[b])) for b in order], pa.binary())
        least = pa.array([squeezed(np.array(c.least[b], np.int64).tobytes()) for b in order], pa.binary())
        return messages(np.array(order, np.int64), group[0].as_py(), CONTEXTS, texts, cut(sizes.astype(np.uint32), ends), least)

    return send


def common_prefixes(rows: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the row before; left: how many bytes of a row count."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 1 << 16):
        a, b = rows[at - 1 : at - 1 + (1 << 16)], rows[at : at + (1 << 16)]
        a = a[: len(b)]
        differ = a != b
        place = differ.argmax(axis=1)
        place[~differ.any(axis=1)] = rows.shape[1]
        out[at : at + len(b)] = np.minimum(place, np.minimum(left[at - 1 : at - 1 + len(b)], left[at : at + len(b)]))
    return out


def maximal_repeats(prefix: list[int], before: list[int], ids: list[int], length: int) -> list[tuple[int, int, int, int]]:
    """(common bytes, first, last, smallest id) of the intervals of the common-prefix tree of at least `length` bytes whose left bytes differ.

    prefix[i] is the common prefix of suffixes i - 1 and i; before[i] is the byte to the left of suffix i, -1 where there is none.
    One pass with a stack of open intervals; a closed interval hands its smallest id and its left bytes to the one around it.
    """
    found: list[tuple[int, int, int, int]] = []
    stack: list[list[int]] = []  # common bytes, first, smallest id, left byte (-1: they differ)
    n = len(ids)
    for i in range(1, n + 1):
        here = prefix[i] if i < n else 0
        first, least, byte = i - 1, ids[i - 1], before[i - 1]
        while stack and stack[-1][0] > here:
            common, first, low, left = stack.pop()
            least = min(least, low)
            byte = byte if byte == left else -1
            if byte == -1:
                found.append((common, first, i - 1, least))
        if here >= length:
            if stack and stack[-1][0] == here:
                top = stack[-1]
                top[2] = min(top[2], least)
                if top[3] != byte:
                    top[3] = -1
            else:
                stack.append([here, first, least, byte])
    return found


def _lower(least: np.ndarray, twice: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: np.ndarray, owner: np.ndarray, length: int) -> None:
    """Sort the suffixes that start at these windows, scan them, and lower `least` for every occurrence of every maximal repeat."""
    place = at[twice]
    left = stops[which] - place
    width = -(-int(left.max()) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)[place]
    rows[np.arange(width, dtype=narrow(np.array([width])).dtype) >= left[:, None]] = 0
    words = rows.view(">u8")
    order = np.lexsort((left, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
    prefix = common_prefixes(rows[order], left[order])
    before = np.where(place == starts[which], -1, data[np.maximum(place - 1, 0)].astype(np.int64))
    repeats = maximal_repeats(prefix.tolist(), before[order].tolist(), owner[which][order].tolist(), length)
    number = twice[order]
    if not repeats:
        return
    found = np.array(repeats, np.int64)
    lowered = np.cumsum((found[:, 2] - found[:, 1] + 1) * (found[:, 0] - length + 1))
    begin = 0
    while begin < len(found):
        end = max(begin + 1, int(np.searchsorted(lowered, lowered[begin] + LOWERED)))
        common, first, last, low = found[begin:end].T
        times = last - first + 1
        occurrence = np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)
        reach, low = np.repeat(common - length + 1, times), np.repeat(low, times)
        inside = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        np.minimum.at(least, np.repeat(number[occurrence], reach) + inside, np.repeat(low, reach))
        begin = end


def least_ids(strings: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest id that holds each window of each distinct string, one after the other; where each string's windows begin, and how many it has."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    windows = sizes - length + 1
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings), np.uint8)
    offset = np.cumsum(windows) - windows
    at = np.arange(windows.sum()) + np.repeat(starts - offset, windows)
    least = np.repeat(owner, windows)
    hashes = np.empty(len(at), np.uint64)
    for begin in range(0, len(data), PIECE):
        mine = slice(*np.searchsorted(at, (begin, begin + PIECE)))
        if mine.stop > mine.start:
            hashes[mine] = string_hashes(data[begin : begin + PIECE + length - 1], length)[at[mine] - begin]
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    groups = np.flatnonzero(new)
    times = np.diff(np.append(groups, len(order)))
    twice = order[np.repeat(times > 1, times)]  # window numbers by hash; the others occur in one string alone
    ends = np.cumsum(times[times > 1])
    # equal windows stand together, so the array can be sorted and scanned in parts that end between groups
    begin = 0
    while begin < len(twice):
        end = int(ends[min(np.searchsorted(ends, begin + SUFFIXES), len(ends) - 1)])
        _lower(least, twice[begin:end], at, data, starts, starts + sizes, np.searchsorted(offset, twice[begin:end], "right") - 1, owner, length)
        begin = end
    return least, offset, windows


def _answer_contexts(length: int):
    def answer(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        owner: list[int] = []
        sent: list[tuple[int, np.ndarray]] = []
        order = np.argsort(table["block"].to_numpy())
        for block, strings, sizes, least in zip(*(table[n].take(pa.array(order)).to_pylist() for n in ("block", "a", "b", "c")), strict=True):
            sizes = np.frombuffer(sizes, np.uint32)
            ends = np.cumsum(sizes.astype(np.int64))
            strings, least = opened(strings, int(ends[-1])), np.frombuffer(opened(least, 8 * len(sizes)), np.int64)
            numbers = np.empty(len(sizes), np.int64)
            for k, (a, b, low) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), least.tolist(), strict=True)):
                at = known.setdefault(strings[a:b], len(owner))
                if at == len(owner):
                    owner.append(low)
                elif low < owner[at]:
                    owner[at] = low
                numbers[k] = at
            sent.append((block, numbers))
        least, offset, windows = least_ids(list(known), np.array(owner, np.int64), length)
        # equal neighbours inside a string as one: (windows, id) pairs
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[offset] = True
        cut_at = np.flatnonzero(new)
        spans = np.diff(np.append(cut_at, len(least)))
        first = np.searchsorted(cut_at, offset)
        pairs = np.searchsorted(cut_at, offset + windows) - first
        number = np.concatenate([x for _, x in sent])
        times = pairs[number]
        at = np.arange(times.sum()) + np.repeat(first[number] - (np.cumsum(times) - times), times)
        ends = np.append(0, np.cumsum(times))[np.cumsum([len(x) for _, x in sent])]
        owner, first = least[cut_at[at]], np.append(0, ends[:-1])
        owners = pa.array([squeezed(owner[a:b].tobytes()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())
        return messages(group[0].as_py(), np.array([block for block, _ in sent]), CONTEXTS, cut(spans[at].astype(np.uint32), ends), owners)

    return answer


def _cut(buckets: int, length: int, names: list[str], with_text: bool):
    def cut_out(group: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        table, ids, texts = rows_of(table)
        c = Contexts(ids, texts, _codes(answers), length, buckets)
        flat: list[np.ndarray] = []
        base: dict[int, np.ndarray] = {}
        size = 0
        mine = answers.filter(pa.array(answers["kind"].to_numpy() == CONTEXTS))
        for bucket, spans_of, least in zip(*(mine[n].to_pylist() for n in ("bucket", "a", "b")), strict=True):
            if bucket in c.entries:
                spans_of = np.frombuffer(spans_of, np.uint32)
                flat.append(np.repeat(np.frombuffer(opened(least, 8 * len(spans_of)), np.int64), spans_of))
                windows = np.fromiter(map(len, c.entries[bucket]), np.int64, len(c.entries[bucket])) - length + 1
                base[bucket] = size + np.cumsum(windows) - windows
                size += int(windows.sum())
        number, start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if size:
            low = np.concatenate(flat)
            begin = np.empty(len(c.entry), np.int64)
            for bucket, at in base.items():
                mine = c.bucket == bucket
                begin[mine] = at[c.entry[mine]]
            inside = np.arange(c.windows.sum()) - np.repeat(np.cumsum(c.windows) - c.windows, c.windows)
            owner = np.repeat(c.number, c.windows)
            gone = low[np.repeat(begin, c.windows) + inside] < ids[owner]
            number, start = owner[gone], (np.repeat(c.first, c.windows) + inside)[gone]
            order = np.lexsort((start, number))
            number, start = number[order], start[order]
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (start[1:] > start[:-1] + length)
        at = np.flatnonzero(new)
        spans: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(number[at].tolist(), start[at].tolist(), (start[np.append(at[1:], len(start)) - 1] + length).tolist() if len(at) else [], strict=True):
            spans.setdefault(i, []).append((a, b))
        mine = [spans.get(i, []) for i in range(len(texts))]
        columns = {n: table[f"in_{i}"] for i, n in enumerate(names)}
        if with_text:
            columns["kept_text"] = pa.array([None if known is None else kept(text, s, True).decode("utf-8", "replace") for known, text, s in zip(table["text"].to_pylist(), texts, mine, strict=True)], pa.string())
        columns["n_bytes"] = pa.array([len(t) for t in texts], pa.int64())
        columns["spans"] = pa.array([[{"first": a, "end": b} for a, b in s] for s in mine], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
        columns["kept_sha256"] = pa.array([hashlib.sha256(kept(t, s)).hexdigest() for t, s in zip(texts, mine, strict=True)], pa.string())
        return pa.table(columns)

    return cut_out


def kept(text: bytes, spans: list[tuple[int, int]], whole_letters: bool = False) -> bytes:
    """What the spans leave. whole_letters: letters of several bytes stay or go whole; one that a span holds in part stays."""
    out, at = [], 0
    for a, b in spans:
        if whole_letters:
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
        out.append(text[at:a])
        at = max(a, b)
    out.append(text[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """docs without text (with_text: kept_text, cut at whole letters) plus n_bytes, spans (first, end) in bytes and kept_sha256 of the bytes left."""
    if not 0 < length <= LONGEST:
        raise ValueError(f"length must be from 1 to {LONGEST}")
    made = {"kept_text", "n_bytes", "spans", "kept_sha256"}
    names = [c for c in docs.columns if c.lower() not in made and c.lower() != "text"]
    blocks, buckets = counts(docs)
    by_block = blocked(docs, names, blocks)
    keys = by_block.applyInArrow(_send_keys(buckets, length), MESSAGE)
    codes = keys.groupBy("bucket").applyInArrow(_answer_keys, MESSAGE)
    contexts = by_block.cogroup(codes.groupBy("block")).applyInArrow(_send_contexts(buckets, length), MESSAGE)
    answers = codes.unionByName(contexts.groupBy("bucket").applyInArrow(_answer_contexts(length), MESSAGE))
    schema = docs.select(*[F.col(f"`{c}`") for c in names])
    if with_text:
        schema = schema.withColumn("kept_text", F.lit(None).cast("string"))
    schema = schema.withColumns({"n_bytes": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<struct<first:long,end:long>>"), "kept_sha256": F.lit("")}).schema
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_cut(buckets, length, names, with_text), schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def reference(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple[int, int, int, str]]:
    """Brute force for tests: (n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), int(spans), hashlib.sha256(left).hexdigest()))
    return out


LAST = float("inf")
