"""Operators against plain versions on small inputs."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import curriculum, decontaminate, lm_score, simhash, suffix_repeats, topk


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@given(st.one_of(st.none(), st.text(alphabet="aAbBéÉ \n\t\x0b .", max_size=60)))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_gray_index_finds_all_pairs():
    r = np.random.RandomState(0)
    centers = r.randint(0, 2**62, 40).astype(np.uint64)
    near = np.concatenate([centers ^ (np.uint64(1) << r.randint(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << r.randint(0, 64, 40).astype(np.uint64)) for _ in range(30)] + [centers])
    codes = np.unique(near)
    q, found = simhash.GrayIndex(codes).search(codes, 2)
    index = simhash.GrayIndex(codes).codes
    got = {(int(codes[a]), int(index[b])) for a, b in zip(q, found, strict=True)}
    want = {(int(a), int(b)) for a in codes for b in codes[np.bitwise_count(codes ^ a) <= 2]}
    assert got == want


def test_components_on_planted_links(spark):
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(200)]
    for i in range(0, 150, 3):  # chains of steps of two bits, and exact copies
        fps[i + 1] = fps[i] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        fps[i + 2] = fps[i + 1] ^ (1 << r.randrange(64))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in set(signed)], "fp long"), 2)
    label = {x.node: x.label for x in simhash.components(edges).collect()}
    root = list(range(200))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(200):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(find(i), set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def passages(seed, n):
    """Texts with copies, shared passages, periods and letters of several bytes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 5)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(0, 25)))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(shared)[r.randrange(10) :], " ".join(word() for _ in range(r.randrange(6)))]
        out.append((i // 2 if i % 7 == 0 else i, " ".join(parts)))
    out += [(n, "ab" * 90), (n + 1, "ab" * 70), (n + 2, "x" * 49), (n + 3, "x" * 49), (n + 4, "x" * 50), (n + 5, "x" * 50), (n + 6, None), (None, shared[0]), (n + 7, ""), out[3], (n + 8, "\0" * 60), (n + 9, "\0" * 55 + "a")]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, monkeypatch, seed):
    if seed == 2:  # single windows for all that is shared by more than two documents
        monkeypatch.setattr(suffix_repeats, "HOT_DOCUMENTS", 2)
    rows = passages(seed, 60)
    hot = suffix_repeats.HOT_DOCUMENTS
    got = run_repeats(rows, 3) if seed == 2 else [tuple(r) for r in suffix_repeats.digest(suffix_repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()]
    want = [(i, *x) for (i, _), x in zip(rows, suffix_repeats.reference(rows), strict=True)]
    assert Counter(got) == Counter(want), hot


def run_repeats(rows, blocks, length=50):
    """The phases without Spark, so that the bound for hot groups can be set."""
    from tessera.llm.blocks import no_messages

    dealt = {b: pa.table({"in_0": pa.array([r[0] for i, r in enumerate(rows) if i % blocks == b], pa.int64()), "doc_id": pa.array([r[0] for i, r in enumerate(rows) if i % blocks == b], pa.int64()), "text": pa.array([r[1] for i, r in enumerate(rows) if i % blocks == b], pa.string())}) for b in range(blocks)}
    gather = lambda tables, by: {k: t.filter(pa.compute.equal(t[by], k)) for t in [pa.concat_tables([*tables, no_messages()])] for k in t[by].unique().to_pylist()}
    key = lambda k: (pa.scalar(k),)
    import pyarrow.compute  # noqa: F401

    codes = [suffix_repeats._answer_keys(key(k), t) for k, t in gather([suffix_repeats._send_keys(blocks, length)(key(b), t) for b, t in dealt.items()], "bucket").items()]
    none = no_messages()
    by_block = gather(codes, "block")
    sent = [suffix_repeats._send_contexts(blocks, length)(key(b), t, by_block.get(b, none)) for b, t in dealt.items()]
    answers = [suffix_repeats._answer_contexts(length)(key(k), t) for k, t in gather(sent, "bucket").items()]
    by_block = gather([*codes, *answers], "block")
    out = []
    for b, t in dealt.items():
        for r in suffix_repeats._cut(blocks, length, ["doc_id"], False)(key(b), t, by_block.get(b, none)).to_pylist():
            out.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["first"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]))
    return out


def test_maximal_repeats_have_all_occurrences():
    """Every interval of the scan is a string whose occurrences are exactly its suffixes, extended as far as it goes to both sides."""
    text = b"xabcabcdyabcdzabc"
    suffixes = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), 0)
    prefix = [0] + [common(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    found = suffix_repeats.maximal_repeats(prefix, [text[i - 1] if i else -1 for i in suffixes], suffixes, 2)
    got = {text[suffixes[a] : suffixes[a] + n]: sorted(suffixes[a : b + 1]) for n, a, b, _ in found}
    want = {}
    for i in range(len(text)):
        for j in range(i + 2, len(text) + 1):
            s = text[i:j]
            at = [k for k in range(len(text)) if text.startswith(s, k)]
            left, right = {text[k - 1] if k else -1 - k for k in at}, {text[k + len(s)] if k + len(s) < len(text) else -1 for k in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[s] = at
    assert got == want


def test_cutting_keeps_letters_whole():
    text = "aé😀b".encode()
    assert suffix_repeats.kept(text, [(2, 5)], True).decode() == "aé😀b"
    assert suffix_repeats.kept(text, [(1, 7)], True).decode() == "ab"


@pytest.mark.parametrize("length", [1, 7, 20, 128, 200, 300])
def test_repeats_of_any_length(length):
    rows = passages(4, 40) + [(90, "abc" * 250), (91, "abc" * 240 + "d"), (92, "q" + "abc" * 200)]
    got = run_repeats(rows, 2, length)
    assert Counter(got) == Counter((i, *x) for (i, _), x in zip(rows, suffix_repeats.reference(rows, length), strict=True))


def test_lengths_that_are_refused(spark):
    for length in (0, suffix_repeats.LONGEST + 1):
        with pytest.raises(ValueError):
            suffix_repeats.without_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length)


def test_hot_block_values_are_split(spark, monkeypatch):
    r = random.Random(2)
    base = r.getrandbits(64)
    fps = {base ^ (r.getrandbits(13) << 3) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    monkeypatch.setattr(simhash, "HOT", 20)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows, _ = simhash.grouped(spark.createDataFrame([(f,) for f in signed], "fp long"), 2)
    assert rows.count() > 3 * len(fps)
    label = {x.node: x.label for x in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2)).collect()}
    near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    s = lambda f: f - (1 << 64) if f >> 63 else f
    of = lambda f: label.get(s(f), s(f))  # noqa: E731  the centre of a star has no row of its own
    assert len(near) > 20 and all(of(a) == of(b) for a, b in near)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in near:
        root[find(a)] = find(b)
    assert len({of(f) for f in fps}) == len({find(f) for f in fps})


def test_simhash_end_to_end(spark):
    """Ids, hexadecimal digits and components of the query against a plain version, with a null id, nulls and repeated rows."""
    r = random.Random(8)
    words = [" ".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(12)]
    docs = [(i, words[i % 12]) for i in range(30)] + [(40, words[0] + " x"), (41, None), (42, ""), (42, ""), (None, words[3]), (50, "lone text of its own")]
    got = simhash.digest(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    fps = [plain_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    want = [(i, f"{fp:016x}", min(d for (d, _), x in zip(docs, root, strict=True) if x == k and d is not None)) for (i, _), fp, k in zip(docs, fps, root, strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_messages_grow_with_the_keys():
    """A block never sends more messages than it has keys, however many buckets there are."""
    from tessera.llm import lm_score

    docs = pa.table({"doc_id": pa.array([1], pa.int64()), "text": pa.array([" ".join(f"w{i}" for i in range(500))])})
    sent = {buckets: lm_score._send(3, buckets, 60)((pa.scalar(0),), docs).num_rows - 1 for buckets in (10, 1000, 10**6, 10**8)}
    assert sent[10] == 10 and sent[10**6] <= sent[10**8] <= 500 + 499 + 498


def test_top_k_beyond_every_bound(spark):
    r = random.Random(9)
    cases = [
        [(i, [1e9 + i % 7, 0.5]) for i in range(45)],
        [(i, [r.choice([1.0, 3e8, -2e8, 1e15, -1e18, 1e30, 7.0]), r.uniform(-1, 1), 3e12 * r.random()]) for i in range(90)],
        [(i, [r.choice([1e200, -1e200, 3e200, 1.0]), r.uniform(-1e5, 1e5)]) for i in range(60)],
    ]
    for rows in cases:
        whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
        want = []
        for i, v in whole:
            if i % 20 == 0:
                scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in whole if i != j)
                want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scores[:20])]
        got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
        assert got == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_top_k(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1.0, 0.3, 0.5, 0.72]) for _ in range(3)]) for i in range(150)] + [(20, [0.5, 0.5, 0.5]), (151, [0.1, 0.2]), (160, [0.1, 0.3])]
    if seed:
        rows += [(200 + i, [3e8, 2e8, 1.0 * i]) for i in range(0, 60, 3)]
    got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = []
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    for a, (i, v) in enumerate(whole):
        if i % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(whole) if a != b and len(v) == len(w))
            want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scores[:20])]
    assert got == sorted(want)


word = st.sampled_from(["a", "B", "c1", "é", "É", "d"])
phrase = st.lists(word, max_size=40).map(lambda w: " ,".join(w))


@given(st.lists(phrase, max_size=6), st.lists(phrase, max_size=5), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_wu_manber(docs, items, window):
    named = [(str(i // 2), x) for i, x in enumerate(items)]
    searches = decontaminate.build(named, window)
    for text in docs:
        words = decontaminate.words_of(text)
        hit, found = set(), set()
        for s in searches:
            if len(words) >= s.length:
                for first, ids in s.occurrences(words):
                    hit.update(range(first, first + s.length))
                    found.update(ids)
        want = decontaminate.reference(text, named, window)
        assert (len(words), len(hit), len(found)) == want[:3]


def test_many_shards_give_the_same(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    docs = spark.createDataFrame([(i, text(300)) for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, text(9)) for i in range(30)] + [(99, "a b"), (98, text(40))], "item_id long, text string")
    once = sorted(map(tuple, decontaminate.digest(decontaminate.scan(docs, bench, 4)).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    monkeypatch.setattr(decontaminate, "PIECE", 3)
    assert sorted(map(tuple, decontaminate.digest(decontaminate.scan(docs, bench, 4)).collect())) == once


def test_mixing_meets_targets(spark):
    r = random.Random(2)
    docs = [(i, "w " * r.randrange(0, 60), None if i % 11 == 0 else f"s{min(i % 23, 5)}") for i in range(600)]
    out = curriculum.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for s in {x.source for x in out}:
        mine = [x for x in out if x.source == s]
        assert sum(x.taken for x in mine) == math.floor(mine[0].target)
        assert mine[0].target <= 3 * mine[0].source_size
    assert all(x.taken <= 3 * x.size and x.taken == sum(c["words"] for c in x.schedule) and all(0 <= c["position"] <= 1 for c in x.schedule) for x in out)
    assert abs(sum({x.source: x.target for x in out}.values()) - sum(x.size for x in out)) < 1e-6
    order = [x.position for x in curriculum.training_order(curriculum.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string"))).collect()]
    assert order == sorted(order) and len(order) > 300


def test_weights_change_over_time(spark):
    docs = [(i, "w w w w", f"s{i % 3}") for i in range(900)]
    order = curriculum.training_order(curriculum.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string"))).collect()
    early, late = Counter(x.source for x in order[: len(order) // 4]), Counter(x.source for x in order[-len(order) // 4 :])
    assert early["s0"] > 1.5 * late["s0"] and late["s2"] > 1.5 * early["s2"]


def test_stupid_backoff(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("abcde") for _ in range(r.randrange(0, 30)))) for i in range(25)] + [(99, None)]
    got = {x.doc_id: x.log_score for x in lm_score.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    split = [(i, (t or "").split()) for i, t in docs]
    for i, w in split:
        rest = [v for j, v in split if j != i]
        count = Counter(tuple(v[a : a + n]) for v in rest for n in (1, 2, 3) for a in range(len(v) - n + 1))
        total, want = sum(map(len, rest)), 0.0
        for p in range(len(w)):
            n, factor = min(3, p + 1), 1.0
            while n > 1 and not (count[tuple(w[p - n + 1 : p + 1])] and count[tuple(w[p - n + 1 : p])]):
                n, factor = n - 1, factor * 0.4
            top = count[tuple(w[p - n + 1 : p + 1])]
            want += math.log(factor * (top / count[tuple(w[p - n + 1 : p])] if n > 1 else (top or 0.5) / total))
        assert got[i] == pytest.approx(want)
