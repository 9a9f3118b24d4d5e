"""Near copies against a plain version, and what their steps hold and send."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import blocks, near_copies


def texts(seed, groups):
    """Groups of one to fourteen near copies, many of which share a passage, and exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    shared = " ".join(word() for _ in range(12))
    out = []
    for _ in range(groups):
        words = [word() for _ in range(r.randrange(30, 90))]
        if r.random() < 0.5:
            words += shared.split()
        for _ in range(r.choice([1, 1, 2, 3, 14])):
            mine = list(words)
            for _ in range(r.randrange(3)):
                mine[r.randrange(len(mine))] = word()
            out += [" ".join(mine)] * r.choice([1, 1, 1, 2])
    return out


def plain(docs):
    sets = [set(near_copies.shingles(t, 5).tolist()) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, find(i)) for i in range(len(docs))}


def test_all_links_with_many_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SENT", 7)
    monkeypatch.setattr(near_copies, "BLOCK_KEYS", 200)
    monkeypatch.setattr(near_copies, "BUCKET_KEYS", 300)
    docs = texts(5, 25)
    want = plain(docs)
    assert len({c for _, c in want}) < len(docs)
    got = near_copies.near_copies(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3))
    assert {(x.doc_id, x.component_id) for x in got.collect()} == want


def test_rows_that_meet(spark):
    docs = spark.createDataFrame(list(enumerate(texts(6, 20))), "doc_id long, text string")
    marked = near_copies.materialize(near_copies.marked(docs, 5, (4, 5)).withColumn("row_", F.monotonically_increasing_id()))
    first = marked.groupBy("set_id").agg(F.min("row_").alias("row_"))
    got = near_copies._rows_that_meet(marked, first, 3000).select("h", "set_id", "pos", "n", "b2").collect()
    leads = marked.dropDuplicates(["set_id"]).select("set_id", F.posexplode("lead").alias("pos", "h"), "n", "b2")
    meet = leads.join(leads.groupBy("h").count().where("count > 1"), "h").select("h", "set_id", "pos", "n", "b2").collect()
    assert sorted(got) == sorted(meet)


def test_wanted_texts_travel_alone(spark, monkeypatch):
    """More wanted texts than are broadcast at once used to send all texts through an exchange."""
    monkeypatch.setattr(near_copies, "SENT", 10)
    rows = near_copies.materialize(spark.range(0, 200, 1, 4).select(F.monotonically_increasing_id().alias("row_"), F.col("id").alias("set_id"), F.col("id").cast("string").alias("text")))
    found = near_copies._texts(rows, rows.where("set_id % 4 = 0").select("row_"))
    assert sorted(int(x.text) for x in found.collect()) == list(range(0, 200, 4))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_leading_shingles_are_looked_up_in_few_bytes():
    """Each shingle used to travel with its set's id, size and bitmap: some 60 bytes."""
    r = np.random.RandomState(3)
    leads = [np.unique(r.randint(-(2**63), 2**63, 400, dtype=np.int64)) for _ in range(500)]
    table = pa.table({"row_": np.arange(500), "lead": pa.array(leads, pa.list_(pa.int64()))})
    sent = near_copies._send_keys(16)((pa.scalar(0),), table, pa.table({"bucket": np.arange(500)}))
    data = b"".join(x for n in ("a", "b") for x in sent[n].to_pylist())
    assert len(pa.compress(data, codec="lz4", asbytes=True)) < 4 * 400 * 500


def test_steps_come_back():
    r = np.random.RandomState(4)
    for most in (1, 200, 2**20, 2**40, 2**63):
        steps = r.randint(0, most, 1000, dtype=np.int64).astype(np.uint64)
        ends = np.array([1, 5, 600, 1000])
        width, column = blocks.cut_steps(steps, ends)
        got, sizes = blocks.joined_steps(pa.chunked_array([column]), width)
        assert (got == steps).all() and sizes.tolist() == [1, 4, 595, 400]


def test_long_texts_that_differ_are_told_apart_without_their_texts(spark):
    """256 bits of parity allowed every pair of sets of over some 600 shingles, whose texts then travelled: the stage grew faster than its input."""
    r = np.random.RandomState(6)
    base = r.randint(-(2**63), 2**63, 1500, dtype=np.int64).view(np.uint64)
    other = lambda n: r.randint(-(2**63), 2**63, n, dtype=np.int64).view(np.uint64)
    sets = [np.unique(x) for x in (base, np.concatenate([base[100:], other(100)]), np.concatenate([base[750:], other(750)]), other(1800), np.concatenate([base, other(700)]))]
    for x in sets:
        for y in sets:
            bits = np.arange(min(len(near_copies.parity_of(x)), len(near_copies.parity_of(y))) * 8)
            odd = [np.bincount((z % np.uint64(len(bits))).astype(np.int64), minlength=len(bits)) & 1 for z in (x, y)]
            apart = near_copies.parities_apart(near_copies.parity_of(x), near_copies.parity_of(y))
            assert apart == (odd[0] != odd[1]).sum() <= len(np.setxor1d(x, y))
    first = spark.createDataFrame([(i, len(x), near_copies.parity_of(x)) for i, x in enumerate(sets)], "set_id long, n int, parity binary")
    pairs = spark.createDataFrame([(0, b) for b in range(1, 5)], "a long, b long")
    assert [tuple(x) for x in near_copies._plausible(pairs, first, (4, 5)).collect()] == [(0, 1)]
