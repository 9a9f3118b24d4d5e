"""Entity resolution: average-linkage clusters of names by cosine distance, and canonical names of the clusters.

The mean cosine distance of two clusters is one less the product of their mean unit vectors, so a cluster is its mean vector and its weight, and no table of distances is
kept. Average linkage never brings a merged cluster nearer to a third one than its parts were; so pairs that are nearest to each other may merge at once and in any order,
and a cluster whose nearest one is not below the threshold is finished. Equal vectors merge first in any case, so they count as one with their number as weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

THRESHOLD = 0.5
BLOCK_ROWS = 2048
#: Vectors of a side of a cell of the grid, and clusters that one task finishes.
CELL_ROWS, LOCAL_ROWS = 16384, 16384
#: Distances that differ by less count as equal; ties go to the smallest id.
TIE = 1e-12


def close_links(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links that connect the same sets as all pairs with a cosine distance below the threshold. vectors: id, vec. Blocks of bounded size meet each other once,
    and a meeting leaves at most one link for each of its vectors."""
    n = vectors.count()
    blocks = max(1, -(-n // block_rows))
    rows = materialize(vectors.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    low = rows.withColumn("other", F.explode(every)).where("other >= block").select(F.col("block").alias("i"), F.col("other").alias("j"), F.col("id").alias("id"), F.col("vec").alias("vec"))
    high = rows.withColumn("other", F.explode(every)).where("other <= block").select(F.col("other").alias("i"), F.col("block").alias("j"), F.col("id").alias("id"), F.col("vec").alias("vec"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        def unit(t: pa.Table) -> np.ndarray:
            flat = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            m = flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        x, y = np.nonzero(1.0 - unit(left) @ unit(right).T < threshold)
        least_a, least_b = a.copy(), b.copy()
        while True:  # the smallest id that is linked, from side to side until nothing falls
            before = (least_a.copy(), least_b.copy())
            np.minimum.at(least_b, y, least_a[x])
            np.minimum.at(least_a, x, least_b[y])
            if (before[0] == least_a).all() and (before[1] == least_b).all():
                break
        ids, to = np.concatenate([a, b]), np.concatenate([least_a, least_b])
        pairs = np.unique(np.stack([to, ids], 1)[ids != to], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return low.groupBy("i", "j").cogroup(high.groupBy("i", "j")).applyInArrow(meet, "a long, b long")


def connected(pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id each linked id reaches. Labels halve their distance each round by following their own label's label."""
    links = materialize(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = materialize(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("n"))
        lower = labels.join(near, "id").select("id", F.least("component", "n").alias("component"))
        jump = lower.join(labels.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"))
        after = materialize(jump)
        moved = after.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").limit(1).count()
        labels = after
        if not moved:
            return labels


def average_linkage(distances: np.ndarray, threshold: float, weights: list[int] | None = None) -> list[int]:
    """For each row the first row of its cluster, by repeatedly merging the two clusters of least mean distance while it is below the threshold; ties go to the first pair.
    weights: how many equal points a row stands for."""
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = [1] * len(d) if weights is None else list(weights)
    members = {i: [i] for i in range(len(d))}
    while len(members) > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        members[i] += members.pop(j)
        size[i] += size[j]
    out = [0] * len(d)
    for rows in members.values():
        for r in rows:
            out[r] = min(rows)
    return out


def chain_linkage(means: np.ndarray, weights: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the first row of its cluster, as `average_linkage` has it, by a chain of nearest neighbours: a few products of all means with one for each merge, and no
    more memory than the means."""
    m, w, at, root = means.astype(float), weights.astype(float), np.arange(len(means)), np.arange(len(means))
    far = np.ones(len(m))  # infinite for rows that are merged or finished
    left, start, chain = len(m), 0, []
    while True:
        if not chain:
            while start < len(at) and np.isinf(far[start]):
                start += 1
            if start == len(at):
                break
            chain = [start]
        i = chain[-1]
        d = far - m @ m[i]
        d[i] = np.inf
        least = d.min()
        if not least < threshold:
            far[i] = np.inf
            chain.pop()
        elif (j := int((d <= least + TIE).argmax())) not in chain:
            chain.append(j)
            continue
        else:
            a, b = sorted((i, chain[-2]))
            m[a], w[a] = (w[a] * m[a] + w[b] * m[b]) / (w[a] + w[b]), w[a] + w[b]
            far[b], root[at[b]] = np.inf, at[a]
            del chain[-2:]
        left -= 1
        if left * 2 < len(at):
            kept = ~np.isinf(far)
            place = np.cumsum(kept) - kept
            chain, start = [int(place[c]) for c in chain], int(place[start])
            m, w, at, far = m[kept], w[kept], at[kept], far[kept]
    for i in range(len(root)):
        root[i] = root[root[i]]
    return root


def _rows(t: pa.Table) -> np.ndarray:
    return t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def nearest(asked: DataFrame, all_: DataFrame) -> DataFrame:
    """(id, near, dist): the nearest other row of all_ for each asked one. Both: id, vec. Groups of CELL_ROWS at most meet in a grid, and a meeting leaves a row for each asked one."""
    q_groups, groups = (max(1, -(-df.count() // CELL_ROWS)) for df in (asked, all_))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    left = asked.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(q_groups)).alias("r"), every(groups).alias("c"))
    right = all_.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("c"), every(q_groups).alias("r"))

    def meet(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        d = d.sort_by("id")
        ids, m, asked_ids, asked_m = d["id"].to_numpy(), _rows(d).T.copy(), q["id"].to_numpy(), _rows(q)
        near, dist = np.empty(len(asked_ids), np.int64), np.empty(len(asked_ids))
        step = max(1, (1 << 21) // len(ids))
        for k in range(0, len(asked_ids), step):
            part = 1.0 - asked_m[k : k + step] @ m
            own = np.minimum(np.searchsorted(ids, asked_ids[k : k + step]), len(ids) - 1)
            same = np.nonzero(ids[own] == asked_ids[k : k + step])[0]
            part[same, own[same]] = np.inf
            least = part.min(1)
            dist[k : k + step], near[k : k + step] = least, ids[(part <= least[:, None] + TIE).argmax(1)]
        found = np.isfinite(dist)
        return pa.table({"id": asked_ids[found], "near": near[found], "dist": np.round(dist[found], 12)})

    cells = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(meet, "id long, near long, dist double")
    return cells.groupBy("id").agg(F.min(F.struct("dist", "near")).alias("best")).select("id", "best.near", "best.dist")


def _merge_round(state: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(the clusters that go on, (kept, gone) of the merges). state: id, vec, weight, near, dist; near is null where it is not known. All pairs that are nearest to each other merge."""
    found = nearest(state.where("near is null"), state).toDF("id", "n", "d")
    open_ = materialize(state.join(found, "id", "left").select("id", "vec", "weight", F.coalesce("near", "n").alias("near"), F.coalesce("dist", "d").alias("dist")).where(F.col("dist") < threshold))
    ends = open_.select(F.col("id").alias("gone"), F.col("near").alias("back"))
    pairs = open_.select("id", "near", "dist").join(ends, F.col("near") == F.col("gone"))
    mutual = materialize(pairs.where("back = id and id < near").select(F.col("id").alias("kept"), "gone"))
    if mutual.isEmpty():  # only rounding can do that: the closest pair goes first
        mutual = materialize(pairs.orderBy("dist", "id", "near").limit(1).select(F.least("id", "near").alias("kept"), F.greatest("id", "near").alias("gone")))
    other = open_.select(F.col("id").alias("gone"), F.col("vec").alias("v"), F.col("weight").alias("w"))
    both = open_.select(F.col("id").alias("kept"), "vec", "weight").join(mutual, "kept").join(other, "gone")
    mean = F.zip_with("vec", "v", lambda x, y: (F.col("weight") * x + F.col("w") * y) / (F.col("weight") + F.col("w")))
    new = both.select(F.col("kept").alias("id"), mean.alias("vec"), (F.col("weight") + F.col("w")).alias("weight"), F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("dist"))
    touched = mutual.select(F.explode(F.array("kept", "gone")).alias("id"))
    rest = open_.join(touched, "id", "left_anti").join(touched.select(F.col("id").alias("near"), F.lit(True).alias("moved")), "near", "left")
    kept = rest.select("id", "vec", "weight", F.expr("if(moved, null, near)").alias("near"), F.expr("if(moved, null, dist)").alias("dist"))
    return materialize(new.unionByName(kept)), mutual


def clusters(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, cluster): cluster is the smallest id of its members; every id is in one, alone if nothing is near or it has no vector.

    Over LOCAL_ROWS clusters merge in rounds of a grid, in which only those look again whose nearest one has merged; what remains is finished by one task. The work is
    quadratic, as each vector's nearest one is needed; memory is bounded.
    """
    named = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    distinct = materialize(named.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    schema = "id long, vec array<double>, weight double, near long, dist double"

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if t.num_rows:
                m = _rows(t)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))
                none = pa.nulls(len(m), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), vec, batch.column(2).cast(pa.float64()), none, none.cast(pa.float64())], names=["id", "vec", "weight", "near", "dist"])

    state = materialize(distinct.select("id", "vec", "weight").mapInArrow(unit, schema))
    placed = distinct.select("id", F.col("id").alias("cluster"))
    n, before = state.count(), None
    # rounds that merge few are left to the one task, up to four times its usual number
    while n > LOCAL_ROWS and (n > 4 * LOCAL_ROWS or before is None or before - n > n // 20):
        before = n
        state, merges = _merge_round(state, threshold)
        placed = materialize(placed.join(merges.withColumnRenamed("gone", "cluster"), "cluster", "left").select("id", F.coalesce("kept", "cluster").alias("cluster")))
        n = state.count()

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table["id"].to_numpy()
        return pa.table({"cluster": ids, "root": ids[chain_linkage(_rows(table), table["weight"].to_numpy(), threshold)]})

    roots = state.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(finish, "cluster long, root long")
    settled = distinct.select("id", "vec").join(placed, "id").join(roots, "cluster", "left").select("vec", F.coalesce("root", "cluster").alias("cluster"))
    return named.join(settled, "vec", "left").groupBy("id").agg(F.coalesce(F.min("cluster"), F.col("id")).alias("cluster"))


def size_classes(found: DataFrame) -> DataFrame:
    """One row: clusters of one, of two, of three and more."""
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") == 1).alias("singles"), F.count_if(F.col("n") == 2).alias("pairs"), F.count_if(F.col("n") > 2).alias("larger"))


Adjudicator = Callable[[list[str]], dict[str, str]]


def rule_adjudicator(names: list[str]) -> dict[str, str]:
    """Everything merges into the shortest name, but names of a side stay what they are."""
    least = min(names, key=lambda n: (len(n), n))
    return {n: n if {"left", "right"} & set(n.lower().split()) else least for n in names}


def resolve(named: DataFrame, adjudicator: Adjudicator = rule_adjudicator) -> DataFrame:
    """(name, canonical) from (name, cluster): one name stands for itself, of two the shorter one, three and more go to the adjudicator.

    If the adjudicator fails, the shortest name stands for all; a name it leaves out stands for itself.
    """

    def decide(table: pa.Table) -> pa.Table:
        names = sorted(set(table["name"].to_pylist()))
        shortest = min(names, key=lambda n: (len(n), n))
        if len(names) > 2:
            try:
                target = adjudicator(names)
            except Exception:  # noqa: BLE001  a reply that can't be had or read
                target = dict.fromkeys(names, shortest)
        else:
            target = dict.fromkeys(names, shortest)
        return pa.table({"name": names, "canonical": [target.get(n, n) for n in names]})

    return named.where("name is not null").select("name", "cluster").groupBy("cluster").applyInArrow(decide, "name string, canonical string")


def new_names(triples: DataFrame, known: DataFrame) -> DataFrame:
    """(name): ends of triples that the canonical map doesn't have yet."""
    return triples.select(F.explode(F.array("source", "target")).alias("name")).distinct().join(known.select("name"), "name", "left_anti")


def encode(df: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """df with vec by an injected encoder, called once per batch."""

    @F.pandas_udf("array<double>")
    def vec(values: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encoder(values.tolist())])

    return df.withColumn("vec", vec(F.col(text)))


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """The offline stand-in for a sentence encoder: hashed character trigrams."""
    import zlib

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            padded = f"  {(t or '').lower()} "
            for j in range(len(padded) - 2):
                h = zlib.crc32(padded[j : j + 3].encode())
                out[i, h % dimensions] += 1 if h & 0x80000000 else -1
        return out.tolist()

    return run
