"""Exact top-k search by distributed histogram selection.

Scores of all (query, candidate) pairs are computed block by block and never stored. Each round makes a histogram of the scores
per query and merges those of all cells; the bin that holds the kth value is split again in the next round, until a bin is one
score wide and the kth score is known. A last pass keeps what lies above the kth score, and of those equal to it the smallest ids.

Cells are a grid of candidate groups by query groups, both of bounded size, so a cell's memory does not grow with the tables and
neither side is broadcast. A cell reports only the bins of its own k best scores (the global kth value is not below a
cell's) and, of the ties at the kth score, its k smallest ids; both bounds lose nothing.

Scores are exact whatever the components: pairs of short vectors go through one product of floats that can't round, longer ones through
products of 20-bit limbs. Histograms count codes, which are the scores themselves below TOP and keep their order beyond it; rows of equal code
beyond TOP are told apart by their exact scores. Only the column `score` is held to what a long can say.

Defined cases: vectors that are null, empty or hold null or non-finite components (also after scaling) take no part; vectors of unequal lengths
have no score; a query never meets its own row, but other rows with its id count as candidates like any other; fewer
candidates than k give all; equal scores go by id, rows of equal id in any order; an empty table gives an empty result; other input columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

CELL_ROWS, CELL_QUERIES = 16384, 4096
BLOCK_SCORES = 1 << 21
#: Bin widths of the rounds, as powers of two; the first is chosen from the scores' bound.
BITS_A_ROUND = 10
#: Scores below TOP are their own codes; a code beyond has the bit length and the next MANTISSA bits of the score.
TOP, TOP_BITS, MANTISSA = 1 << 61, 61, 49
LAST_CODE = TOP + (TOP >> 1)
LIMB, LIMB_COLUMNS = 20, 1 << 13
#: Two vectors of less than this length have a product that floats can't round.
SHORT = float(1 << 26)


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) for the vectors that take part."""
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < F.lit(float("inf"))))
    sound = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    # doubles from 2^53 on are whole; floor() would hold them to the range of a long
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < F.lit(float(1 << 53)), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return sound.select("vec_id", whole.alias("v"))


def code(score: int) -> int:
    """A number in (-LAST_CODE, LAST_CODE) that rises with the score, and is the score itself below TOP."""
    size = abs(score)
    if size < TOP:
        return score
    bits = size.bit_length()
    size = TOP + ((bits - 1 - TOP_BITS) << MANTISSA) + (size >> (bits - 1 - MANTISSA)) - (1 << MANTISSA)
    return size if score > 0 else -size


_codes = np.frompyfunc(code, 1, 1)
_whole = np.frompyfunc(int, 1, 1)


def _limbs(m: np.ndarray) -> list[np.ndarray]:
    """Arrays of floats that add up to m as digits of base 2^LIMB; the last one bears the sign."""
    rest = m.astype(np.int64) if np.abs(m).max(initial=0) < TOP else _whole(m)
    out = []
    while np.abs(rest).max(initial=0) >= 1 << LIMB:
        out.append((rest & ((1 << LIMB) - 1)).astype(float))
        rest = rest >> LIMB
    return [*out, rest.astype(float)]


def _exact_codes(queries: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    wide = not bound < TOP
    total = np.zeros((len(queries), len(rows)), object if wide else np.int64)
    for at in range(0, queries.shape[1], LIMB_COLUMNS):
        q, r = _limbs(queries[:, at : at + LIMB_COLUMNS]), _limbs(rows[:, at : at + LIMB_COLUMNS])
        for i, a in enumerate(q):
            for j, b in enumerate(r):
                part = (a @ b.T).astype(np.int64)
                # below TOP sums may wrap on the way: the result fits
                total += _whole(part) << LIMB * (i + j) if wide else part << np.int64(LIMB * (i + j)) if LIMB * (i + j) < 64 else 0
    return _codes(total).astype(np.int64) if wide else total


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The codes of all scores. What is long is set apart, so that it slows nothing else down."""
    with np.errstate(over="ignore"):
        size_q, size_r = (np.sqrt((side * side).sum(axis=1)) for side in (queries, rows))
    out = np.empty((len(queries), len(rows)), np.int64)
    for mine in (size_q < SHORT, size_q >= SHORT):
        for theirs in (size_r < SHORT, size_r >= SHORT):
            if mine.any() and theirs.any():
                bound = float(size_q[mine].max()) * float(size_r[theirs].max())
                q, r = queries[mine], rows[theirs]
                out[np.ix_(mine, theirs)] = (q @ r.T).astype(np.int64) if bound < 1 << 53 else _exact_codes(q, r, bound)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _blocks(left: pa.Table, right: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """(slice of queries, the codes of their scores against the cell's candidates)."""
    q, r = _matrix(left["v"]), _matrix(right["v"])
    step = max(1, BLOCK_SCORES // max(1, len(r)))
    if len(r):
        for at in range(0, len(q), step):
            yield slice(at, at + step), _scores(q[at : at + step], r)


def _others(left: pa.Table, right: pa.Table, part: slice) -> np.ndarray:
    """False where a candidate is the query's own row."""
    return left["row"].to_numpy()[part][:, None] != right["row"].to_numpy()[None, :]


def _bins(k: int, wide: int, fine: int):
    """Histogram of a cell: for each query the filled bins of width 2^fine above its base, of the cell's k best scores there."""

    def bins(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        rows_of, low = left["row"].to_numpy(), left["low"].to_numpy()
        for part, codes in _blocks(left, right):
            base = low[part][:, None]
            # as unsigned numbers, whose difference can't overflow
            above = codes.view(np.uint64) - base.view(np.uint64)
            inside = _others(left, right, part) & (codes >= base) & (above <= np.uint64((1 << wide) - 1))
            for i in range(len(codes)):
                got = above[i][inside[i]]
                if len(got) > k:
                    got = np.partition(got, len(got) - k)[len(got) - k :]
                b, m = np.unique(got >> np.uint64(fine), return_counts=True)
                out.append((np.full(len(b), rows_of[part][i]), b.astype(np.int64), m))
        return _table(out, ("row", "bin", "n"))

    return bins


FOUND = "row long, query_id long, vec_id long, code long, exact binary, score long"
EXACT_BYTES = 272


def _exact(q: np.ndarray, r: np.ndarray) -> int:
    return sum(int(a) * int(b) for a, b in zip(q.tolist(), r.tolist(), strict=True))


def _best(k: int):
    """The rows of a cell above each query's kth code, and the k best at that code: those of largest score, then of smallest id."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        beyond: list[bytes] = []
        rows_of, names, low, ids = (t[c].to_numpy() for t, c in ((left, "row"), (left, "query_id"), (left, "low"), (right, "vec_id")))
        q, r = _matrix(left["v"]), _matrix(right["v"])
        for part, codes in _blocks(left, right):
            valid = _others(left, right, part)
            for i in range(len(codes)):
                kth = low[part][i]
                above = np.flatnonzero(valid[i] & (codes[i] > kth))
                ties = np.flatnonzero(valid[i] & (codes[i] == kth))
                if len(ties) > k:
                    if abs(int(kth)) < TOP:
                        ties = ties[np.argpartition(ids[ties], k - 1)[:k]]
                    else:
                        ties = np.array(sorted(ties.tolist(), key=lambda j: (-_exact(q[part.start + i], r[j]), ids[j]))[:k], np.int64)
                take = np.concatenate([above, ties])
                mine = codes[i][take]
                score = mine.copy()
                exact = [b""] * len(take)
                for n in np.flatnonzero(np.abs(mine) >= TOP).tolist():
                    whole = _exact(q[part.start + i], r[take[n]])
                    exact[n] = (whole + (1 << 8 * EXACT_BYTES - 1)).to_bytes(EXACT_BYTES, "big")
                    score[n] = max(-(1 << 63), min((1 << 63) - 1, whole))
                beyond += exact
                out.append((np.full(len(take), rows_of[part][i]), np.full(len(take), names[part][i]), ids[take], mine, score))
        found = _table(out, ("row", "query_id", "vec_id", "code", "score"))
        return found.add_column(4, "exact", pa.array(beyond, pa.binary()))

    return best


def _table(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate([x[j] for x in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for j, c in enumerate(names)})


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by `every`."""
    rows = quantized(vectors, scale).withColumn("dim", F.size("v"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    asks = F.pmod("vec_id", F.lit(every)) == 0
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, n_queries, largest = (x or 0 for x in rows.agg(F.count("*"), F.count_if(asks), F.max(squares)).first())
    groups, q_groups = max(1, -(-n // CELL_ROWS)), max(1, -(-n_queries // CELL_QUERIES))
    cell_of = lambda name, many: F.pmod(F.xxhash64("row"), F.lit(many)).alias(name)
    right = rows.select("dim", "vec_id", "row", "v", cell_of("c", groups)).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_groups - 1).cast("long"))))
    # aliases give both sides columns of their own
    queries = rows.where(asks).select(F.col("dim").alias("dim"), F.col("vec_id").alias("query_id"), F.col("row").alias("row"), F.col("v").alias("v"), cell_of("r", q_groups))
    spread = lambda df: df.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    keys = ["dim", "c", "r"]
    # no score is beyond the square of the longest vector; rounding of that square is covered by the factor
    width = max(2, int(largest * 1.001).bit_length() + 2) if largest < TOP / 4 else TOP_BITS + 2
    base = -(1 << width - 1) if largest < TOP / 4 else -LAST_CODE
    known = queries.select("row", "query_id").withColumns({"low": F.lit(base).cast("long"), "need": F.lit(k).cast("long")})
    while width > 0:
        finer = max(0, width - BITS_A_ROUND)
        asked = spread(queries.join(known.select("row", "low"), "row"))
        partial = asked.select(*keys, "row", "low", "v").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_bins(k, width, finer), "row long, bin long, n long")
        totals = partial.groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("row").orderBy(F.desc("bin"))
        run = totals.withColumn("upto", F.sum("n").over(down)).join(known, "row")
        # the first bin from the top at which the running count reaches what is needed; with fewer candidates, the last one
        hit = run.groupBy("row", "query_id", "low", "need").agg(
            F.min(F.when(F.col("upto") >= F.col("need"), F.struct(-F.col("bin"), F.col("upto") - F.col("n")))).alias("at"), F.min("bin").alias("last"), F.max_by(F.col("upto") - F.col("n"), -F.col("bin")).alias("above"),
        )
        at_bin, above = F.coalesce(-F.col("at.col1"), F.col("last")), F.coalesce(F.col("at.col2"), F.col("above"))
        known = materialize(hit.select("row", "query_id", (F.col("low") + F.shiftleft(at_bin, finer)).alias("low"), (F.col("need") - above).alias("need")))
        width = finer

    asked = spread(queries.join(known.select("row", "low"), "row"))
    chosen = asked.select(*keys, "row", "query_id", "low", "v").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), FOUND)
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("code"), F.desc("exact"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
