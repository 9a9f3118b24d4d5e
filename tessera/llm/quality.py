"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits or runs of punctuation. N-grams of the tokens themselves and of their shapes (upper and
lower case, digits, punctuation; repeats folded) are hashed into 2^BITS features; a token that follows itself and a pair that has occurred
before in the text are n-grams of their own. A feature's value is the square root of its share of the text's tokens, and a score
is the sparse dot product with the weights, put through the logistic curve.

Training uses a bounded sample of labelled rows; documents are scored whole, where they are read. Defined cases: null and empty texts
have the bias alone; without labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, labelled

#: Bound of the training sample, in rows.
TRAINING_ROWS = 4000
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)
MEMO = 1 << 17
BIAS, SAME, AGAIN = 0, 1, 2
MIX = np.uint64(0x9E3779B97F4A7C15)


class Memo(dict):
    """token -> hash of the token in the high half, of its shape in the low half; emptied when it is full."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[token] = value = zlib.crc32(token) << 32 | zlib.crc32(RUN.sub(rb"\1+", token.translate(SHAPE)))
        return value


def _buckets(grams: np.ndarray, family: int) -> np.ndarray:
    return ((grams + np.uint64(family)) * MIX >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, ascending and distinct; values)."""
    tokens = TOKEN.findall(text.encode("utf-8", "surrogatepass")) if text else []
    if not tokens:
        return np.array([BIAS]), np.array([1.0])
    both = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    pair = word[:-1] * MIX + word[1:]
    shapes2 = shape[:-1] * MIX + shape[1:]
    shapes3 = shapes2[:-1] * MIX + shape[2:]
    found = [_buckets(word, 1), _buckets(pair, 2), _buckets(shape, 3), _buckets(shapes2, 4), _buckets(shapes3, 5)]
    numbers, counts = np.unique(np.concatenate(found), return_counts=True)
    own = numbers > AGAIN  # the first three numbers are kept for what follows
    numbers, counts = numbers[own], counts[own]
    extra = np.array([len(tokens), int((word[:-1] == word[1:]).sum()), len(pair) - len(np.unique(pair))])
    return np.concatenate([[BIAS, SAME, AGAIN], numbers]), np.sqrt(np.concatenate([extra, counts]) / len(tokens))


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-Proximal: per-coordinate rates, with L1 and L2 terms."""
    z, n, w = (np.zeros(1 << BITS) for _ in range(3))
    if not rows or len({y for _, y in rows}) < 2:
        return w.astype(np.float32)
    memo = Memo()
    packed = [(i.astype(np.int32), v.astype(np.float32), y) for (i, v), y in ((features(t, memo), y) for t, y in rows)]
    order = np.random.RandomState(0)
    for _ in range(epochs):
        for k in order.permutation(len(packed)):
            i, v, y = packed[k]
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(wi @ v, -50, 50)))
            g = (p - y) * v
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i], n[i] = zi + g - s * wi, ni + g * g
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, bound: int = TRAINING_ROWS) -> np.ndarray:
    """Weights from at most `bound` labelled rows whose crc32(doc_id) mod folds is not held_out."""
    return train(labelled(docs, labels, "quality", folds, held_out, bound))


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if not given) and quality_score."""
    keep = [c for c in keep or docs.columns if c.lower() != "quality_score"]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("quality_score", F.lit(0.0)).schema
    known = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, memo = known.value, Memo()
        for batch in batches:
            margins = []
            for text in column(batch, "text"):
                i, v = features(text, memo)
                margins.append(float(w[i] @ v))
            p = 1 / (1 + np.exp(-np.clip(np.array(margins, float), -500, 500)))
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(p, pa.float64())], names=[*keep, "quality_score"])

    return source.mapInArrow(run, schema)
