"""Toxicity by compression distance: two zstandard dictionaries, trained separately on toxic and on ordinary text.

Texts are brought to words of one byte a letter, each after a mark of two bytes. Each dictionary is made of passages of real training text of its own class,
chosen greedily as in the COVER algorithm: a passage scores by the strings of GRAM bytes in it (a string that a chosen passage holds scores no more), and the best passage of
all comes first until nothing pays or the dictionary is full. What a string scores is the number of distinct contexts in which its class has it, weighted by how much more often (as a share of all contexts)
it stands there than in the other class; strings that the other class has as often score below zero, so passages end where the text becomes common. Contexts are
counted, not occurrences, so copies of one document count once (up to the folds). Behind the passages of its class each dictionary holds one background: the frequent words of all training text,
which compresses common text alike. A passage may be a word, a part of one, or several words.

A window that both dictionaries describe equally well compresses to equal lengths. Matches of under MATCH
bytes don't count, so a match takes in the mark, and what only occurs inside words saves nothing. The bytes that the toxic dictionary saves over the ordinary one are compared with a
threshold. Threshold and weights are calibrated on held-in folds: dictionaries trained on the other folds measure the rows of a fold, so no row is measured by what it has taught.
A logistic curve over (largest saving, number of windows past the threshold, their share) gives the score.

Documents are scored where they are read, whole, in windows of WINDOW bytes that overlap by OVERLAP; the model is a few kilobytes. Defined cases: null, empty
and letterless texts save nothing and get the score of that; without labelled rows of both classes every score is 0; very long texts are many windows; repeated rows each give a
row; an empty table gives an empty result; an input column `toxic_score` is replaced, all other names stay.
"""

from __future__ import annotations

import codecs
import heapq
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, labelled

#: Bound of the training sample, in rows.
TRAINING_ROWS = 4000
WINDOW, OVERLAP = 56, 14
MATCH = GRAM = 6
MARK = b"\1\2"
BACKGROUND_WORDS = 300
THRESHOLDS, RIDGE, FOLDS = range(1, 9), 0.05, 3
#: A string counts for a class from so many contexts and such a share of them, and from such a logarithm of the odds (ordinary, toxic).
LEAST_CONTEXTS, LEAST_SHARE, LEAST_LOG_ODDS = 5, 2e-4, (3.0, 3.0)
#: Bytes of passages in a dictionary (and strings that count), contexts tried for a string, and what a string without a score costs a passage.
PASSAGES, TRIED, COST = 4096, 16, -1.0
#: Bytes of contexts whose strings are numbered at once.
SLICE = 1 << 20
#: Known to both dictionaries and put after every window, so that zstandard never falls back to storing a window raw.
ANCHOR = b"0123456789 ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 ABCDEF"
LETTERS = bytes(c if 97 <= c <= 122 or c >= 192 and c not in (215, 247) else 32 for c in range(256))


def _one_byte(error: UnicodeEncodeError) -> tuple[bytes, int]:
    """Letters beyond Latin-1 share the upper bytes; a collision of two scripts does no harm."""
    return bytes(192 + ord(c) % 63 if c.isalpha() else 32 for c in error.object[error.start : error.end]), error.end


codecs.register_error("tessera_one_byte", _one_byte)


@dataclass(frozen=True)
class Model:
    background: bytes
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...] | None

    def score(self, savings: list[int]) -> float:
        if self.weights is None:
            return 0.0
        z = sum(w * x for w, x in zip(self.weights, measures(savings, self.threshold), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def measures(savings: list[int], threshold: int) -> tuple[float, ...]:
    """1, the largest saving, and the windows past the threshold by number and by share."""
    hits = sum(s >= threshold for s in savings)
    return 1.0, float(max(0, *savings)) if len(savings) > 1 else float(max(0, savings[0])), math.log1p(hits), math.log1p(50.0 * hits / len(savings))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("latin-1", "tessera_one_byte").translate(LETTERS).split() if text else []


class Ruler:
    """Measures by how many bytes each window of a text gets shorter under the toxic dictionary."""

    def __init__(self, model: Model):
        self.compressors = [self._compressor(x + model.background + ANCHOR) for x in (model.ordinary, model.toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters(
            window_log=14, chain_log=12, hash_log=13, search_log=3, min_match=MATCH, target_length=16, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)

    def savings(self, text: str | None) -> list[int]:
        body = MARK + MARK.join(words_of(text))
        plain, toxic = (c.compress for c in self.compressors)
        step = WINDOW - OVERLAP
        windows = [body[i : i + WINDOW] + ANCHOR for i in range(0, max(1, len(body) - OVERLAP), step)]
        return [len(plain(w)) - len(toxic(w)) for w in windows]


class Share:
    """The distinct runs of three words in one fold of the texts of a class, and their strings of GRAM bytes as numbers: how often each stands there, and some contexts of it."""

    def __init__(self, texts: Iterator[list[bytes]]):
        seen: set[int] = set()
        data, long, ends, words = bytearray(), array("l"), array("l", [0]), Counter()
        for w in texts:
            for run in zip([b"", *w[:-1]], w, [*w[1:], b""], strict=True):
                if (key := hash(run)) not in seen:
                    seen.add(key)
                    data += MARK + run[1] + MARK + run[2] + b"\0"
                    long.append(len(run[1]))
                    ends.append(len(data))
                    words[run[1]] += 1
        del seen
        self.words = dict(words.most_common(10 * BACKGROUND_WORDS))
        self.data, self.starts, sizes = bytes(data), np.array(ends, np.int64), np.array(long, np.int64)
        del data, words
        data = np.frombuffer(self.data + bytes(GRAM), np.uint8)
        found = []
        for begin in range(0, len(data) - GRAM + 1, SLICE):
            part = data[begin : begin + SLICE + GRAM - 1].astype(np.uint64)
            n = len(part) - GRAM + 1
            numbers, whole = np.zeros(n, np.uint64), np.ones(n, bool)
            for i in range(GRAM):
                numbers |= part[i : i + n] << np.uint64(8 * i)
                whole &= part[i : i + n] > 0
            at = np.flatnonzero(whole) + begin
            run = np.searchsorted(self.starts, at, "right") - 1
            own = at - self.starts[run] < sizes[run] + 2  # a string belongs to the word in which it, or its mark, begins
            found.append((numbers[at[own] - begin], run[own].astype(np.int32)))
        numbers, run = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        del found
        order = np.argsort(numbers, kind="stable")
        numbers, run = numbers[order], run[order]
        ends = np.append(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, len(numbers)) if len(numbers) else np.zeros(0, np.int64)
        self.strings, self.times = numbers[ends - 1], np.diff(ends, prepend=0).astype(np.int32)
        # of each string the first TRIED contexts
        first = np.repeat(ends - self.times, self.times)
        self.tried, self.upto = run[np.arange(len(run)) - first < TRIED], np.cumsum(np.minimum(self.times, TRIED))

    def frequent(self, least: float) -> np.ndarray:
        """The strings that stand in at least so many contexts."""
        return self.strings[self.times >= least]

    def find(self, strings: np.ndarray) -> np.ndarray:
        """The place of each string here, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.strings, strings), max(0, len(self.strings) - 1))
        return np.where(self.strings[at] == strings, at, -1) if len(self.strings) else np.full(len(strings), -1)

    def count(self, strings: np.ndarray) -> np.ndarray:
        at = self.find(strings)
        return np.where(at >= 0, self.times[at], 0) if len(self.times) else np.zeros(len(strings), np.int64)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def body(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.starts[k + 1] - 1]


def string_scores(own: list[Share], other: list[Share], least_odds: float) -> tuple[np.ndarray, np.ndarray]:
    """(strings, scores) of the strings that tell a class from the other one; the best PASSAGES of them."""
    total, other_total = (sum(map(len, shares)) + 1 for shares in (own, other))
    least = max(LEAST_CONTEXTS, LEAST_SHARE * total)
    # what is frequent enough in all folds is frequent enough, by its part, in one of them
    strings = np.unique(np.concatenate([x.frequent(least / len(own)) for x in own]))
    n, there = (sum(x.count(strings).astype(np.int64) for x in shares) for shares in (own, other))
    odds = np.log((n + 0.5) / total) - np.log((there + 0.5) / other_total)
    kept = np.flatnonzero((n >= least) & (odds > least_odds))
    kept = kept[np.argsort(-n[kept] * odds[kept], kind="stable")[:PASSAGES]]
    kept.sort()
    return strings[kept], n[kept] * odds[kept]


def passages(own: list[Share], other: list[Share], least_odds: float) -> bytes:
    """The passages of a class, the best one last, where it is nearest to what is compressed."""
    strings, scores = string_scores(own, other, least_odds)
    value = dict(zip((int(x).to_bytes(GRAM, "little") for x in strings), scores.tolist(), strict=True))
    grams = lambda p: [p[i : i + GRAM] for i in range(len(p) - GRAM + 1)]
    found: set[bytes] = set()
    for share in own:
        # of each string a number of contexts, cut to where the strings pay
        at = share.find(strings)
        tried = [share.tried[share.upto[k] - min(share.times[k], TRIED) : share.upto[k]] for k in at[at >= 0].tolist()]
        for k in np.unique(np.concatenate([np.zeros(0, np.int32), *tried])).tolist():
            body = share.body(k)
            best, run, begin, cut = 0.0, 0.0, 0, None
            for i, gram in enumerate(grams(body)):
                if run <= 0:
                    run, begin = 0.0, i
                run += value.get(gram, COST)
                if run > best:
                    best, cut = run, (begin, i)
            if cut is not None:
                found.add(body[cut[0] : cut[1] + GRAM])
    worth = lambda p: sum(value.get(g, COST) for g in set(grams(p)))
    heap = [(-worth(p), p) for p in found]
    heapq.heapify(heap)
    chosen: list[bytes] = []
    size = 0
    while heap and size < PASSAGES:
        known, p = heapq.heappop(heap)
        now = worth(p)
        if now <= 0:
            continue
        if -known > now:  # others have taken its strings; look again later
            heapq.heappush(heap, (-now, p))
            continue
        chosen.append(p)
        size += len(p) + 1
        value.update(dict.fromkeys(grams(p), 0.0))
    # a zero byte, which no text has, ends each passage, so that no match runs into the next one
    return b"".join(p + b"\0" for p in reversed(chosen))


def dictionaries(ordinary: list[Share], toxic: list[Share]) -> tuple[bytes, bytes, bytes]:
    """(background, ordinary, toxic) dictionary contents."""
    words: Counter = Counter()
    for share in ordinary:
        words.update(share.words)
    common = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:BACKGROUND_WORDS]
    background = b"".join(b"\0" + MARK + w for w, _ in reversed(common)) + b"\0"
    return background, passages(ordinary, toxic, LEAST_LOG_ODDS[0]), passages(toxic, ordinary, LEAST_LOG_ODDS[1])


def train(rows: list[tuple[str, int]]) -> Model:
    labels = np.array([y for _, y in rows])
    if not rows or labels.min() == labels.max():
        return Model(b"", b"", b"", 1, None)
    # folds by the text, so that copies of a text share one
    fold = np.array([zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS for text, _ in rows])
    shares = [[Share(words_of(rows[i][0]) for i in np.flatnonzero((fold == k) & (labels == y))) for k in range(FOLDS)] for y in (0, 1)]
    savings: list[list[int]] = [[0]] * len(rows)
    for k in range(FOLDS):
        ruler = Ruler(Model(*dictionaries(*([x for j, x in enumerate(mine) if j != k] for mine in shares)), 1, None))
        for i in np.flatnonzero(fold == k):
            savings[i] = ruler.savings(rows[i][0])
    fits = [(*_logistic(np.array([measures(s, t) for s in savings]), labels), t) for t in THRESHOLDS]
    _, weights, threshold = max(fits, key=lambda f: (f[0], -f[2]))
    return Model(*dictionaries(*shares), threshold, weights)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """(log likelihood, weights) by Newton's steps with a small ridge, which keeps them finite on separable rows."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - RIDGE * w)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -500, 500))), 1e-12, 1 - 1e-12)
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, bound: int = TRAINING_ROWS) -> Model:
    """A model of at most `bound` labelled rows whose crc32(doc_id) mod folds is not held_out."""
    return train(labelled(docs, labels, "toxic", folds, held_out, bound))


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if not given) and toxic_score."""
    keep = [c for c in keep or docs.columns if c.lower() != "toxic_score"]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("toxic_score", F.lit(0.0)).schema
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruler = Ruler(known.value)
        for batch in batches:
            out = [known.value.score(ruler.savings(text)) for text in column(batch, "text")]
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, pa.float64())], names=[*keep, "toxic_score"])

    return source.mapInArrow(run, schema)
