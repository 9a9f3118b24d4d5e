"""The pipeline against a plain version of its stages, on the smallest tables."""

import hashlib
import math
import zlib
from fractions import Fraction

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, suffix_repeats, toxicity

SF = "/root/testdata/sf0.001"


def plain_model(docs, labels):
    ids = {}
    for i, toxic in labels:
        if zlib.crc32(str(i).encode()) % 5:
            ids[i] = max(ids.get(i, 0), toxic)
    chosen = sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[: toxicity.TRAINING_ROWS]
    text = {d["doc_id"]: d["text"] for d in docs}
    return toxicity.train([(text[i], ids[i]) for i in sorted(chosen) if i in text])


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(docs):
    """The first document of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    sets = [shingles(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k]["doc_id"])
                root[b] = a
    return [d for i, d in enumerate(docs) if find(i) == i]


def plain_cut(docs):
    least = {}
    for d in docs:
        t = d["text"].encode()
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(least.get(w, d["doc_id"]), d["doc_id"])
    out = []
    for d in docs:
        t, spans = d["text"].encode(), []
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < d["doc_id"]:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + 50
                else:
                    spans.append([p, p + 50])
        text = suffix_repeats.kept(t, spans, True).decode()
        if not spans or text.strip(" "):
            out.append(d | {"text": text, "n_chars": len(text) if spans else d["n_chars"]})
    return out


def plain_mix(docs):
    size = {d["doc_id"]: len(d["text"].encode().split()) for d in docs}
    total = {}
    for d in docs:
        total[d["source"]] = total.get(d["source"], 0) + size[d["doc_id"]]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    ramp = {s: (-0.6, 0.0, 0.6)[i % 3] for i, s in enumerate(sorted(total))}
    capped = set()
    while True:  # share, stop at the cap, share the excess again
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        level = Fraction(rest, sum(weight[s] for s in total if s not in capped))
        over = {s for s in total if s not in capped and level * weight[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in total:
        goal = math.floor(3 * total[s] if s in capped else level * weight[s])
        passes, start = divmod(goal, total[s])[0], 0
        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: (hashlib.md5(str(d["doc_id"]).encode()).hexdigest(), d["doc_id"])):
            n = size[d["doc_id"]]
            for k in range(passes + 1):
                words = n if k < passes else max(0, min(n, goal - passes * total[s] - start))
                if words:
                    u, b = (k * total[s] + start + words / 2) / goal, 1 - ramp[s]
                    t = u if not ramp[s] else (-b + math.sqrt(b * b + 4 * ramp[s] * u)) / (2 * ramp[s])
                    out.append((d["doc_id"], d["text"], k, words, pytest.approx(t, abs=1e-9)))
            start += n
    return out


def test_pipeline_equals_the_plain_version(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = plain_model(docs, labels)
    ruler = toxicity.Ruler(model)
    kept = [d for d in docs if model.score(ruler.savings(d["text"])) < 0.5]
    kept = [d for d in plain_cut(plain_groups(kept)) if not decontaminate.reference(d["text"], items)[2]]
    assert 100 < len(kept) < len(docs)
    want = sorted(plain_mix(kept), key=lambda x: x[:1] + x[2:3])
    rows = corpus_pipeline.run(spark, SF).collect()
    got = sorted(((r.doc_id, r.text, r["pass"], r.words, r.position) for r in rows), key=lambda x: x[:1] + x[2:3])
    assert got == want
