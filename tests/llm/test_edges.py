"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries

WORDS = "the of and horse alpha beta gamma delta stone river idiot license mit under apache version".split()
CLASHES = ["score", "size", "taken", "block", "spans", "hit_items", "toxic_score", "quality_score", "fp", "component_id", "target", "schedule", "kept_text", "found", "base", "row", "label", "position", "n_words", "s", "rank", "offset", "x", "k_source", "k_id", "in_0", "copy", "pass", "block_", "w", "item", "row_"]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with small tables full of odd rows, and one with the same tables empty."""
    r = random.Random(3)
    long = sentence(r, 60000)
    copy = sentence(r, 80)
    rows = [(i, sentence(r, 120), "en", f"s{i % 3}") for i in range(24)]
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, " \n\t ", "en", "s1"), (33, long, "en", "s0"), (34, long + " x", "en", "s0"), (35, copy, "en", "s1"), (36, copy, "en", None)]
    rows += [(37, copy, "en", "s2"), (37, copy, "en", "s2"), (38, "Ünïcödé — 😀 text " * 8, "de", "s1"), (39, "Ünïcödé — 😀 text " * 8 + "end", "de", "s1"), (None, copy, None, None), (40, "one", "en", "s0"), (41, "one", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(c))
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(24)] + [(0, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, rows[0][1]), (1, " ".join(rows[0][1].split()[30:60])), (2, None), (3, ""), (None, rows[1][1]), (4, "two words9"), (4, copy), (5, "one")], "item_id long, text string")
    vec = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [None, 1.0, 1.0, 1.0]), (62, [float("nan")] * 4), (63, [float("inf"), 0.0, 0.0, 0.0]), (64, []), (65, [0.5] * 3), (40, [0.5] * 4), (80, [0.5] * 4), (None, [0.1] * 4)], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    pages = spark.createDataFrame([(0, "u", None), (1, None, ""), (2, "u", "<p>plain text that is long enough to be read as the main text of a page of words</p>" * 3), (3, "u", "<nav>" + "<a href=x>menu</a>" * 5), (3, "u", "no tags < here & there &amp; more")], "page_id long, url string, html string")
    folders = []
    for name in ("odd", "empty"):
        folder = str(tmp_path_factory.mktemp(name))
        for t, df in (("documents", docs), ("labels", labels), ("benchmark", bench), ("embeddings", vec), ("pages", pages)):
            (df if name == "odd" else df.limit(0)).write.parquet(f"{folder}/{t}.parquet")
        folders.append(folder)
    return folders


def check_values(name, out):
    """What null, empty, tied and repeated rows get."""
    of = lambda i: [r for r in out if r.doc_id == i]
    bare = [*of(30), *of(31), *of(32)]
    assert len(bare) == 3 and len(of(37)) == 2 and of(37)[0] == of(37)[1] or name == "op3_mix"
    if name in ("op1_toxicity", "op5_quality"):
        assert len({r.score for r in bare}) == 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
        assert len({r.score for i in (35, 36, 37) for r in of(i)}) == 1
    elif name == "op2_simhash":
        assert {(r.fingerprint, r.component_id) for r in bare} == {("0" * 16, 30)}
        assert {r.component_id for i in (35, 36, 37, None) for r in of(i)} == {35} and of(41)[0].component_id == 40
    elif name == "op3_mix":
        assert all(r.size == r.taken == r.copies == 0 and r.first_position is None for r in bare) and all(r.taken <= 3 * r.size for r in out)
    elif name == "op4_lm_score":
        assert all((r.n_tokens, r.log_score, r.mean_log_score) == (0, 0.0, None) for r in bare)
    elif name == "op6_licenses":
        assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (0, 0, None, None, "", "", 0.0) for r in bare)
    elif name == "op7_repeats":
        assert of(30)[0].n_bytes == of(31)[0].n_bytes == 0 and all(r.n_removed == r.n_spans == 0 for r in bare)
        assert of(35)[0].n_removed == 0 and all(r.n_removed == r.n_bytes for i in (36, 37, None) for r in of(i))
    elif name == "op10_decontaminate":
        assert all((r.n_words, r.n_hit, r.n_items, r.contaminated) == (0, 0, 0, False) for r in bare)
        assert of(0)[0].n_items == 2 and of(0)[0].contaminated and of(40)[0].n_items == 1 and not of(40)[0].contaminated


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_row_has_a_result(spark, odd, name):
    out = queries.QUERIES[name](spark, odd[0]).collect()
    if name in ("op8_topk",):
        assert {r.query_id for r in out} == {0, 20, 40, 80}
    elif name == "op9_main_text":
        assert sorted(r.page_id for r in out) == [0, 1, 2, 3, 3]
    else:
        assert len(out) == 38
        check_values(name, out)
    assert queries.QUERIES[name](spark, odd[1]).count() == 0


def test_pipeline_keeps_columns(spark, odd):
    for folder in odd:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        names = docs.columns
        for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.materialize(stage(spark, docs, folder))
            if step < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == names
                if folder == odd[0] and step == 1:
                    kept = [r.doc_id for r in docs.select("doc_id").collect()]
                    assert 35 in kept and not {36, 37, None} & set(kept) and len(kept) == len(set(kept))
                    assert docs.where("block <> 'block' or spans <> 'spans'").count() == 0
        assert folder == odd[0] or docs.count() == 0
