"""Ranking, graph, clustering, contents, mining and evaluation on small cases with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import passage_tokens
from tessera.operators import clustering, contents, evaluation, graph, mining, ranking, retrieve
from tessera.plans import bindings

DOCS = [(1, "the horse trots"), (2, "the rider sits on the horse"), (3, "pace is fast"), (4, "canter"), (5, "the canter of the horse"), (6, "the end")]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bm25(spark):
    docs, asked = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(0, "the rider")], "query_id long, text string")
    idf = {r.term: r.idf for r in ranking.term_stats(ranking.bm25_index(docs, passage_tokens)).collect()}
    assert idf["the"] == pytest.approx(0.2436, abs=1e-4)
    got = {r.doc_id: round(r.score, 4) for r in ranking.bm25(docs, asked, passage_tokens).collect()}
    assert got == {1: 0.2551, 2: 1.2322, 5: 0.2998, 6: 0.2971}
    filled = ranking.with_zero_scores(ranking.bm25(docs, asked, passage_tokens), docs, asked, 6)
    assert rows(filled.where("score = 0"), "doc_id") == [(3,), (4,)]
    again = ranking.bm25(docs.repartition(7), asked, passage_tokens)
    assert {r.doc_id: round(r.score, 4) for r in again.collect()} == got


@pytest.mark.parametrize("block", [3, 4096])
def test_bm25_top_sends_no_postings(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 9)))) for i in range(150)] + [(150, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(r.choices(words + ["new"], k=3))) for q in range(8)], "query_id long, text string")
    every = ranking.bm25(docs, asked, passage_tokens).withColumn("score", F.round("score", 4))
    got = ranking.bm25_top(docs, asked, passage_tokens, 5, 4)
    assert got.count() <= 8 * 5 * 3 * 2
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    names = ("query_id", "doc_id", "score", "rank")
    assert rows(ranking.top(got, 5), *names) == rows(ranking.top(every, 5), *names)
    pairs = spark.createDataFrame([(q, d) for q in range(9) for d in (3, 8, 150)], "query_id long, doc_id long")
    held = ranking.bm25_top(docs, asked, passage_tokens, 5, 4, pairs)
    assert rows(held.join(pairs, ["query_id", "doc_id"]), *names[:3]) == rows(every.join(pairs, ["query_id", "doc_id"]), *names[:3])
    assert held.groupBy("query_id", "doc_id").count().where("count > 1").isEmpty() and rows(ranking.top(held, 5), *names) == rows(ranking.top(every, 5), *names)
    zero = ranking.top(ranking.with_zero_scores(every, docs, asked, 90), 90)
    assert rows(ranking.top(ranking.bm25_filled(docs, asked, passage_tokens, 90, 4), 90), *names) == rows(zero, *names)


def test_scores_near_the_last_one_stay_with_their_first_ids():
    best = ranking._Best(1, 2, 0.1)
    best.add(np.zeros(7, int), np.array([9, 8, 7, 6, 5, 4, 3]), np.array([10.0, 9.5, 9.0, 9.0, 9.0, 8.6, 8.4]))
    assert best.rows()[1].tolist() == [9, 8, 5, 6, 4] and best.floor[0] == 8.5


def test_fusion(spark):
    make = lambda ids: spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, rank int")
    got = {r.doc_id: round(r.score, 6) for r in ranking.rrf(make([10, 20, 30]), make([30, 40, 10])).collect()}
    assert got == {10: 0.032266, 30: 0.032266, 20: 0.016129, 40: 0.016129}
    near = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.5)], "query_id long, doc_id string, score double")
    sparse = spark.createDataFrame([(0, "b", 4.0), (0, "c", 2.0), (0, "d", 0.0)], "query_id long, doc_id string, score double")
    assert {r.doc_id: round(r.score, 2) for r in ranking.weighted_fusion(near, sparse).collect()} == {"a": 0.54, "b": 0.7, "c": 0.2}


def test_dense_equals_plain_search_in_blocks(spark, monkeypatch):
    for block in (3, 4096):
        monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
        check_dense(spark)


def check_dense(spark):
    r = np.random.RandomState(0)
    vec = r.normal(size=(60, 5))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "doc_id long, vec array<double>")
    asked = table.where("doc_id < 8").select(F.col("doc_id").alias("query_id"), "vec")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    for q, i, rank in rows(ranking.dense(table, asked, 4), "query_id", "doc_id", "rank"):
        assert np.argsort(-(unit @ unit[q]))[rank - 1] == i
    named = ranking.dense(table.withColumn("doc_id", F.concat(F.lit("n"), "doc_id")), asked.withColumn("query_id", F.concat(F.lit("q"), "query_id")), 4)
    assert rows(named, "query_id", "doc_id") == sorted((f"q{q}", f"n{i}") for q, i in rows(ranking.dense(table, asked, 4), "query_id", "doc_id"))


def test_dense_search_holds_tiles_only():
    """2,000 queries against 10,000 vectors are 160 MB of scores, which a task once sorted as a whole."""
    import tracemalloc

    r = np.random.RandomState(2)
    m, docs = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(2000, 8)), r.normal(size=(10000, 8))))
    docs[5000:] = docs[:5000]  # ties
    ids = r.permutation(10000)
    tracemalloc.start()
    best = ranking._Best(2000, 20)
    ranking._search(best, m, ids, docs)
    query, doc, score = best.rows()
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert len(query) == 40000
    for q in (0, 7, 1999):
        scores = np.round(docs @ m[q], 6)
        want = np.lexsort((ids, -scores))[:20]
        assert doc[query == q].tolist() == ids[want].tolist() and score[query == q].tolist() == scores[want].tolist()


def test_rerank_with_model(spark):
    docs, asked = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(0, "canter")], "query_id long, text string")
    pairs = docs.select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    assert [r.doc_id for r in ranking.rerank(pairs, asked, docs, 2).orderBy("rank").collect()] == [4, 5]
    model = ranking.model_scorer(lambda pairs: [float(len(t)) for _, t in pairs])
    assert [r.doc_id for r in ranking.rerank(pairs, asked, docs, 2, model).orderBy("rank").collect()] == [2, 5]


def test_pagerank_with_dangling_node(spark):
    links = spark.createDataFrame(list("ab bc ca ac da ce".replace(" ", "")[i : i + 2] for i in range(0, 12, 2)), "string").select(F.substring("value", 1, 1).alias("source"), F.substring("value", 2, 1).alias("target"))
    nodes = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    seeds = spark.createDataFrame([(0, "b"), (1, "a"), (1, "d")], "query_id long, id string")
    for n, want in ((1, [0.255, 0.405, 0.255, 0.0, 0.085]), (20, [0.151201, 0.342173, 0.355424, 0.0, 0.151201])):
        got = graph.personalised_pagerank(links, nodes, seeds, iterations=n)
        assert [round(x[1], 6) for x in rows(got.where("query_id = 0"), "id", "score")] == want
        assert all(abs(r.s - 1) < 1e-9 for r in got.groupBy("query_id").agg(F.sum("score").alias("s")).collect())
    assert rows(graph.degrees(links), "id", "degree") == [("a", 4), ("b", 2), ("c", 4), ("d", 1), ("e", 1)]
    assert spark.range(1).select(graph.hub_penalty(F.lit(0.151201), F.lit(4))).first()[0] == pytest.approx(0.084387, abs=1e-6)


def test_edge_fusion(spark):
    t = spark.createDataFrame([(0, "Rider", "CONTROLS", "Speed", "Use seat", "Ideal", None), (1, "The Rider", "CONTROLS", "Speed", "Use legs", "Ideal", None)], "seq long, source string, relation string, target string, instruction string, modality string, condition string")
    names = spark.createDataFrame([("The Rider", "Rider")], "name string, canonical string")
    fused = graph.fuse_edges(graph.canonicalise(t, names, ["source", "target"]), ["condition", "instruction", "modality"]).collect()
    assert len(fused) == 1 and fused[0].properties == {"instruction": ["Use legs", "Use seat"], "modality": ["Ideal"]}
    again = graph.canonicalise(graph.canonicalise(t, names, ["source"]), names, ["source"])
    assert rows(again, "source") == [("Rider",), ("Rider",)]


def test_loading_merges_lines(spark):
    e = spark.createDataFrame([("a", "b", "R", {"x": "1", "y": "1"}, 1), ("a", "b", "R", {"x": "2"}, 2), ("a", "b", "S", {}, 3)], "source string, target string, relation string, properties map<string,string>, line int")
    nodes, edges = graph.load_graph(e, spark.createDataFrame([("a", "Horse")], "name string, type string"))
    assert rows(nodes, "id", "label", "name") == [("a", "Horse", "A"), ("b", "Concept", "B")]
    assert {r.relation: r.properties for r in edges.collect()} == {"R": {"x": "2", "y": "1"}, "S": {}}
    assert rows(graph.node_search_text(nodes, edges), "id", "search_text") == [("a", "Horse: A. 2 1"), ("b", "Concept: B.")]


def test_seed_selection(spark):
    ranked = spark.createDataFrame([(0, f"n{i}", 0.9 - i / 10) for i in range(9)] + [(1, "x", 0.01), (1, "y", 0.02), (1, "z", 0.03), (1, "w", 0.001), (2, "p", 0.01), (2, "q", 0.5)], "query_id long, id string, score double")
    strong = spark.createDataFrame([(2, "p")], "query_id long, id string")
    got = graph.select_seeds(ranked, strong)
    assert rows(got.where("query_id = 0"), "id") == [(f"n{i}",) for i in range(7)]
    assert rows(got.where("query_id > 0"), "query_id", "id") == [(1, "x"), (1, "y"), (1, "z"), (2, "p"), (2, "q")]


def test_graph_retrieval_falls_back_to_nodes(spark):
    e = spark.createDataFrame([("Rider", "Speed", "CONTROLS", {"modality": "Ideal"}, 1), ("Rider", "Rein", "HOLDS", {}, 2), ("Alone", "Alone2", "NEAR", {}, 3)], "source string, target string, relation string, properties map<string,string>, line int")
    nodes, edges = graph.load_graph(e)
    nodes = nodes.union(spark.createDataFrame([("Lonely", "Concept", "Lonely")], "id string, label string, name string"))
    described = retrieve.graph_nodes(nodes, edges)
    asked = spark.createDataFrame([(0, "rider speed"), (1, "lonely")], "query_id long, text string")
    seeds = retrieve.graph_seeds(described, asked, None, None)
    assert rows(seeds.where("query_id = 1"), "id") == [("Lonely",)]
    facts = retrieve.graph_facts(nodes, edges, asked, seeds, 2, described)
    got = rows(facts, "query_id", "rank", "line")
    assert got[0] == (0, 1, 'Rider --[CONTROLS]--> Speed ({"modality": "Ideal"})') and len([g for g in got if g[0] == 0]) == 2
    contexts = {r.query_id: r.context for r in retrieve.graph_context(facts).collect()}
    assert contexts[0].count("\n- ") == 2
    both = retrieve.hybrid(asked, retrieve.text_context(spark.createDataFrame([(0, 1, "T")], "query_id long, rank int, text string")), retrieve.graph_context(facts).where("query_id = 0"))
    assert {r.query_id: r.context for r in both.collect()}[1] == "## Passages\n\n\n## Graph\n"
    assert rows(retrieve.baseline(asked), "query_id", "context") == [(0, ""), (1, "")]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5])
def test_clusters_equal_the_undivided_algorithm(spark, monkeypatch, threshold):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 16)
    vec = np.random.RandomState(int(threshold * 10)).normal(size=(45, 6))
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    want = clustering.average_linkage(1 - unit @ unit.T, threshold)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<double>")
    near = {(i, j) for i in range(45) for j in range(i + 1, 45) if 1 - unit[i] @ unit[j] < threshold}
    component = dict(rows(clustering.connected(clustering.close_links(table, threshold, 16)), "id", "component"))
    root = list(range(45))
    for _ in range(45):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert [component.get(i, i) for i in range(45)] == root
    assert rows(clustering.clusters(table, threshold), "id", "cluster") == list(enumerate(want))


def test_equal_vectors_count_as_often_as_they_occur(spark):
    vec = np.random.RandomState(1).normal(size=(12, 3))
    vec = np.concatenate([vec, vec[:4], vec[:2], vec[:2]])
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    want = clustering.average_linkage(1 - unit @ unit.T, 0.4)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)] + [(99, None)], "id long, vec array<double>")
    assert rows(clustering.clusters(table, 0.4), "id", "cluster") == [*enumerate(want), (99, 99)]


def test_chain_keeps_no_table_of_distances():
    """3,000 distances squared are 72 MB."""
    import time
    import tracemalloc

    r = np.random.RandomState(3)
    m = r.normal(size=(3000, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = clustering.average_linkage(1 - m[:400] @ m[:400].T, 0.6, [1 + i % 3 for i in range(400)])
    assert clustering.chain_linkage(m[:400], np.array([1 + i % 3 for i in range(400)]), 0.6).tolist() == want
    tracemalloc.start()
    began = time.process_time()
    clustering.chain_linkage(m, np.ones(3000), 0.75)
    assert tracemalloc.get_traced_memory()[1] < 10e6 and time.process_time() - began < 120
    tracemalloc.stop()


@pytest.mark.parametrize("threshold", [0.3, 0.75])
def test_rounds_of_clusters_equal_the_undivided_algorithm(spark, monkeypatch, threshold):
    monkeypatch.setattr(clustering, "LOCAL_ROWS", 6)
    monkeypatch.setattr(clustering, "CELL_ROWS", 16)
    vec = np.random.RandomState(5).normal(size=(40, 6))
    vec = np.concatenate([vec, vec[:3], vec[:1]])
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<double>")
    assert rows(clustering.clusters(table, threshold), "id", "cluster") == list(enumerate(clustering.average_linkage(1 - unit @ unit.T, threshold)))


def test_resolution(spark):
    named = spark.createDataFrame([("Rider", 0), ("The Rider", 0), ("Left Rein", 1), ("Right Rein", 1), ("Rein", 1), ("Alone", 2)], "name string, cluster long")
    assert dict(rows(clustering.resolve(named), "name", "canonical")) == {"Rider": "Rider", "The Rider": "Rider", "Left Rein": "Left Rein", "Right Rein": "Right Rein", "Rein": "Rein", "Alone": "Alone"}

    def broken(names):
        raise ValueError

    assert dict(rows(clustering.resolve(named, broken), "name", "canonical"))["Left Rein"] == "Rein"
    sizes = clustering.size_classes(named.select("cluster")).first()
    assert (sizes.singles, sizes.pairs, sizes.larger) == (1, 1, 1)
    known = spark.createDataFrame([("Rider",)], "name string")
    assert rows(clustering.new_names(spark.createDataFrame([("Rider", "Rein")], "source string, target string"), known), "name") == [("Rein",)]


def test_chapters(spark):
    from tessera.sources import files

    ranges = contents.chapter_ranges(files.toc(spark, [*bindings.CONTENTS, (1, 2, "Details, mended", 310, {"Numbers": 311})]))
    pages = spark.createDataFrame([("B", 0, p) for p in (1, 20, 25, 26, 119, 120, 140, 150, 450, 500)] + [("B", 1, 305), ("B", 1, 311), ("C", 2, 5)], "book string, level int, page int")
    got = {(r.level, r.page): (r.chapter_num, r.chapter_name, r.subchapter_name) for r in contents.carry_subchapters(contents.assign_chapters(pages, ranges)).collect()}
    assert got[0, 1] == (0, "Intro", "") and got[0, 20] == (1, "Start", "Opening") and got[0, 25] == (1, "Start", "Aims | Means") and got[0, 26] == (1, "Start", "Means")
    # the chapter after Middle has no page, so Middle has no end, and the first chapter that holds a page counts
    assert got[0, 120] == (2, "Middle", "") and got[0, 150] == got[0, 450] == got[0, 500] == (2, "Middle", "Turn")
    assert got[1, 305] == (1, "Basics", "") and got[1, 311] == (2, "Details, mended", "Numbers") and got[2, 5] == (0, "Intro", "")


def test_bridges(spark):
    p = spark.createDataFrame([(1, "s", 1, "tempo words shared"), (2, "s", 5, "tempo shared"), (3, "t", 1, "tempo"), (4, "s", 20, "shared words")], "passage_id long, source string, chunk_id long, text string")
    assert rows(mining.bridged_pairs(p), "a", "b", "keyword") == [(1, 3, "tempo"), (1, 4, "shared")]
    assert mining.bridged_pairs(p, 1).count() == 1
    mixed = mining.mixed_contexts(p, 2, 1)
    assert rows(mixed.groupBy("source_type").count(), "source_type", "count") == [("global", 1), ("local", 2)]
    assert rows(mining.local_contexts(p.repartition(3), 2), "passage_id") == rows(mining.local_contexts(p, 2), "passage_id")
    assert mining.long_passages(p, 11).count() == 3

    def answer(text):
        if "t" == text[0]:
            raise ValueError
        return text[:3]

    assert sorted(r.reply or "" for r in mining.generated(p, answer).collect()) == ["", "", "", "sha"]


def test_consensus_and_cost(spark):
    a = spark.createDataFrame([(1, 0.8), (2, 0.8)], "k int, s double")
    b = spark.createDataFrame([(1, 0.6), (3, 0.2)], "k int, s double")
    assert [(k, round(s, 6)) for k, s in rows(evaluation.consensus(a, b, ["k"], ["s"]), "k", "s")] == [(1, 0.7), (2, 0.4), (3, 0.1)]
    run = spark.createDataFrame([("large", 1000000, 500000)], "model_category string, total_input_tokens long, output_tokens long")
    assert evaluation.cost(run, evaluation.prices(spark)).first().est_cost_usd == pytest.approx(0.45)


def test_experiment_resumes(spark):
    questions = spark.createDataFrame([(f"q{i} x", "Lookup" if i % 2 else "Multi-hop") for i in range(6)], "question string, category string")
    models = spark.createDataFrame([("m1", "large"), ("m2", "small")], "model_id string, model_category string")
    runs = evaluation.grid(models, evaluation.k_schedule(spark, {"text_rag": [1, 2], "baseline": [0]}), questions)
    assert runs.count() == 36 and evaluation.capped(questions, 2).count() == 4

    def retrieve_(row):
        if row["method"] == "baseline":
            raise ValueError("none")
        return "some context"

    results = evaluation.run_experiment(runs, runs.limit(0), evaluation.prices(spark), retrieve_, lambda r: "an answer", [lambda r: '{"score": 5}', lambda r: "?"]).cache()
    row = results.where("method = 'text_rag'").first()
    assert results.count() == 36 and row.score == 0.5 and row.total_input_tokens == row.gen_input_tokens + row.context_tokens and row.est_cost_usd > 0
    assert results.where("method = 'baseline' and context = '' and context_error = 'none'").count() == 12
    assert evaluation.pending(runs, results).count() == 0
    assert evaluation.pending(runs, results.where("k > 0")).count() == 12


def test_reports(spark):
    r = random.Random(0)
    data = [(m, k, f"q{i}", r.random()) for m in "abc" for k in (1, 2) for i in range(10)]
    df = spark.createDataFrame(data, "method string, k int, question string, score double")
    mean = lambda m, k: sum(s for a, b, _, s in data if (a, b) == (m, k)) / 10
    assert all(math.isclose(x.accuracy, mean(x.method, x.k)) for x in evaluation.accuracy(df).collect())
    assert {x.method: x.k for x in evaluation.best_k(df).collect()} == {m: max((1, 2), key=lambda k: mean(m, k)) for m in "abc"}
    assert evaluation.best_per_question(df).first().oracle_accuracy == pytest.approx(sum(max(s for _, _, q, s in data if q == f"q{i}") for i in range(10)) / 10)
    assert sum(x.questions for x in evaluation.uniquely_best(df).collect()) == 10
