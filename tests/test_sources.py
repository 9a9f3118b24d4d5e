"""Readers, writers, caches and the resumed stream."""

import json

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import files
from tessera.streaming.resume import answer_stream


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_edges(spark, tmp_path):
    p = lines(tmp_path / "e.jsonl", {"source": "a", "target": "b", "relation": "R", "properties": {"x": "1"}}, "", "{broken", {"source": "a", "relation": "R"}, {"source": "a", "target": "c", "relation": "R", "edge_properties": {"y": "2"}})
    assert {(r.target, tuple(r.properties.items())) for r in files.edges(spark, p).collect()} == {("b", (("x", "1"),)), ("c", (("y", "2"),))}
    assert {r.target: r.properties for r in files.edges(spark, p, legacy_props=True).collect()}["b"] == {}
    fused = graph.fuse_edges(spark.createDataFrame([("a", "R", "b", "v")], "source string, relation string, target string, modality string"), ["modality"])
    files.write_edges(fused, str(tmp_path / "out"))
    assert files.edges(spark, str(tmp_path / "out")).first().properties == {"modality": "v"}


def test_questions(spark, tmp_path):
    p = lines(tmp_path / "q.jsonl", {"question": "q1", "facts": ["f"], "category": "Lookup"}, "nope", {"answer": "x"}, {"question": "q2", "key_facts": ["k"]}, {"question": "q3"})
    assert files.questions(spark, p).count() == 3
    assert files.sampled_questions(spark, p, 2).count() == 2 and files.sampled_questions(spark, p).count() == 3
    files.write_questions(files.questions(spark, p), str(tmp_path / "w"))
    assert files.questions(spark, str(tmp_path / "w")).count() == 3
    d = lines(tmp_path / "d.jsonl", {"ind": 1, "data": {"question": "q", "facts": [{"references": ["r"], "fact": {"a": "b"}}]}}, {"ind": 2})
    row = files.question_data(spark, d).collect()
    assert len(row) == 1 and row[0].answer == "" and row[0].query_terms == [] and row[0].facts[0].fact == {"a": "b"}
    (tmp_path / "n.json").write_text(json.dumps([{"question_en": "x"}, {"question_en": "y"}]))
    assert files.qna(spark, [str(tmp_path / "n.json")]).count() == 2


def test_old_graph_keeps_the_prefix(spark, tmp_path):
    ok = {"source": {"name": "a", "label": "L"}, "target": {"name": "b", "label": "L"}, "relation": "R"}
    assert files.old_graph(spark, lines(tmp_path / "o.jsonl", ok, ok, "{bad", ok)).count() == 2


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|  |three")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parse(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode().split("|")

    pages = files.pdf_pages(files.pdf_files(spark, str(tmp_path)), parse, "(empty)", offset=1)
    assert sorted((r.source, r.page or 0, r.logical_page or 0, r.text or r.error) for r in pages.collect()) == [("a.pdf", 1, 0, "one"), ("a.pdf", 2, 1, "(empty)"), ("a.pdf", 3, 2, "three"), ("b.pdf", 0, 0, "unreadable")]
    assert files.pdf_text(pages.where("text <> '(empty)'")).first().text == "one\n\nthree"
    assert files.pdf_files(spark, str(tmp_path / "none")).count() == 0


def test_extraction_cache(spark, tmp_path):
    cache = files.ExtractionCache(spark, str(tmp_path / "cache"))
    chunks = spark.createDataFrame([("a",), ("b",), ("a",), ("fail",)], "text string")

    def extractor(text):
        if text == "fail":
            raise ValueError
        return f'["{text}"]'

    assert cache.extract(chunks, extractor).count() == 2

    def never(text):
        raise AssertionError

    assert sorted(r.reply for r in cache.extract(chunks.where("text <> 'fail'"), never).collect()) == ['["a"]', '["b"]']
    known, fresh = cache.split(chunks)
    assert known.count() == 3 and [r.text for r in fresh.collect()] == ["fail"]


def test_retrieval_cache(spark, tmp_path):
    cache = files.RetrievalCache(spark, str(tmp_path / "r"))
    make = lambda context, error=None: spark.createDataFrame([("text_rag", 3, "q", context, 0.5, error)], "method string, k int, question string, context string, latency double, error string")
    cache.save(make("old"), 1)
    cache.save(make("new"), 2)
    cache.save(make("failed", "e"), 3)
    runs = spark.createDataFrame([("text_rag", 3, "q"), ("text_rag", 5, "q")], "method string, k int, question string")
    assert {r.k: r.context for r in cache.lookup(runs).collect()} == {3: "new", 5: None}


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "T", "I")], "name string, type string, abstraction string")
    files.write_nodes(nodes, str(tmp_path / "n"))
    files.write_canonical_map(spark.createDataFrame([("a", "b")], "name string, canonical string"), str(tmp_path / "m"))
    files.write_graph(nodes, nodes, str(tmp_path / "g"))
    for _ in range(2):
        files.append_results(nodes, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 2 and spark.read.json(str(tmp_path / "n")).count() == spark.read.parquet(str(tmp_path / "g/edges")).count() == 1


def test_stream_appends_only_what_is_new(spark, tmp_path):
    schema = "model_id string, method string, k int, question string"
    out, results = "answer string, batch int", str(tmp_path / "results")
    source = tmp_path / "in"

    def run(*questions):
        spark.createDataFrame([("m", "text_rag", 1, q) for q in questions], schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        answer_stream(stream, results, f"{schema}, {out}", lambda df: df.withColumn("answer", F.upper("question")), str(tmp_path / "ck")).awaitTermination(120)
        return sorted(r.answer for r in spark.read.parquet(results).collect())

    assert run("a", "b", "a") == ["A", "B"]
    assert run("b", "c") == ["A", "B", "C"]
