"""Passages to graph and to questions, with stand-ins for the models."""

import json

import pytest

from tessera.plans import pipelines
from tessera.sources import files, models


def test_graph_from_passages(spark, tmp_path):
    passages = spark.createDataFrame([("a", "Rider is calm. The horse has speed."), ("b", "rider  is calm.\n\nTempo makes rhythm."), ("c", "")], "source string, text string")
    cache = files.ExtractionCache(spark, str(tmp_path / "cache"))
    extractor = models.with_retries(models.pattern_extractor())
    built = pipelines.build_graph(passages, extractor, cache, adjudicator=lambda names: {n: min(names) for n in names})
    edges = {(r.source, r.relation, r.target) for r in built.edges.collect()}
    assert ("Rider", "IS", "calm") in edges and ("Tempo", "MAKES", "rhythm") in edges and ("rider", "IS", "calm") not in edges
    assert {r.name for r in built.nodes.collect()} == {n for s, _, t in edges for n in (s, t)}

    def never(text):
        raise AssertionError

    again = pipelines.build_graph(passages, never, cache, known=built.canonical)
    assert {(r.source, r.relation, r.target) for r in again.edges.collect()} == edges


def test_questions_from_passages(spark):
    text = "gaits tempo " + "word " * 110
    passages = spark.createDataFrame([(i, f"s{i}", 0, text + f" only{i}") for i in range(4)], "passage_id long, source string, chunk_id long, text string")
    reply = json.dumps([{"question": "According to the text, what is tempo?", "answer": "a", "key_facts": ["f"]}])
    rows = pipelines.questions(passages, lambda t: f"Here: {reply}", 2, 1).collect()
    assert len(rows) == 3 and all(r.question == "What is tempo?" and r.facts == ["f"] and r.category == "Lookup" for r in rows)
    assert {r.source_type for r in rows} == {"local", "global"}


def test_retries():
    replies = iter(["no", "{'a'", '{"a": 1,}'])
    seen = []

    def call(prompt):
        seen.append(prompt)
        return next(replies)

    assert models.with_retries(call)("p") == '{"a": 1,}' and seen == ["p", "p" + models.STRICTER, "p" + models.STRICTER]
    with pytest.raises(ValueError):
        models.with_retries(lambda p: "none", 1)("p")
