"""Text functions, chunking and JSON repair on small cases with known results."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking, json_repair, prompts
from tessera.functions import text as t


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}").coalesce(1)
    return [r[0] for r in df.select(make(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("Aa bb. Cc dd. Ee ff. Gg hh. Ii jj", 16, 5, ["Aa bb. Cc dd", "Cc dd. Ee ff", "Ee ff. Gg hh", "Gg hh. Ii jj"]),
        ("Aa bb. Cc dd. Ee ff. Gg hh. Ii jj", 16, 0, ["Aa bb. Cc dd", "Ee ff. Gg hh", "Ii jj"]),
        ("abcdefghij", 4, 2, ["abcd", "cdef", "efgh", "ghij"]),
        ("one two. " + "x" * 20 + ". three", 12, 0, ["one two", "x" * 20, "three"]),
        ("", 5, 1, []),
        ("short", 5, 1, ["short"]),
    ],
)
def test_chunks(text, size, overlap, want):
    assert chunking.chunks(text, size, overlap) == want


def test_chunked_rows_and_table_function(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.chunk_id, r.text) for r in chunking.chunked(df, 4, 2).orderBy("id", "chunk_id").collect()] == [(1, i, x) for i, x in enumerate(["abcd", "cdef", "efgh", "ghij"])]
    chunking.register(spark)
    df.createOrReplaceTempView("chunk_input")
    assert spark.sql("select id, chunk from chunk_input, lateral split_chunks(text, 4, 2)").count() == 4


def test_batches_of_text_are_cut_into_slices(spark, monkeypatch):
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 10, "c" * 50, "", "é" * 6, "d"]
    whole = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": pa.array(texts, pa.string())})
    monkeypatch.setattr(chunking, "SLICE_BYTES", 20)
    parts = list(chunking.slices(whole, 1))
    assert [p["text"].to_pylist() for p in parts] == [["a" * 10, None, "b" * 10], ["c" * 50], ["", "é" * 6, "d"]]
    assert list(chunking.slices(whole.slice(0, 0), 1)) == [] and [p["id"].to_pylist() for p in chunking.slices(whole.slice(2, 3), 1)] == [[2], [3], [4]]


def test_sentences(spark):
    text = 'See e.g. the gait. It is an animal. Next one! "Really?" Yes. A'
    df = spark.createDataFrame([(text, "en")], "x string, lang string")
    assert df.select(t.sentences(F.col("x"), F.col("lang"))).first()[0] == ["See e.g. the gait.", "It is an animal. Next one!", '"Really?"', "Yes."]
    assert df.select(t.sentences(F.col("x"), F.col("lang"), whole_words=True)).first()[0] == ["See e.g. the gait.", "It is an animal.", "Next one!", '"Really?"', "Yes."]
    assert df.select(t.sentences(F.lit("Sjá bls. 5 og o.fl. hér. Já."), F.lit("is-IS"))).first()[0] == ["Sjá bls. 5 og o.fl. hér.", "Já."]
    assert df.select(t.sentences(F.lit(t.EMPTY_PAGE), F.lit(None).cast("string"))).first()[0] == []


def test_cleaning_and_normalizing(spark):
    assert values(spark, [" a \n b ", None], t.clean_text) == ["a b", None]
    rows = ["Ünï CÖDÉ", "éa", "ῼ", None, "ǅ"]
    assert values(spark, rows, t.normalize_text)[:2] == ["uni code", "ea"]
    assert values(spark, rows, t.normalize_exact)[:2] == ["uni code", "ea"]
    assert values(spark, ["rider's_x tölt"], t.title_case) == ["Rider'S_X Tölt"]


def test_terms(spark):
    assert values(spark, ["What does the Tölt, best of thé the gaits' affect?"], t.search_terms) == [["tolt", "gaits"]]
    assert values(spark, ["Horses' tempo! Tempo, the éclat training"], t.bridge_keywords) == [["tempo", "éclat"]]
    assert values(spark, ["  A b\tC "], t.node_tokens) == [["a", "b", "c"]]


def test_question_and_categories(spark):
    assert values(spark, ["According to the text, what is it?", "what does the text say about gaits", "", "éa"], t.clean_question) == ["What is it?", "What is gaits", "", "Éa"]
    assert values(spark, ["multi-hop", None, " lookup "], t.category) == ["Multi-hop", "Unknown", "Lookup"]


def test_triples_and_contexts(spark):
    props = F.create_map(F.lit("condition"), F.lit('In "tölt"'), F.lit("modality"), F.lit("Ideal"))
    row = spark.range(1).select(
        t.triple_text(F.lit("Rider"), F.lit("CONTROLS"), F.lit("Speed"), props), t.readable_triple(F.lit("Rider"), F.lit("CONTROLS"), F.lit("Speed"), props),
        t.triple_text(F.lit("a"), F.lit("b"), F.lit("c"), F.create_map().cast("map<string,string>")), t.bulleted(F.array(F.lit("x"), F.lit("y"))), t.hybrid_context(F.lit("T"), F.lit(None)),
        t.property_text(F.create_map(F.lit("a"), F.lit("x"), F.lit("source_reference"), F.lit("y"))), t.format_source(F.lit("B"), F.lit(0), F.lit("Intro"), F.lit(""), F.lit(3)),
    ).first()
    assert row[0] == 'Rider --[CONTROLS]--> Speed ({"condition": "In \\"tölt\\"", "modality": "Ideal"})'
    assert json.loads(row[0].split("(", 1)[1][:-1]) == {"condition": 'In "tölt"', "modality": "Ideal"}
    assert row[1] == 'Rider CONTROLS Speed. condition is In "tölt", modality is Ideal' and row[2] == "a --[b]--> c"
    assert row[3].endswith("- x\n- y") and row[4].endswith("## Graph\n") and row[5] == "x" and row[6] == "B | p. 3"


def test_node_data(spark):
    got = values(spark, ["the_rider's", '{"id": "n1", "label": "Gait"}', '{"id": "n2", "name": "Tölt"}'], t.node_data)
    assert [tuple(x) for x in got] == [("the_rider's", "Concept", "The Rider'S"), ("n1", "Gait", "n1"), ("n2", "Concept", "Tölt")]


def test_tokens_and_prompts(spark):
    assert values(spark, ["Unbelievable, yes", "", None], t.token_count) == [4, 0, 0]
    long = "x" * 9000
    row = spark.range(1).select(prompts.context_or_notice(F.lit(" a ")), prompts.context_or_notice(F.lit("abcdef")), F.length(prompts.teacher_prompt(F.lit(long))), prompts.judge_prompt(F.lit("q"), F.array(F.lit("f1"), F.lit("f2")), F.lit("p"), F.lit(long))).first()
    assert row[0] == prompts.NO_CONTEXT and row[1] == "abcdef" and 5000 < row[2] < 5200 and "f1\nf2" in row[3] and row[3].count("x") == 8000 + row[3].split("x" * 8000)[0].count("x")


def test_json_repair(spark):
    rows = ['Here: {"score": 4} ok', "```json\n[1,2]\n```", '{"a": [1,],}', "no json", None]
    assert values(spark, rows, json_repair.repaired) == ['{"score": 4}', "[1,2]", '{"a": [1]}', None, None]
    assert values(spark, rows, lambda c: json_repair.repaired(c, True))[2] == "[1]"
    assert values(spark, ['x {"score": 5}', '{"score": "3"}', '{"score": 7}', '{"score": -1}', "none"], json_repair.grade) == [1.0, 0.6, 1.0, 0.0, 0.0]
    got = values(spark, ['{"answer": "A"}', " plain text "], json_repair.answer)
    assert [tuple(x) for x in got] == [("A", False), ("plain text", True)]
    got = values(spark, ['{"decisions": [{"original_name": "The Rider", "action": "MERGE", "target_canonical": "Rider"}, {"original_name": "X"}]}', '[{"original_name": "Y", "target_canonical": "Z"}]', "?"], json_repair.decisions)
    assert [[tuple(d) for d in x] if x else x for x in got] == [[("The Rider", "Rider"), ("X", "X")], [("Y", "Z")], None]
    assert values(spark, ["a [1, [2]] b"], json_repair.greedy_array) == ["[1, [2]]"]
