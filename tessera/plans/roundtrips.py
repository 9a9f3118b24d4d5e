"""Queries over sources, sinks, caches, prompts, model replies and selection steps, each with its SQL: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_repair, prompts
from ..functions import text as t
from ..operators import clustering, evaluation, graph, ranking, retrieve
from ..sources import files, models
from ..sources.shared import shared_dir
from . import bindings as b
from .queries import BM25, DENSE, EDGES, NODES, _edges, _ranked, kg_nodes, query


def _folder(spark: SparkSession) -> str:
    """A folder of its own among the shared ones; it goes with the session."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@query("SELECT item_id AS query_id, '' AS context FROM benchmark")
def baseline_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.baseline(b.asked(spark, sf_dir))


@query(f"WITH {EDGES} SELECT source, relation, target, CASE WHEN len(i) > 0 THEN array_to_string(i, '/') END AS instruction, CASE WHEN len(m) > 0 THEN array_to_string(m, '/') END AS modality FROM ed")
def edge_file_to_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to JSON lines, from there to a loaded graph."""
    path = _folder(spark)
    files.write_edges(_edges(spark, sf_dir), path)
    _, found = graph.load_graph(files.edges(spark, path))
    return found.select("source", "relation", "target", *[F.try_element_at("properties", F.lit(k)).alias(k) for k in ("instruction", "modality")])


@query(f"WITH {EDGES}, {NODES[NODES.index('en AS') :]} SELECT id, no.type AS label, id AS name FROM (SELECT source AS id FROM ed UNION SELECT target FROM ed) JOIN no ON no.name = id")
def node_file_to_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes to JSON lines and back; their types become the labels of the graph's nodes."""
    path = _folder(spark)
    files.write_nodes(kg_nodes(spark, sf_dir), f"{path}/nodes")
    files.write_edges(_edges(spark, sf_dir), f"{path}/edges")
    known = spark.read.schema("name string, type string, abstraction string").json(f"{path}/nodes")
    nodes, _ = graph.load_graph(files.edges(spark, f"{path}/edges"), known)
    return nodes.select("id", "label", "name")


@query("SELECT p_name AS name, min(p_name) AS canonical, count(*) AS n FROM part GROUP BY p_name")
def canonical_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    files.write_canonical_map(b.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("canonical")), path)
    return spark.read.schema("name string, canonical string").json(path).groupBy("name", "canonical").agg(F.count("*").alias("n"))


@query("SELECT 'q' || item_id AS question, text AS gold_context, ['f1', 'f2'][1] AS fact, 'Lookup' AS category FROM benchmark")
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to JSON lines and back in a seeded order, without a limit."""
    path = _folder(spark)
    made = b.asked(spark, sf_dir).select(F.concat(F.lit("q"), "query_id").alias("question"), F.array(F.lit("f1"), F.lit("f2")).alias("key_facts"), F.lit("lookup").alias("category"), F.col("text").alias("gold_context"))
    files.write_questions(made, path)
    back = files.sampled_questions(spark, path)
    return back.select("question", "gold_context", t.facts(F.col("facts"), F.col("key_facts"))[0].alias("fact"), t.category(F.col("category")).alias("category"))


@query("SELECT CAST(item_id AS BIGINT) AS ind, text AS question, '' AS answer, len(string_split(text, ' ')) AS n_terms, CAST(0 AS INTEGER) AS n_variants FROM benchmark WHERE item_id % 7 <> 3")
def question_data_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested questions; lines without data are left out, missing fields have defaults."""
    path = _folder(spark)
    data = F.when(F.col("query_id") % 7 != 3, F.struct(F.col("text").alias("question"), F.split("text", " ").alias("query_terms")))
    b.asked(spark, sf_dir).select(F.col("query_id").alias("ind"), data.alias("data")).write.json(path)
    return files.question_data(spark, path).select("ind", "question", "answer", F.size("query_terms").cast("long").alias("n_terms"), F.size("query_variants").alias("n_variants"))


@query("SELECT s_name AS source, n_name AS target, 'IN' AS relation FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey < 60")
def old_graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an earlier graph up to the first that can't be read, which stands before supplier 60."""
    path = _folder(spark)
    node = lambda name: F.struct(F.col(name).alias("name"), F.lit("Node").alias("label"))
    rows = b.table(spark, sf_dir, "supplier").join(b.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    line = F.when(F.col("s_suppkey") == 60, "{broken").otherwise(F.to_json(F.struct(node("s_name").alias("source"), node("n_name").alias("target"), F.lit("IN").alias("relation"))))
    rows.select("s_suppkey", line.alias("value")).coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)
    return files.old_graph(spark, path).select("source.name", "target.name", "relation").toDF("source", "target", "relation")


@query("""SELECT md5(text) AS chunk_hash, len(regexp_extract_all(text, '([a-z]+) (is|of|and) ([a-z]+)')) AS triples, 2 * count(*) AS chunks FROM documents GROUP BY text""")
def extraction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all documents, twice each; the second one finds everything in the cache."""
    cache = files.ExtractionCache(spark, _folder(spark))
    docs = b.corpus(spark, sf_dir).select("text")
    chunks = docs.union(docs)
    cache.extract(chunks, models.pattern_extractor(r"([a-z]+) (is|of|and) ([a-z]+)"))

    def never(text: str) -> str:
        raise AssertionError

    found = cache.extract(chunks, never).select("chunk_hash", F.expr("json_array_length(get_json_object(reply, '$.triples'))").cast("long").alias("triples"))
    known, fresh = cache.split(chunks)
    every = known.union(fresh.withColumn("chunk_hash", F.lit("not cached"))).groupBy("chunk_hash").agg(F.count("*").alias("chunks"))
    return every.join(found, "chunk_hash", "left")


@query("SELECT 'text_rag' AS method, CAST(item_id % 3 AS INTEGER) AS k, text AS question, CASE WHEN item_id % 2 = 0 THEN 'second ' || item_id END AS context FROM benchmark")
def retrieval_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts written twice, of which the last counts; what failed is not kept, so those runs find none."""
    cache = files.RetrievalCache(spark, _folder(spark))
    runs = b.asked(spark, sf_dir).select("query_id", F.lit("text_rag").alias("method"), (F.col("query_id") % 3).cast("int").alias("k"), F.col("text").alias("question"))
    for seq, word in enumerate(("first", "second")):
        kept = F.when(F.col("query_id") % 2 == 1, "failed")
        cache.save(runs.select("method", "k", "question", F.concat(F.lit(f"{word} "), "query_id").alias("context"), F.lit(0.1).alias("latency"), kept.alias("error")), seq)
    return cache.lookup(runs).select("method", "k", "question", "context")


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'plain ' || event_id ELSE coalesce(json_extract_string(props, '$.k'), '') END AS answer, event_id % 3 = 2 AS error,
CASE event_id % 3 WHEN 2 THEN 0 ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) / 5)), 6) END AS grade,
CASE event_id % 3 WHEN 0 THEN 2 END AS listed FROM events""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, grades and arrays out of replies: objects in prose with an array behind, bare objects, plain text."""
    rows = b.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    obj = F.concat(F.lit('{"answer": "'), F.coalesce("k", F.lit("")), F.lit('", "score": "'), F.coalesce("k", F.lit("")), F.lit('"}'))
    kind = F.col("event_id") % 3
    reply = F.when(kind == 0, F.concat(F.lit("Sure: "), obj, F.lit(" [1, 2]"))).when(kind == 1, obj).otherwise(F.concat(F.lit("plain "), "event_id"))
    read = rows.select("event_id", json_repair.answer(reply).alias("a"), json_repair.grade(reply).alias("g"), json_repair.greedy_array(reply).alias("l"))
    return read.select("event_id", "a.answer", "a.error", F.round("g", 6).alias("grade"), F.expr("json_array_length(l)").alias("listed"))


@query("SELECT p_partkey, p_name AS original_name, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name END AS target_canonical FROM part")
def adjudication_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions out of replies: an object with decisions, a bare array without target, and one that can't be read, which keeps its names."""
    kind = F.col("p_partkey") % 3
    one = F.concat(F.lit('{"original_name": "'), "p_name", F.lit('"'), F.when(kind == 0, F.concat(F.lit(', "target_canonical": "'), "p_brand", F.lit('"'))).otherwise(""), F.lit("}"))
    reply = F.when(kind == 0, F.concat(F.lit('{"decisions": ['), one, F.lit("]}"))).when(kind == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise("no reply")
    read = b.table(spark, sf_dir, "part").select("p_partkey", "p_name", json_repair.decisions(reply)[0].alias("d"))
    return read.select("p_partkey", F.coalesce("d.original_name", "p_name").alias("original_name"), "d.target_canonical")


def _brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.xxhash64("p_brand", "p_size", "p_type").alias("cluster"))


@query("WITH c AS (SELECT DISTINCT p_brand, p_size, p_type, p_name AS name FROM part) SELECT name, arg_min(name, (length(name), name)) OVER (PARTITION BY p_brand, p_size, p_type) AS canonical FROM c")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in groups of parts; single ones, pairs, and larger groups by the rule."""
    return clustering.resolve(_brand_names(spark, sf_dir))


@query("WITH s AS (SELECT count(*) AS n FROM part GROUP BY p_brand, p_size, p_type) SELECT count(*) FILTER (n = 1) AS singles, count(*) FILTER (n = 2) AS pairs, count(*) FILTER (n > 2) AS larger FROM s")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.size_classes(_brand_names(spark, sf_dir))


@query("SELECT DISTINCT name FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) WHERE name NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 10)")
def new_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = b.table(spark, sf_dir, "nation")
    ends = b.table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"))
    return clustering.new_names(ends, nation.where("n_nationkey < 10").select(F.col("n_name").alias("name")))


@query("SELECT doc_id, concat_ws(' | ', nullif(trim(source), ''), CASE WHEN doc_id % 5 > 0 THEN 'Chapter ' || (doc_id % 5) || ' ' || lang END, 'p. ' || doc_id) AS source_line, upper(lang[1]) || lower(lang[2:]) AS category FROM documents")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    return docs.select("doc_id", t.format_source(F.col("source"), F.col("doc_id") % 5, F.col("lang"), F.lit(""), F.col("doc_id")).alias("source_line"), t.category(F.col("lang")).alias("category"))


@query("SELECT lang AS value, count(*) AS count FROM documents WHERE length(text) > 500 GROUP BY lang")
def long_passage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import mining

    return graph.histogram(mining.long_passages(b.table(spark, sf_dir, "documents")), "lang", None)


@query("SELECT event_type AS category, least(7, count(DISTINCT user_id)) AS n FROM events GROUP BY event_type")
def capped_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven questions of each category in a seeded order; the limit is what the operator is for."""
    questions = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("question")).distinct()
    return evaluation.capped(questions, 7).groupBy("category").agg(F.count("*").alias("n"))


TOKENS = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]{{1,6}}|[^\\s\\p{{L}}\\p{{N}}]'))"


@query(f"""WITH c AS (SELECT doc_id, {TOKENS.format("lang")} AS q, {TOKENS.format("text")} AS x, {TOKENS.format("source")} AS p FROM documents)
SELECT doc_id, CAST(q AS INTEGER) AS question_tokens, CAST(x AS INTEGER) AS context_tokens, CAST(q + x AS INTEGER) AS gen_input_tokens, CAST(q + 2 * x AS INTEGER) AS total_input_tokens, CAST(CASE WHEN doc_id % 2 = 1 THEN doc_id ELSE p END AS BIGINT) AS output_tokens FROM c""")
def token_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of language as question, text as context and source as answer; the model's own count, where it has one."""
    rows = b.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("question"), F.col("text").alias("context"), F.col("source").alias("prediction"), (F.col("doc_id") * (F.col("doc_id") % 2)).alias("usage_out"))
    found = evaluation.token_columns(rows)
    return found.select("doc_id", "question_tokens", "context_tokens", "gen_input_tokens", "total_input_tokens", F.col("output_tokens").cast("long").alias("output_tokens"))


@query(f"""WITH {BM25}, z AS (SELECT query_id, doc_id, score FROM bmr UNION ALL SELECT query_id, doc_id, 0.0::DOUBLE FROM (SELECT q.query_id, d.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY d.doc_id) AS n
  FROM (SELECT item_id AS query_id FROM benchmark) q, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 80) d WHERE NOT EXISTS (SELECT 1 FROM bmr WHERE bmr.query_id = q.query_id AND bmr.doc_id = d.doc_id)) WHERE n <= 40)
SELECT query_id, doc_id, score, rank FROM {_ranked("z", 40)}""")
def bm25_with_zero_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(ranking.bm25_filled(b.corpus(spark, sf_dir), b.asked(spark, sf_dir), t.passage_tokens, 40, 4), 40)


@query(f"WITH {DENSE}, sd AS (SELECT 'q' || query_id AS query_id, 'v' || doc_id AS doc_id, score FROM de) SELECT query_id, doc_id, score, rank FROM {_ranked('sd', 30)}")
def dense_node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours on ids that are text, as graph nodes have them."""
    vectors = b.vectors(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("v"), "doc_id"))
    return ranking.dense(vectors, b.vector_queries(spark, sf_dir).withColumn("query_id", F.concat(F.lit("q"), "query_id")), 30)


@query(f"""WITH {DENSE}, r AS (SELECT query_id, doc_id, round(1 / (1 + exp(-(score * 8 - 5))), 9) AS score FROM {_ranked("de", 20)}),
f AS (SELECT *, score > 0.05 OR doc_id % 10 = 0 AS good FROM r),
g AS (SELECT *, max(good) OVER (PARTITION BY query_id) AS any_good, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM f),
h AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM g WHERE (any_good AND good) OR (NOT any_good AND place <= 3))
SELECT query_id, id, score FROM h WHERE n <= 7""")
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds out of dense candidates after the sigmoid; ids that end in 0 count as strong."""
    near = ranking.dense(b.vectors(spark, sf_dir), b.vector_queries(spark, sf_dir), 20)
    ranked = near.select("query_id", F.col("doc_id").alias("id"), F.round(ranking.sigmoid(F.col("score") * 8 - 5), 9).alias("score"))
    return graph.select_seeds(ranked, ranked.where("id % 10 = 0").select("query_id", "id"))


@query("""SELECT item_id, md5('Answer from the context, as JSON with the field answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '(no context was found)' ELSE text END || chr(10) || chr(10) || 'Question: ' || text) AS answer_prompt,
length(substr(repeat(text, 200), 1, 5000)) AS teacher_cut, md5('List the facts of the passage as JSON triples with source, relation, target and qualifiers.' || chr(10) || chr(10) || 'Passage:' || chr(10) || text) AS extraction_prompt FROM benchmark""")
def prompt_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    context = F.when(F.col("query_id") % 2 == 0, "  a ").otherwise(text)
    head = prompts.teacher_prompt(F.lit(""))
    return b.asked(spark, sf_dir).select(
        F.col("query_id").alias("item_id"), F.md5(prompts.answer_prompt(text, context).cast("binary")).alias("answer_prompt"),
        (F.length(prompts.teacher_prompt(F.repeat(text, F.lit(200)))) - F.length(head)).cast("long").alias("teacher_cut"), F.md5(prompts.extraction_prompt(text).cast("binary")).alias("extraction_prompt"),
    )


@query("SELECT CAST(item_id AS BIGINT) AS item_id, CAST(0 AS INTEGER) AS chunk_id, text AS chunk FROM benchmark WHERE length(text) BETWEEN 1 AND 4000")
def split_chunks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in a lateral join; texts no longer than the size stay whole."""
    from ..functions import chunking

    chunking.register(spark)
    rows = b.asked(spark, sf_dir).where("length(text) between 1 and 4000").select(F.col("query_id").alias("item_id"), "text")
    return spark.sql("select item_id, chunk_id, chunk from {rows}, lateral split_chunks(text, 4000, 100)", rows=rows)
