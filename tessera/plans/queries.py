"""Queries by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, json_repair
from ..functions import text as t
from ..operators import clustering, contents, evaluation, graph, mining, ranking, retrieve
from ..sources import files
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TOP = 50


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


PASSAGE_TOKENS = "list_filter(string_split_regex(lower(strip_accents({})), '\\s+'), lambda w: w <> '')"
TERM_STATS = f"""
tok AS MATERIALIZED (SELECT doc_id, {PASSAGE_TOKENS.format("text")} AS w FROM documents),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM tok) GROUP BY term),
size_ AS (SELECT count(*) AS n, avg(CAST(len(w) AS DOUBLE)) AS avgdl FROM tok),
raw_ AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM dfs, size_),
mean_ AS (SELECT avg(idf) AS mean FROM raw_),
stats AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean ELSE idf END AS idf FROM raw_, mean_)"""
BM25 = f"""{TERM_STATS},
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({PASSAGE_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT doc_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM tok) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(times * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
       FROM qt JOIN stats USING (term) JOIN post USING (term), size_ GROUP BY ALL),
bmr AS (SELECT query_id, doc_id, round(score, 4) AS score FROM bm)"""
DENSE = """
de AS (SELECT q.vec_id // 50 AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score
       FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"""


def _ranked(name: str, n: int) -> str:
    return f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name}) WHERE rank <= {n})"


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM {_ranked('bmr', TOP)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(ranking.bm25_top(b.corpus(spark, sf_dir), b.asked(spark, sf_dir), t.passage_tokens, TOP, 4), TOP)


@query(f"WITH {TERM_STATS} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM stats")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = files_free(ranking.bm25_index(b.corpus(spark, sf_dir), t.passage_tokens))
    return ranking.term_stats(index).withColumn("idf", F.round("idf", 6))


@query(f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM {_ranked('de', TOP)}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dense(b.vectors(spark, sf_dir), b.vector_queries(spark, sf_dir), TOP)


FUSED = f"fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM {_ranked('de', TOP)} UNION ALL SELECT query_id, doc_id, rank FROM {_ranked('bmr', TOP)}) GROUP BY ALL)"


@query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, doc_id, score, rank FROM {_ranked('fu', TOP)}")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ranking.rrf(dense_topk(spark, sf_dir), bm25_topk(spark, sf_dir))
    return ranking.top(fused.withColumn("score", F.round("score", 9)), TOP)


@query(f"""WITH {BM25}, {DENSE},
sp AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM bmr WHERE score > 0),
wf AS (SELECT coalesce(d.query_id, sp.query_id) AS query_id, coalesce(d.doc_id, sp.doc_id) AS doc_id, round(0.6::DOUBLE * coalesce(d.score, 0) + 0.4::DOUBLE * coalesce(s, 0), 6) AS score
       FROM {_ranked("de", 30)} d FULL OUTER JOIN sp ON d.query_id = sp.query_id AND d.doc_id = sp.doc_id)
SELECT query_id, doc_id, score, rank FROM {_ranked("wf", 20)}""")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = files_free(ranking.dense(b.vectors(spark, sf_dir), b.vector_queries(spark, sf_dir), 30))
    # sparse scores that differ by less than slack may be equal after rounding, and then ids decide
    slack = 2 * 10.0**-ranking.FUSED_DIGITS / ranking.SPARSE_WEIGHT
    sparse = ranking.bm25_top(b.corpus(spark, sf_dir), b.asked(spark, sf_dir), t.passage_tokens, 20, 4, near.select("query_id", "doc_id"), slack)
    return ranking.top(ranking.weighted_fusion(near, sparse).withColumn("score", F.round("score", ranking.FUSED_DIGITS)), 20)


LEXICAL = "list_distinct(list_filter(string_split_regex(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""WITH {BM25}, c AS (SELECT query_id, doc_id, {LEXICAL.format("b.text")} AS q, {LEXICAL.format("d.text")} AS x FROM {_ranked("bmr", TOP)} JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)),
s AS (SELECT query_id, doc_id, len(list_intersect(q, x)) AS i, len(q) + len(x) AS u FROM c),
r AS (SELECT query_id, doc_id, round(CASE WHEN u - i > 0 THEN 8.0::DOUBLE * i / (u - i) - 4 ELSE -4 END, 9) AS score FROM s)
SELECT query_id, doc_id, score, rank FROM {_ranked("r", 10)}""")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rerank(bm25_topk(spark, sf_dir), b.asked(spark, sf_dir), b.corpus(spark, sf_dir), 10).drop("text")


@query("SELECT doc_id, lower(strip_accents(text)) AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.corpus(spark, sf_dir).select("doc_id", t.normalize_text(F.col("text")).alias("text"))


@query("SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS text FROM pages")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", t.clean_text(F.col("html")).alias("text"))


@query()
def chunk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = b.table(spark, sf_dir, "documents").select("doc_id", "source", t.clean_text(F.col("text")).alias("text"))
    return chunking.chunked(cleaned, 1000, 200)


def _sentence_sql() -> str:
    out = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    for plain in sorted(t.ABBREVIATIONS["en"], key=lambda a: (-len(a), a)):
        for form in (plain, plain[0].upper() + plain[1:]):
            out = f"replace({out}, '{form}', '{form.replace('.', t.PROTECTED_STOP)}')"
    split = f"string_split(regexp_replace({out}, '([.!?…]+)([)\"»’”\\]]*)\\s+', '\\1\\2' || chr(1), 'g'), chr(1))"
    kept = f"list_filter(list_transform({split}, lambda s: trim(replace(s, '{t.PROTECTED_STOP}', '.'))), lambda s: length(s) >= 2 AND s <> '{t.EMPTY_PAGE}')"
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {kept} AS s FROM documents))"


@query(_sentence_sql())
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(t.sentences(F.col("text"), F.col("lang"))).alias("place", "sentence"))


PUNCTUATION = "translate({}, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"
BRIDGE = f"""kw AS (SELECT DISTINCT doc_id, source, unnest(string_split_regex(lower({PUNCTUATION.format("text")}), '\\s+')) AS keyword FROM documents),
kws AS (SELECT * FROM kw WHERE length(keyword) > 4 AND keyword NOT IN ({", ".join(f"'{w}'" for w in t.BRIDGE_STOP_WORDS)})),
rare AS (SELECT keyword, count(*) AS df FROM kws GROUP BY keyword HAVING count(*) >= 2 AND count(*) < 30)"""


@query(f"WITH {BRIDGE} SELECT keyword, df, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM kws JOIN rare USING (keyword) GROUP BY ALL")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.keyword_index(b.passages(spark, sf_dir)).select("keyword", "df", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"""WITH {BRIDGE}, held AS (SELECT keyword, doc_id, source FROM kws JOIN rare USING (keyword)),
p AS (SELECT l.keyword, min((l.doc_id, r.doc_id)) AS p FROM held l JOIN held r ON l.keyword = r.keyword AND l.doc_id < r.doc_id AND (l.source <> r.source OR abs(l.doc_id - r.doc_id) > 10) GROUP BY l.keyword)
SELECT p[1] AS a, p[2] AS b, min(keyword) AS keyword FROM p GROUP BY ALL""")
def bridged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.bridged_pairs(b.passages(spark, sf_dir))


@query(f"""SELECT item_id AS query_id, array_to_string(list_filter(string_split_regex({PUNCTUATION.format("lower(strip_accents(text))")}, '\\s+'), lambda w: length(w) > 3 AND w NOT IN ({", ".join(f"'{w}'" for w in t.QUERY_STOP_WORDS)})), ' ') AS terms FROM benchmark""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.asked(spark, sf_dir).select("query_id", F.array_join(t.search_terms(F.col("text")), " ").alias("terms"))


TRIPLES = """tr AS (SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS seq, l_returnflag AS relation, l_returnflag = 'R' AS back, s_name, p_brand, p_type,
  CASE WHEN l_returnflag = 'R' THEN p_brand ELSE s_name END AS source, CASE WHEN l_returnflag = 'R' THEN s_name ELSE p_brand END AS target, l_linestatus AS modality, CASE WHEN l_linenumber > 1 THEN p_type END AS instruction
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""
EDGES = f"{TRIPLES}, ed AS (SELECT source, relation, target, list_sort(list_distinct(list(modality))) AS m, list_sort(list_distinct(list_filter(list(instruction), lambda x: x IS NOT NULL))) AS i FROM tr GROUP BY ALL)"
PROPS = "CASE WHEN len(i) > 0 THEN 'instruction=' || array_to_string(i, '/') || ';' ELSE '' END || CASE WHEN len(m) > 0 THEN 'modality=' || array_to_string(m, '/') || ';' ELSE '' END"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fuse_edges(b.triples(spark, sf_dir), ["instruction", "modality"])


def _flat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with qualifiers as text, as an engine reads them."""
    return _edges(spark, sf_dir).withColumn("properties", F.transform_values("properties", lambda k, v: F.array_join(v, "/")))


@query(f"WITH {EDGES} SELECT source, relation, target, {PROPS} AS properties FROM ed")
def kg_fuse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "/"), F.lit(";"))), "")
    return _edges(spark, sf_dir).select("source", "relation", "target", text.alias("properties"))


NODES = f"""{TRIPLES}, en AS (SELECT source AS name, seq * 2 AS spot, CASE WHEN back THEN p_type ELSE 'Supplier' END AS type, CASE WHEN back THEN 'Category' ELSE 'Instance' END AS abstraction FROM tr
  UNION ALL SELECT target, seq * 2 + 1, CASE WHEN back THEN 'Supplier' ELSE p_type END, CASE WHEN back THEN 'Instance' ELSE 'Category' END FROM tr),
no AS (SELECT name, arg_min(type, spot) AS type, arg_min(abstraction, spot) AS abstraction FROM en GROUP BY name)"""


@query(f"WITH {NODES} SELECT name, type, abstraction FROM no")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_metadata(b.triples(spark, sf_dir))


@query(f"""WITH {TRIPLES}, s AS (SELECT count(*) AS triples, (SELECT count(DISTINCT n) FROM (SELECT source AS n FROM tr UNION ALL SELECT target FROM tr)) AS nodes, count(DISTINCT relation) AS relations FROM tr),
o AS (SELECT count(*) AS triples, (SELECT count(DISTINCT n) FROM (SELECT source AS n FROM tr WHERE relation = 'R' UNION ALL SELECT target FROM tr WHERE relation = 'R')) AS nodes, count(DISTINCT relation) AS relations FROM tr WHERE relation = 'R')
SELECT 'triples' AS metric, s.triples AS new, o.triples AS old, s.triples - o.triples AS diff FROM s, o UNION ALL SELECT 'nodes', s.nodes, o.nodes, s.nodes - o.nodes FROM s, o UNION ALL SELECT 'relations', s.relations, o.relations, s.relations - o.relations FROM s, o""")
def kg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = b.triples(spark, sf_dir)
    return graph.compare_stats(graph.extraction_stats(all_), graph.extraction_stats(all_.where("relation = 'R'")))


@query(f"WITH {NODES} SELECT type AS value, count(*) AS count FROM no GROUP BY type ORDER BY count DESC, value LIMIT 10")
def kg_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.histogram(kg_nodes(spark, sf_dir), "type")


@query("""WITH m AS (SELECT p_name AS name, min(p_name) OVER (PARTITION BY p_brand, p_size) AS canonical, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, p_type, coalesce(canonical, p_name) AS p_name FROM part LEFT JOIN (SELECT name, canonical FROM m WHERE n = 1) ON name = p_name""")
def canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = b.table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name"), F.min("p_name").over(Window.partitionBy("p_brand", "p_size")).alias("canonical"), "p_partkey")
    first = names.groupBy("name").agg(F.min_by("canonical", "p_partkey").alias("canonical"))
    return graph.canonicalise(part.select("p_partkey", "p_type", "p_name"), first, ["p_name"]).select("p_partkey", "p_type", "p_name")


SEARCH_TEXT = f"""{EDGES}, pt AS (SELECT DISTINCT source AS id, array_to_string(list_filter([array_to_string(i, '/'), array_to_string(m, '/')], lambda x: x <> ''), ' ') AS t FROM ed),
ids AS (SELECT source AS id FROM ed UNION SELECT target FROM ed),
st AS (SELECT id, trim('Concept: ' || replace(id, '_', ' ') || '. ' || coalesce(c, '')) AS search_text FROM ids LEFT JOIN (SELECT id, string_agg(t, ' ' ORDER BY t) AS c FROM pt WHERE t <> '' GROUP BY id) USING (id))"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.load_graph(_flat_edges(spark, sf_dir).withColumn("line", F.lit(0)))


@query(f"WITH {SEARCH_TEXT} SELECT id, search_text FROM st")
def node_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.node_search_text(nodes, edges)


@query(f"""WITH {SEARCH_TEXT}, q(query_id, text) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in b.GRAPH_QUESTIONS)}),
te AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(string_split_regex({PUNCTUATION.format("lower(strip_accents(text))")}, '\\s+'), lambda w: length(w) > 3 AND w NOT IN ({", ".join(f"'{w}'" for w in t.QUERY_STOP_WORDS)}))) AS term FROM q) GROUP BY ALL),
h AS (SELECT CAST(query_id AS BIGINT) AS query_id, id AS doc_id, sum(times) * CASE WHEN bool_or(contains(lower(id), term)) THEN 10.0::DOUBLE ELSE 1.0 END AS score FROM st JOIN te ON contains(lower(search_text), term) GROUP BY ALL)
SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, rank FROM {_ranked("h", 15)}""")
def keyword_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    described = retrieve.graph_nodes(nodes, edges).withColumnRenamed("id", "doc_id")
    return ranking.keyword_seeds(described, b.graph_questions(spark))


DEGREES = f"{EDGES}, li AS (SELECT DISTINCT source, target FROM ed), dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM li UNION ALL SELECT target FROM li) GROUP BY id)"


@query(f"WITH {DEGREES} SELECT id, degree, round(1.0::DOUBLE / ln(degree + 2.0::DOUBLE), 9) AS damped FROM dg")
def degree_hub_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.topology(_edges(spark, sf_dir))).select("id", "degree", F.round(graph.hub_penalty(F.lit(1.0), F.col("degree")), 9).alias("damped"))


ITERATIONS = 10


def _ppr_sql() -> str:
    seeds = ", ".join(f"({q}, '{i}')" for q, i in b.SEEDS)
    out = f"""{DEGREES}, sd(query_id, id) AS (VALUES {seeds}), no_ AS (SELECT DISTINCT id FROM dg), fl AS (SELECT source, target, count(*) OVER (PARTITION BY source) AS o FROM li),
pr AS (SELECT query_id, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS p FROM sd),
x0 AS MATERIALIZED (SELECT query_id, id, 1.0::DOUBLE / (SELECT count(*) FROM no_) AS x FROM (SELECT DISTINCT query_id FROM sd), no_)"""
    for i in range(1, ITERATIONS + 1):
        out += f""",
x{i} AS MATERIALIZED (SELECT s.query_id, s.id, 0.85::DOUBLE * coalesce(f.x, 0) + coalesce(p, 0) * (0.85::DOUBLE * coalesce(d.x, 0) + (1 - 0.85::DOUBLE)) AS x FROM x{i - 1} s
  LEFT JOIN (SELECT query_id, target AS id, sum(x / o) AS x FROM x{i - 1} JOIN fl ON source = id GROUP BY ALL) f ON f.query_id = s.query_id AND f.id = s.id
  LEFT JOIN (SELECT query_id, sum(x) AS x FROM x{i - 1} WHERE id NOT IN (SELECT source FROM fl) GROUP BY query_id) d ON d.query_id = s.query_id
  LEFT JOIN pr ON pr.query_id = s.query_id AND pr.id = s.id)"""
    return out


PPR = _ppr_sql()


def _ppr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = files_free(_flat_edges(spark, sf_dir))
    links = graph.topology(edges)
    nodes = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graph.personalised_pagerank(links, nodes, b.seeds(spark), iterations=ITERATIONS), links, edges


def files_free(df: DataFrame) -> DataFrame:
    """df as a table of its own, for plans that use it several times."""
    from ..sources.shared import materialize

    return materialize(df)


@query(f"WITH {PPR}, r AS (SELECT CAST(query_id AS BIGINT) AS query_id, id AS doc_id, round(x, 6) AS score FROM x{ITERATIONS}) SELECT query_id, doc_id AS id, score, rank FROM {_ranked('r', 20)}")
def ppr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _, _ = _ppr(spark, sf_dir)
    return ranking.top(scores.withColumn("score", F.round("score", 6)), 20, tie="id")


@query(f"""WITH {PPR}, dn AS (SELECT query_id, id AS doc_id, round(x / ln(degree + 2.0::DOUBLE), 9) AS score FROM x{ITERATIONS} JOIN dg USING (id)),
ch AS (SELECT query_id, doc_id AS id FROM {_ranked("dn", 50)} UNION SELECT query_id, id FROM sd)
SELECT CAST(a.query_id AS BIGINT) AS query_id, source, relation, target FROM ed JOIN ch a ON a.id = source JOIN ch c ON c.id = target AND c.query_id = a.query_id""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, links, edges = _ppr(spark, sf_dir)
    chosen = files_free(graph.top_nodes(scores, links, b.seeds(spark), 10))
    return graph.induced_edges(edges, chosen).select("query_id", "source", "relation", "target")


def _facts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    nodes, edges = (files_free(x) for x in _graph(spark, sf_dir))
    described = files_free(retrieve.graph_nodes(nodes, edges))
    questions = b.graph_questions(spark)
    return retrieve.graph_facts(nodes, edges, questions, retrieve.graph_seeds(described, questions, None, None), k, described, iterations=ITERATIONS)


@query()
def graph_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, 10)


def _text(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieve.text(b.corpus(spark, sf_dir), b.vectors(spark, sf_dir), b.asked(spark, sf_dir), b.vector_queries(spark, sf_dir), k)


TEXT_SQL = f"""WITH {BM25}, {DENSE}, {FUSED}, c AS (SELECT query_id, doc_id, {LEXICAL.format("b.text")} AS q, {LEXICAL.format("d.text")} AS x FROM {_ranked("fu", TOP)} JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)),
s AS (SELECT query_id, doc_id, len(list_intersect(q, x)) AS i, len(q) + len(x) AS u FROM c),
r AS (SELECT query_id, doc_id, round(CASE WHEN u - i > 0 THEN 8.0::DOUBLE * i / (u - i) - 4 ELSE -4 END, 9) AS score FROM s)
SELECT query_id, doc_id, score, rank FROM {_ranked("r", 5)}"""


@query(TEXT_SQL)
def text_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, 5).drop("text")


@query()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = retrieve.text_context(_text(spark, sf_dir, 3))
    return retrieve.hybrid(b.graph_questions(spark), texts, retrieve.graph_context(_facts(spark, sf_dir, 30)))


@query()
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(b.vectors(spark, sf_dir).withColumnRenamed("doc_id", "id"), 0.75)


@query()
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = b.table(spark, sf_dir, "part").select("p_name").distinct().select(F.xxhash64("p_name").alias("id"), F.col("p_name").alias("text"))
    found = clustering.clusters(clustering.encode(names, clustering.hashing_encoder()).select("id", "vec"), 0.4)
    return clustering.resolve(found.join(names, "id").select(F.col("text").alias("name"), "cluster"))


SCHEDULE = ", ".join(f"('{m}', {k})" for m, ks in evaluation.K_SCHEDULE.items() for k in ks)


@query(f"""WITH m(model_id) AS (VALUES ('a'), ('b')), s(method, k) AS (VALUES {SCHEDULE}), q AS (SELECT DISTINCT event_type AS question FROM events)
SELECT model_id, method, CAST(k AS INTEGER) AS k, question FROM m, s, q""")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("question")).distinct()
    models = spark.createDataFrame([("a",), ("b",)], "model_id string")
    return evaluation.grid(models, evaluation.k_schedule(spark), questions).select("model_id", "method", "k", "question")


@query("""WITH r AS (SELECT DISTINCT role AS model_id, 'chat' AS method, CAST(conv_id % 3 AS INTEGER) AS k, CAST(conv_id AS VARCHAR) AS question FROM conversations),
f AS (SELECT DISTINCT role AS model_id, 'chat' AS method, CAST(conv_id % 3 AS INTEGER) AS k, CAST(conv_id AS VARCHAR) AS question FROM conversations WHERE role = 'user' AND turn > 0)
SELECT * FROM r EXCEPT SELECT * FROM f""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of turns as runs; those count as finished whose user has come back."""
    log = b.table(spark, sf_dir, "conversations").select("turn", F.col("role").alias("model_id"), F.lit("chat").alias("method"), (F.col("conv_id") % 3).cast("int").alias("k"), F.col("conv_id").cast("string").alias("question"))
    return evaluation.pending(log.select(*evaluation.SIGNATURE).distinct(), log.where("model_id = 'user' and turn > 0"))


RUNS = "ru AS (SELECT event_type AS method, CAST(user_id % 5 AS INTEGER) AS k, CAST(user_id AS VARCHAR) AS question, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(value, 0) / 1000.0::DOUBLE)) AS score FROM events)"


@query(f"WITH {RUNS} SELECT method, k, round(avg(score), 6) AS accuracy, count(*) AS runs FROM ru GROUP BY ALL")
def experiment_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(b.runs(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {RUNS}, a AS (SELECT method, k, round(avg(score), 6) AS accuracy FROM ru GROUP BY ALL) SELECT method, k, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY accuracy DESC, k) AS n FROM a) WHERE n = 1")
def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_k(b.runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT round(avg(best), 6) AS oracle_accuracy, count(*) AS questions FROM (SELECT question, max(score) AS best FROM ru GROUP BY question)")
def oracle_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_per_question(b.runs(spark, sf_dir)).withColumn("oracle_accuracy", F.round("oracle_accuracy", 6))


@query(f"""WITH {RUNS}, e AS (SELECT question, method, max(score) AS s FROM ru GROUP BY ALL), w AS (SELECT question, method FROM e QUALIFY s = max(s) OVER (PARTITION BY question)),
a AS (SELECT question, min(method) AS method FROM w GROUP BY question HAVING count(*) = 1)
SELECT method, count(*) AS questions, round(count(*)::DOUBLE / (SELECT count(DISTINCT question) FROM ru), 6) AS share FROM a GROUP BY method""")
def unique_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.uniquely_best(b.runs(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, (coalesce(a.s, 0)::DOUBLE + coalesce(b.s, 0)::DOUBLE) / 2 AS score FROM (SELECT doc_id, quality AS s FROM labels) a
FULL OUTER JOIN (SELECT doc_id, least(1.0::DOUBLE, n_chars / 2000.0::DOUBLE) AS s FROM documents) b ON a.doc_id = b.doc_id""")
def judge_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges: the quality label, where there is one, and a score of the length."""
    quality = b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score"))
    length = b.table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 2000).alias("score"))
    return evaluation.consensus(quality, length, ["doc_id"], ["score"])


PRICE_VALUES = ", ".join(f"('{c}', {i}::DOUBLE, {o}::DOUBLE)" for c, i, o in evaluation.PRICES)


@query(f"""WITH p(model_category, i, o) AS (VALUES {PRICE_VALUES}), d AS (SELECT doc_id, n_chars, CASE doc_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'proprietary' END AS model_category FROM documents)
SELECT doc_id, model_category, round(2 * n_chars / 1e6::DOUBLE * i + n_chars / 1e6::DOUBLE * o, 9) AS est_cost_usd FROM d JOIN p USING (model_category)""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "small").when(F.col("doc_id") % 3 == 1, "large").otherwise("proprietary")
    rows = docs.select("doc_id", kind.alias("model_category"), (F.col("n_chars") * 2).alias("total_input_tokens"), F.col("n_chars").alias("output_tokens"))
    return evaluation.cost(rows, evaluation.prices(spark)).select("doc_id", "model_category", F.round("est_cost_usd", 9).alias("est_cost_usd"))


CONTENT_VALUES = ", ".join(f"({lv}, {n}, '{name}', {'NULL' if p is None else p}::INTEGER)" for lv, n, name, p, _ in b.CONTENTS)
SUB_VALUES = ", ".join(f"({lv}, {n}, '{s}', {at})" for lv, n, _, _, subs in b.CONTENTS for s, at in subs.items())


@query(f"""WITH c(level, num, name, page) AS (VALUES {CONTENT_VALUES}), sub(level, num, title, spot) AS (VALUES {SUB_VALUES}),
r AS (SELECT level, num, name, page AS start, lead(page) OVER (PARTITION BY level ORDER BY num) - 1 AS stop FROM c),
p AS (SELECT CAST(doc_id % 2 AS INTEGER) AS level, source AS book, CAST(doc_id AS INTEGER) AS page FROM documents),
a AS (SELECT p.level, book, p.page, coalesce(min(r.num), 0) AS chapter_num, coalesce(arg_min(r.name, r.num), 'Intro') AS chapter_name FROM p LEFT JOIN r ON r.level = p.level AND p.page BETWEEN r.start AND coalesce(r.stop, 2147483647) GROUP BY ALL),
ti AS (SELECT level, num, spot, string_agg(title, ' | ' ORDER BY title) AS titles, max(title) AS last_ FROM sub GROUP BY ALL),
w AS (SELECT a.*, sum(CASE WHEN chapter_num IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY level, book ORDER BY page) AS run FROM (SELECT a.*, ti.titles, ti.last_, lag(chapter_num) OVER (PARTITION BY a.level, book ORDER BY page) AS before FROM a LEFT JOIN ti ON ti.level = a.level AND ti.num = chapter_num AND ti.spot = page) a)
SELECT level, book, page, CAST(chapter_num AS INTEGER) AS chapter_num, chapter_name, coalesce(titles, last_value(last_ IGNORE NULLS) OVER (PARTITION BY level, book, run ORDER BY page), '') AS subchapter_name FROM w""")
def chapter_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = b.table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).cast("int").alias("level"), F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page"))
    found = contents.assign_chapters(pages, contents.chapter_ranges(files.toc(spark, b.CONTENTS)))
    return contents.carry_subchapters(found).select("level", "book", "page", "chapter_num", "chapter_name", "subchapter_name")


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS BIGINT) AS k, event_id % 4 <> 3 AS valid FROM events""")
def json_repair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties in four wrappings: bare, fenced, with a trailing comma in prose, and broken."""
    raw = b.table(spark, sf_dir, "events").select("event_id", "props")
    kind = F.col("event_id") % 4
    wrapped = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
        kind == 2, F.concat(F.lit("Here it is: "), F.regexp_replace("props", r"\}$", ", }"), F.lit(" as asked"))).otherwise(F.regexp_replace("props", r"[{}]", "("))
    fixed = raw.select("event_id", json_repair.repaired(wrapped).alias("j"))
    return fixed.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"), F.col("j").isNotNull().alias("valid"))


@query("SELECT event_type, CAST(user_id % 5 AS INTEGER) AS k, round(sum(value), 4) AS total, count(*) AS rows FROM events GROUP BY ROLLUP (event_type, CAST(user_id % 5 AS INTEGER))")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).cast("int").alias("k"), "value")
    return evaluation.cost_rollup(rows, ["event_type", "k"], "value").withColumn("total", F.round("total", 4))


@query(f"WITH {EDGES} SELECT source, relation, target, source || ' --[' || relation || ']--> ' || target || ' ({{' || array_to_string(list_filter([CASE WHEN len(i) > 0 THEN '\"instruction\": \"' || array_to_string(i, '/') || '\"' END, CASE WHEN len(m) > 0 THEN '\"modality\": \"' || array_to_string(m, '/') || '\"' END], lambda x: x IS NOT NULL), ', ') || '}})' AS triple FROM ed")
def triple_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_edges(spark, sf_dir).select("source", "relation", "target", t.triple_text(F.col("source"), F.col("relation"), F.col("target"), F.col("properties")).alias("triple"))


@query("SELECT item_id, md5(text) AS chunk_hash, upper(trim(text)[1]) || trim(text)[2:] AS question FROM benchmark")
def question_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = F.concat(F.lit("According to the text, "), F.col("text"))
    return b.table(spark, sf_dir, "benchmark").select("item_id", t.text_hash(F.col("text")).alias("chunk_hash"), t.clean_question(led).alias("question"))
