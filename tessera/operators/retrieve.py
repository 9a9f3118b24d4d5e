"""Retrieval engines: none, text, graph, hybrid. Each gives ranked rows; contexts are strings made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bulleted, hybrid_context, node_tokens, passage_tokens
from ..sources.shared import materialize
from . import graph, ranking


def baseline(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lit("").alias("context"))


def text(passages: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int, scorer: ranking.Scorer = ranking.lexical_score, zero_scores: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank, text): dense and BM25 candidates, reciprocal rank fusion, rerank. passages: doc_id, text; vectors: doc_id, vec; query_vectors: query_id, vec."""
    candidates = max(5 * k, 50)
    sparse = (ranking.bm25_filled if zero_scores else ranking.bm25_top)(passages, queries, passage_tokens, candidates, 6)
    fused = ranking.rrf(ranking.dense(vectors, query_vectors, candidates), ranking.top(sparse, candidates)).withColumn("score", F.round("score", 9))
    return ranking.rerank(ranking.top(fused, candidates), queries, passages, k, scorer)


def text_context(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("r")).select("query_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("context"))


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, search_text) of a loaded graph."""
    return nodes.select("id", "name").join(graph.node_search_text(nodes, edges), "id")


def graph_seeds(described: DataFrame, queries: DataFrame, node_vectors: DataFrame | None, query_vectors: DataFrame | None, scorer: ranking.Scorer = ranking.lexical_score, most: int = graph.MAX_SEEDS) -> DataFrame:
    """(query_id, id, score): keyword net, hybrid search, rerank, selection. Without vectors the search is sparse."""
    docs = described.select(F.col("id").alias("doc_id"), F.col("search_text").alias("text"), "name", "search_text")
    hits = materialize(ranking.keyword_seeds(docs, queries, None))
    sparse = ranking.bm25(docs, queries, node_tokens).withColumn("score", F.round("score", 6))
    empty = sparse.where("false").select("query_id", "doc_id", "score")
    near = ranking.dense(node_vectors, query_vectors, 30) if node_vectors is not None and query_vectors is not None else empty
    hybrid = ranking.top(ranking.weighted_fusion(near.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "score"), sparse).withColumn("score", F.round("score", 6)), 20)
    pool = hybrid.select("query_id", "doc_id").union(ranking.top(hits, 15).select("query_id", "doc_id")).distinct()
    ranked = ranking.rerank(pool, queries, docs, 1 << 30, scorer).select("query_id", F.col("doc_id").alias("id"), F.round(ranking.sigmoid(F.col("score")), 9).alias("score"))
    return graph.select_seeds(ranked, hits.where(F.col("score") >= graph.STRONG_SEED).select("query_id", F.col("doc_id").alias("id")), most)


def graph_facts(nodes: DataFrame, edges: DataFrame, queries: DataFrame, seeds: DataFrame, k: int, described: DataFrame, scorer: ranking.Scorer = ranking.lexical_score, iterations: int = 20, limit: int = graph.EDGE_LIMIT) -> DataFrame:
    """(query_id, rank, line): the k best triples around the seeds, or, for queries whose subgraph has no edge, the texts of the first k seeds."""
    seeds = materialize(seeds)
    links = materialize(graph.topology(edges))
    scores = graph.personalised_pagerank(links, nodes.select("id"), seeds, iterations=iterations)
    chosen = materialize(graph.top_nodes(scores, links, seeds, k))
    found = materialize(graph.rank_edges(graph.induced_edges(edges, chosen), seeds, queries, k, limit, scorer, nodes).select("query_id", "rank", F.col("triple").alias("line")))
    bare = seeds.join(found.select("query_id").distinct(), "query_id", "left_anti").join(described.select("id", "search_text"), "id")
    texts = ranking.top(bare, k, tie="id").select("query_id", "rank", F.concat(F.lit("Node Info: "), "search_text").alias("line"))
    return found.unionByName(texts)


def graph_context(facts: DataFrame) -> DataFrame:
    lines: Column = F.transform("r", lambda x: x["line"])
    return facts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("r")).select("query_id", bulleted(lines).alias("context"))


def hybrid(queries: DataFrame, text_contexts: DataFrame, graph_contexts: DataFrame) -> DataFrame:
    """(query_id, context): both contexts under their heads; a side without result is empty. The text side asks for k, the graph side for 10 k."""
    both = queries.select("query_id").join(text_contexts.select("query_id", F.col("context").alias("t")), "query_id", "left").join(graph_contexts.select("query_id", F.col("context").alias("g")), "query_id", "left")
    return both.select("query_id", hybrid_context(F.col("t"), F.col("g")).alias("context"))
