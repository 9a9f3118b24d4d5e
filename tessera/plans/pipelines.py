"""End-to-end plans: from passages to a graph, and from passages to questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, json_repair
from ..functions.text import category, clean_question, clean_text, facts
from ..operators import clustering, graph, mining
from ..sources.files import QUESTION, ExtractionCache
from ..sources.models import Call
from ..sources.shared import materialize

NODE = "struct<name:string,type:string,abstraction_level:string>"
TRIPLES = f"struct<triples:array<struct<source:{NODE},relation:string,target:{NODE},properties:struct<{','.join(f'{q}:string' for q in graph.QUALIFIERS)}>>>>"


def triples_of(replies: DataFrame) -> DataFrame:
    """One row per triple from (chunk_hash, reply). seq orders mentions by chunk hash and place, which no run of the extraction can change."""
    parsed = replies.select("chunk_hash", F.from_json(json_repair.repaired(F.col("reply")), TRIPLES)["triples"].alias("t"))
    rows = parsed.select("chunk_hash", F.posexplode("t").alias("place", "x")).where("x.source.name is not null and x.target.name is not null and x.relation is not null")
    return rows.select(
        F.struct("chunk_hash", "place").alias("seq"), F.col("x.source.name").alias("source"), F.col("x.source.type").alias("source_type"), F.col("x.source.abstraction_level").alias("source_abstraction"),
        "x.relation", F.col("x.target.name").alias("target"), F.col("x.target.type").alias("target_type"), F.col("x.target.abstraction_level").alias("target_abstraction"), "x.properties.*",
    )


@dataclass
class Graph:
    triples: DataFrame
    canonical: DataFrame
    nodes: DataFrame
    edges: DataFrame


def canonical_map(triples: DataFrame, encoder: Callable[[list[str]], list[list[float]]], adjudicator: clustering.Adjudicator, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """(name, canonical) of all names; those that `known` has are not resolved again."""
    spark = triples.sparkSession
    known = known if known is not None else spark.createDataFrame([], "name string, canonical string")
    fresh = materialize(clustering.new_names(triples, known).select(F.xxhash64("name").alias("id"), F.col("name").alias("text")))
    vectors = materialize(clustering.encode(fresh, encoder).select("id", "vec"))
    found = clustering.clusters(vectors, threshold).join(fresh, "id").select(F.col("text").alias("name"), "cluster")
    return known.select("name", "canonical").unionByName(clustering.resolve(found, adjudicator))


def build_graph(
    passages: DataFrame, extractor: Call, cache: ExtractionCache, encoder: Callable[[list[str]], list[list[float]]] | None = None,
    adjudicator: clustering.Adjudicator = clustering.rule_adjudicator, threshold: float = clustering.THRESHOLD, known: DataFrame | None = None, size: int = 1000, overlap: int = 200,
) -> Graph:
    """Clean, chunk, extract what the cache doesn't hold, resolve names, fuse edges."""
    chunks = chunking.chunked(passages.select("source", clean_text(F.col("text")).alias("text")), size, overlap)
    triples = materialize(triples_of(cache.extract(chunks, extractor)))
    names = materialize(canonical_map(triples, encoder or clustering.hashing_encoder(), adjudicator, threshold, known))
    mapped = graph.canonicalise(triples, names, ["source", "target"])
    return Graph(triples, names, graph.node_metadata(mapped), graph.fuse_edges(mapped))


def questions(passages: DataFrame, generator: Call, n_local: int = 40, n_global: int = 40, seed: int = 42) -> DataFrame:
    """Questions over single passages and bridged pairs, cleaned and labelled; contexts whose reply can't be read give none."""
    contexts = mining.mixed_contexts(mining.long_passages(passages), n_local, n_global, seed)
    replies = mining.generated(contexts, generator)
    item = F.from_json(json_repair.repaired(F.col("reply")), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in QUESTION.split(', '))}>>")
    rows = replies.select("source_type", F.substring("text", 1, 5000).alias("gold_context"), F.explode(item).alias("q")).where("q.question is not null")
    return rows.select(
        clean_question(F.col("q.question")).alias("question"), "q.answer", "q.rationale", facts(F.col("q.facts"), F.col("q.key_facts")).alias("facts"),
        category(F.col("q.category"), "Lookup", False).alias("category"), "q.difficulty", "source_type", "gold_context",
    )
