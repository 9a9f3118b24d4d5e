"""Hyper-relational graphs: fusing triples, names, statistics, topology, personalised PageRank, subgraphs, edge ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import node_data, property_text, readable_triple, triple_text, without_reference
from ..sources.shared import materialize
from .ranking import Scorer, lexical_score, top

QUALIFIERS = ["condition", "causality", "instruction", "intensity", "spatial_context", "frequency", "modality", "provenance"]
ALPHA, EDGE_LIMIT, MAX_SEEDS, SEED_SCORE, STRONG_SEED = 0.85, 70, 7, 0.05, 10.0


def canonicalise(df: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """df with each of the columns replaced by its canonical name, where the map (name, canonical) has one. A single step: targets are not followed."""
    for c in columns:
        known = names.select(F.col("name").alias(f"{c}_"), F.col("canonical").alias(f"{c}_to"))
        df = df.join(known, F.col(c) == F.col(f"{c}_"), "left").withColumn(c, F.coalesce(F.col(f"{c}_to"), F.col(c))).drop(f"{c}_", f"{c}_to")
    return df


def fuse_edges(triples: DataFrame, qualifiers: list[str] = QUALIFIERS) -> DataFrame:
    """One edge per (source, relation, target); per qualifier the sorted distinct values, qualifiers without values left out.

    Sets are built by partial aggregation, so repeated triples collapse before the shuffle.
    """
    sets = triples.groupBy("source", "relation", "target").agg(*[F.array_sort(F.collect_set(q)).alias(q) for q in qualifiers])
    filled = F.filter(F.array(*[F.struct(F.lit(q).alias("k"), F.col(q).alias("v")) for q in qualifiers]), lambda e: F.size(e["v"]) > 0)
    return sets.select("source", "relation", "target", F.map_from_entries(filled).alias("properties"))


def node_metadata(triples: DataFrame) -> DataFrame:
    """(name, type, abstraction) of the first mention by `seq`, the source of a triple before its target.

    triples: seq, source, source_type, source_abstraction, target, target_type, target_abstraction.
    """
    ends = [triples.select(F.col(end).alias("name"), F.struct(F.col("seq"), F.lit(i).alias("end")).alias("at"), F.struct(F.col(f"{end}_type").alias("type"), F.col(f"{end}_abstraction").alias("abstraction")).alias("m")) for i, end in enumerate(("source", "target"))]
    first = ends[0].unionByName(ends[1]).groupBy("name").agg(F.min_by("m", "at").alias("m"))
    return first.select("name", "m.type", "m.abstraction")


def extraction_stats(triples: DataFrame) -> DataFrame:
    """One row: triples, distinct nodes over both ends, distinct relations."""
    ends = triples.select(F.explode(F.array("source", "target")).alias("name"), F.lit(None).cast("string").alias("relation"), F.lit(0).alias("t"))
    all_ = ends.unionByName(triples.select(F.lit(None).cast("string").alias("name"), "relation", F.lit(1).alias("t")))
    return all_.agg(F.sum("t").alias("triples"), F.count_distinct("name").alias("nodes"), F.count_distinct("relation").alias("relations"))


def histogram(df: DataFrame, column: str, n: int | None = 10) -> DataFrame:
    """(value, count), the n most frequent; all, if n is None."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return counts.limit(n) if n else counts


def compare_stats(new: DataFrame, old: DataFrame) -> DataFrame:
    """(metric, new, old, diff) of two extraction_stats rows."""
    rows = lambda df, name: df.unpivot([], ["triples", "nodes", "relations"], "metric", name)
    return rows(new, "new").join(rows(old, "old"), "metric", "full_outer").withColumn("diff", F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0)))


def load_graph(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, name; edges: source, target, relation, properties) of edge rows with `line`; of equal node ids and of equal property
    keys of an edge the last line counts. Ends are names or JSON objects (id, label, name). Parallel relations stay apart. Types of `nodes` (name, type) become labels."""
    ends = edges.select("*", node_data(F.col("source")).alias("s_"), node_data(F.col("target")).alias("t_"))
    entries = ends.select(F.col("s_.id").alias("source"), F.col("t_.id").alias("target"), "relation", "line", F.explode_outer("properties").alias("k", "v"))
    last = entries.groupBy("source", "target", "relation", "k").agg(F.max_by("v", "line").alias("v"))
    pairs = F.filter(F.collect_list(F.struct("k", "v")), lambda e: e["k"].isNotNull())
    merged = last.groupBy("source", "target", "relation").agg(F.map_from_entries(F.array_sort(pairs)).alias("properties"))
    mentions = ends.select(F.explode(F.array(F.struct("line", F.lit(0).alias("end"), "s_.*"), F.struct("line", F.lit(1).alias("end"), "t_.*"))).alias("m")).select("m.*")
    found = mentions.groupBy("id").agg(F.max_by(F.struct("label", "name"), F.struct("line", "end")).alias("m")).select("id", "m.label", "m.name")
    if nodes is not None:
        found = found.join(nodes.select(F.col("name").alias("id"), "type"), "id", "left").select("id", F.coalesce("type", "label").alias("label"), "name")
    return found, merged


def node_search_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, search_text): label, name and the sorted distinct property texts of the outgoing edges. nodes: id, label, name; edges with properties as a map of strings."""
    texts = edges.select(F.col("source").alias("id"), property_text(F.col("properties")).alias("t")).where("t <> ''")
    context = texts.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("ctx"))
    return nodes.join(context, "id", "left").select("id", F.trim(F.concat("label", F.lit(": "), "name", F.lit(". "), F.coalesce("ctx", F.lit("")))).alias("search_text"))


def topology(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree): ends of distinct (source, target) links; a loop counts twice."""
    return links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hub_penalty(score: Column, degree: Column) -> Column:
    return score / F.log(degree + F.lit(2.0))


def personalised_pagerank(links: DataFrame, nodes: DataFrame, seeds: DataFrame, alpha: float = ALPHA, iterations: int = 20, cut_every: int = 4) -> DataFrame:
    """(query_id, id, score) of every node for every query with seeds. links: distinct source, target; nodes: id; seeds: query_id, id.

    Restart and the mass of dangling nodes go to the seeds alone, so besides the start (1 / N for every node) a step needs only what flows along links and
    one sum per query. State is keyed by (query, node) and lies sparse until mass has spread; every few steps it is a table in the shared folder.
    """
    n = nodes.count()
    out = links.groupBy("source").agg(F.count("*").alias("outdegree"))
    flows = materialize(links.join(out, "source").select(F.col("source").alias("from_"), F.col("target").alias("to_"), "outdegree"))
    shares = seeds.distinct().withColumn("p", F.lit(1.0) / F.count("*").over(Window.partitionBy("query_id")))
    shares = materialize(shares.select("query_id", "id", "p"))
    queries = shares.select("query_id").distinct()
    sources = flows.select(F.col("from_").alias("id"), F.lit(1.0).alias("flowing")).distinct()
    marked = materialize(nodes.select("id").distinct().join(sources, "id", "left"))
    state = queries.join(marked.select("id")).withColumn("x", F.lit(1.0 / max(1, n)))
    for step in range(iterations):
        inflow = state.select("query_id", F.col("id").alias("from_"), "x").join(flows, "from_").groupBy("query_id", F.col("to_").alias("id")).agg(F.sum(F.col("x") / F.col("outdegree")).alias("in_"))
        dangling = state.join(marked.where("flowing is null").select("id"), "id").groupBy("query_id").agg(F.sum("x").alias("lost"))
        restart = shares.join(dangling, "query_id", "left").select("query_id", "id", (F.col("p") * (F.lit(1 - alpha) + F.lit(alpha) * F.coalesce("lost", F.lit(0.0)))).alias("back"))
        state = inflow.join(restart, ["query_id", "id"], "full_outer").select("query_id", "id", (F.lit(alpha) * F.coalesce("in_", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("x"))
        if (step + 1) % cut_every == 0 and step + 1 < iterations:
            state = materialize(state)
    full = queries.join(marked.select("id")).join(state, ["query_id", "id"], "left")
    return full.select("query_id", "id", F.coalesce("x", F.lit(0.0)).alias("score"))


def select_seeds(ranked: DataFrame, strong: DataFrame, most: int = MAX_SEEDS, least: float = SEED_SCORE, fallback: int = 3) -> DataFrame:
    """(query_id, id, score): by falling score, those that are strong by keyword or score above `least`; if a query has none, its first three. ranked: query_id, id, score in 0..1."""
    flagged = ranked.join(strong.select("query_id", "id").withColumn("strong", F.lit(True)), ["query_id", "id"], "left").withColumn("good", F.coalesce("strong", F.lit(False)) | (F.col("score") > least))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    any_good = F.max("good").over(Window.partitionBy("query_id"))
    placed = flagged.withColumn("any_good", any_good).withColumn("place", F.row_number().over(order)).where((F.col("any_good") & F.col("good")) | (~F.col("any_good") & (F.col("place") <= fallback)))
    return placed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query_id", "id", "score")


def induced_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, edge columns): edges with both ends among a query's chosen nodes (query_id, id)."""
    starts = edges.join(chosen.select("query_id", F.col("id").alias("source")), "source")
    return starts.join(chosen.select("query_id", F.col("id").alias("target")), ["query_id", "target"], "left_semi")


def top_nodes(scores: DataFrame, links: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(query_id, id): the max(50, 3 k) best nodes after the hub penalty, and the seeds."""
    damped = scores.join(degrees(links), "id", "left").select("query_id", "id", hub_penalty(F.col("score"), F.coalesce("degree", F.lit(0))).alias("score"))
    best = top(damped.withColumn("score", F.round("score", 9)), max(50, 3 * k), tie="id")
    return best.select("query_id", "id").union(seeds.select("query_id", "id")).distinct()


def named_edges(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """edges with source_name and target_name: the names of their nodes (id, name), the id where there is none. Sizes decide about broadcasts."""
    for end in ("source", "target"):
        if nodes is None:
            edges = edges.withColumn(f"{end}_name", F.col(end))
        else:
            known = nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
            edges = edges.join(known, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return edges


def rank_edges(candidates: DataFrame, seeds: DataFrame, queries: DataFrame, k: int, limit: int = EDGE_LIMIT, scorer: Scorer = lexical_score, nodes: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, triple, score): edges that touch a seed first, cut to `limit`, then by the scorer, the k best. Rendering, with the names of the nodes and
    without source_reference, comes after the cut."""
    marks = seeds.select("query_id", "id").distinct().withColumn("m", F.lit(1.0))
    touched = candidates
    for end in ("source", "target"):
        touched = touched.join(marks.select("query_id", F.col("id").alias(end), F.col("m").alias(f"m_{end}")), ["query_id", end], "left")
    weighed = touched.withColumn("heuristic", F.lit(1.0) + F.greatest(F.coalesce("m_source", F.lit(0.0)), F.coalesce("m_target", F.lit(0.0))))
    first = weighed.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("heuristic"), "source", "target", "relation"))).where(F.col("n") <= limit)
    asked = named_edges(first.join(queries.select("query_id", F.col("text").alias("query")), "query_id"), nodes)
    parts = (F.col("source_name"), F.col("relation"), F.col("target_name"), without_reference(F.col("properties")))
    rendered = asked.select("query_id", "source", "target", "relation", triple_text(*parts).alias("triple"), F.round(scorer(F.col("query"), readable_triple(*parts)), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "target", "relation")
    return rendered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "triple", "score")
