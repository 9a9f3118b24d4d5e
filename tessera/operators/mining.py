"""Contexts for question writing: keyword index, single passages, pairs of distant passages that share a keyword."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bridge_keywords

LEAST_DF, MOST_DF, LEAST_DISTANCE, LEAST_LENGTH = 2, 30, 10, 500


def keyword_index(passages: DataFrame, least: int = LEAST_DF, below: int = MOST_DF) -> DataFrame:
    """(keyword, df, ids): keywords in at least `least` and fewer than `below` passages, with the sorted ids.

    Frequent keywords are dropped by their counts before any list is gathered, so no list grows past `below`.
    """
    words = passages.select("passage_id", F.explode(bridge_keywords(F.col("text"))).alias("keyword"))
    counts = words.groupBy("keyword").agg(F.count("*").alias("df")).where((F.col("df") >= least) & (F.col("df") < below))
    return words.join(counts, "keyword").groupBy("keyword", "df").agg(F.array_sort(F.collect_list("passage_id")).alias("ids"))


def bridged_pairs(passages: DataFrame, n: int | None = None, distance: int = LEAST_DISTANCE) -> DataFrame:
    """(a, b, keyword): for each rare keyword the first pair (by ids) of passages from different sources or further apart than `distance`; a pair that several keywords share has the
    first keyword. passages: passage_id, source, chunk_id, text. n limits the pairs (a sampling feature), in the order of a hash."""
    where = passages.select("passage_id", "source", "chunk_id")
    held = keyword_index(passages).select("keyword", F.explode("ids").alias("passage_id")).join(where, "passage_id")
    left = held.select("keyword", F.col("passage_id").alias("a"), F.col("source").alias("sa"), F.col("chunk_id").alias("ca"))
    right = held.select("keyword", F.col("passage_id").alias("b"), F.col("source").alias("sb"), F.col("chunk_id").alias("cb"))
    far = left.join(right, "keyword").where((F.col("a") < F.col("b")) & ((F.col("sa") != F.col("sb")) | (F.abs(F.col("ca") - F.col("cb")) > distance)))
    first = far.groupBy("keyword").agg(F.min(F.struct("a", "b")).alias("p"))
    pairs = first.groupBy("p.a", "p.b").agg(F.min("keyword").alias("keyword"))
    return pairs.orderBy(F.md5(F.col("keyword").cast("binary")), "a", "b").limit(n) if n else pairs


def local_contexts(passages: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n passages in a seeded order that does not depend on the partitions."""
    return passages.orderBy(F.xxhash64(F.lit(seed), "passage_id"), "passage_id").limit(n)


def long_passages(passages: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    return passages.where(F.length("text") > least)


def mixed_contexts(passages: DataFrame, n_local: int, n_global: int, seed: int = 42) -> DataFrame:
    """(text, source_type, ids): single passages and bridged pairs joined by a blank line."""
    local = local_contexts(passages, n_local, seed).select("text", F.lit("local").alias("source_type"), F.array("passage_id").alias("ids"))
    text = lambda side: passages.select(F.col("passage_id").alias(side), F.col("text").alias(f"t_{side}"))
    pairs = bridged_pairs(passages, n_global).join(text("a"), "a").join(text("b"), "b")
    return local.unionByName(pairs.select(F.concat_ws("\n\n", "t_a", "t_b").alias("text"), F.lit("global").alias("source_type"), F.array("a", "b").alias("ids")))


def generated(contexts: DataFrame, generator: Callable[[str], str]) -> DataFrame:
    """contexts with the generator's reply; a failure gives null and does not stop the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                try:
                    replies.append(generator(text))
                except Exception:  # noqa: BLE001
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*batch.schema.names, "reply"])

    return contexts.mapInArrow(run, contexts.withColumn("reply", F.lit(None).cast("string")).schema)
