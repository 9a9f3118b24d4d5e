"""Corpus preparation: stages over `documents`, each written as Parquet and read again as the next one's docs.

Every stage but the last returns the columns of its input, works on all rows it gets and applies its decisions:
toxicity drops the documents that its model rejects; near-duplicates keep the document with the smallest id of each group of
documents linked by a Jaccard similarity of 0.8 and more over 5-word shingles; repeats cuts passages that an
earlier document holds (texts are cut at whole letters, n_chars follows, a document that loses all its text goes); decontamination drops documents with
a passage of any benchmark item; mixing returns one row per copy taken, range-sorted by training position.

Nulls, empty tables and repeated rows have the results that the operators define; of repeated rows (same id, same text) one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import curriculum, decontaminate, near_copies, suffix_repeats, toxicity
from tessera.llm.common import table
from tessera.sources.shared import materialize, released

Docs = DataFrame


def carried(docs: Docs) -> Docs:
    """doc_id and text for an operator, and the other columns as one struct, so that their names can't clash with those of the operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row_"), "doc_id", "text")


def restored(found: DataFrame, docs: Docs, **made) -> Docs:
    """The columns of docs again, in their order; made: columns that the stage changes, where docs has them."""
    column = {c: F.col("text") if c == "text" else F.col("row_").getField(c) for c in docs.columns} | {c: v for c, v in made.items() if c in docs.columns}
    return found.select(*[column[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Without the documents that the toxicity model rejects. Null and empty texts stay; without labelled rows of both classes all stay; an empty table stays empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    return restored(toxicity.scored(carried(docs), model).where(F.col("toxic_score") < 0.5), docs)


def one_of_each_group(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """The document with the smallest id of each group of near copies (null ids only where a group has no other). Null and blank texts are one group. Of rows with one id the first by text and then by all columns as text stays."""
    found = released(lambda: near_copies.near_copies(docs, shingle=5, least=(4, 5)))
    winners = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("winner")).agg(F.count("*").alias("times"))
    kept = docs.join(winners, docs.doc_id.eqNullSafe(winners.winner), "left_semi")
    if not winners.where("times > 1").limit(1).count():
        return kept
    # rows of one id: the first one in an order that does not depend on partitions
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns]), {"ignoreNullFields": "false"})
    first = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row_"), "doc_id", F.struct("text", whole).alias("order_")).groupBy("doc_id").agg(F.min_by("row_", "order_").alias("row_"))
    return first.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Texts without the passages of 50 bytes and more that a document with a smaller id holds; documents that lose all their text go, rows of one id do not count against each other. Null and short texts stay as they are."""
    cut = suffix_repeats.without_repeats(carried(docs), length=50, with_text=True)
    changed = F.size("spans") > 0
    left = cut.where(~changed | (F.trim("kept_text") != ""))
    return restored(left, docs, text=F.col("kept_text"), n_chars=F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row_").getField("n_chars")) if "n_chars" in docs.columns else None)


def drop_contaminated(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Without the documents that hold a window of any benchmark item. Null and empty texts stay; an empty benchmark drops nothing."""
    return restored(decontaminate.scan(carried(docs), table(spark, sf_dir, "benchmark"), window=8).where(F.size("hit_items") == 0), docs)


def mix(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """One row for each copy that the curriculum takes, in training order, with pass, words and position; columns of these names are replaced. Documents without words are not taken; an empty table stays empty."""
    return curriculum.training_order(curriculum.curriculum(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
#: The toxicity model is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
