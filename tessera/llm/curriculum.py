"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight and a ramp. Its share of all tokens is its target; its weight schedule over training time t in
[0, 1] is the line g(t) = 1 + ramp * (2t - 1), whose integral G(t) = (1 - ramp) t + ramp t^2 says which part of the target
has been demanded by t. A document's tokens stand at a place of its source's running demand (whole passes first, then a
partial one), and inverting G at the middle of that place gives the training position. Range-sorting by position gives the
training order.

Defined cases: a null or empty text has size 0, is taken 0 times and has an empty schedule; a null source is a source of its
own, last in order; repeated rows each count, those of one id by size; an empty table gives an empty result; input columns named as the
added ones are replaced, all other names are kept apart; texts of any length are counted whole. The running sums are taken inside (source, hash bucket) groups plus offsets of the buckets, so a source that holds a
third of all rows is spread over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, id_text, without_clashes, word_count

ADDED = ["size", "source_size", "target", "taken", "schedule"]
BUCKET_HEX = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(k_null, k_source, s) per source -> the same with weight number `rank` (from 0) and `target`.

    Filling up to a common level: sources in order of the level at which they reach their cap; the level is the first one
    at which the next source stays below its cap. The input has one row per source, so its windows are narrow.
    """
    order = Window.orderBy("k_null", "k_source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", w.cast("long"))
    full = (F.col("s") * cap).cast("double") / F.col("w")
    before = Window.orderBy("full", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("s").over(whole) - F.coalesce(F.sum(F.col("s") * cap).over(before), F.lit(0))).cast("double") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    leveled = ranked.withColumn("full", full).withColumn("level", level)
    chosen = F.min(F.when(F.col("full") >= F.col("level"), F.struct("full", "rank", "level"))).over(whole)["level"]
    capped = (F.col("s") * cap).cast("double")
    return leveled.withColumn("chosen", chosen).select(
        "k_null", "k_source", "s", "rank",
        F.when(F.col("chosen").isNull() | (F.col("full") < F.col("chosen")), capped).otherwise(F.col("chosen") * F.col("w")).alias("target"),
    )


def demanded(t: Column, ramp: Column) -> Column:
    """Which part of a source's target its weight schedule has demanded by time t: (1 - ramp) t + ramp t^2."""
    return (F.lit(1.0) - ramp) * t + ramp * t * t


def demand_inverse(u: Column, ramp: Column) -> Column:
    """t in [0, 1] with (1 - ramp) t + ramp t^2 = u, in the form that is stable for small ramps."""
    b = F.lit(1.0) - ramp
    return F.least(F.lit(1.0), F.lit(2.0) * u / (b + F.sqrt(b * b + F.lit(4.0) * ramp * u)))


def curriculum(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ramps: tuple[float, ...] = (-0.6, 0.0, 0.6), cap: int = 3, size: Column | None = None
) -> DataFrame:
    """docs with size, source_size, target, taken and schedule: an array of (pass, words, position), one for each copy that is demanded before
    training ends. size: the words of a row, counted in its text if not given."""
    names = without_clashes(docs, ADDED).columns
    # columns travel under numbers, so that no name of theirs can clash with one made here
    inputs = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)]
    keyed = docs.select(
        *inputs, F.col("doc_id").alias("k_id"), F.col("source").isNull().cast("int").alias("k_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("k_source"),
        F.md5(id_text().cast("binary")).alias("k_hash"), (word_count(F.col("text"), SPACES) if size is None else size).alias("size"),
    ).withColumn("k_bucket", F.substring("k_hash", 1, BUCKET_HEX))
    buckets = keyed.groupBy("k_null", "k_source", "k_bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("k_null", "k_source").agg(F.sum("bucket_size").alias("s")), weights, cap)
    ahead = Window.partitionBy("k_null", "k_source").orderBy("k_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size").join(targets, ["k_null", "k_source"])
    inside = Window.partitionBy("k_null", "k_source", "k_bucket").orderBy("k_hash", "k_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, ["k_null", "k_source", "k_bucket"]).withColumn("k_start", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("offset"))
    ramp = F.element_at(F.array(*[F.lit(float(x)) for x in ramps]), (F.col("rank") % len(ramps) + 1).cast("int"))
    # the words that the source's schedule has demanded when training ends, and the last pass over the source that they reach
    goal = F.floor(F.col("target") * demanded(F.lit(1.0), ramp)).cast("long")
    placed = placed.withColumns({"k_goal": goal, "k_ramp": ramp})
    placed = placed.withColumn("k_last", F.when(F.col("s") > 0, F.expr("k_goal div s")).otherwise(F.lit(0).cast("long")))

    def copy(j: Column) -> Column:
        start = j * F.col("s") + F.col("k_start")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("k_goal") - start))
        middle = start.cast("double") + words / F.lit(2.0)
        return F.struct(j.cast("int").alias("pass"), words.alias("words"), demand_inverse(middle / F.col("k_goal"), F.col("k_ramp")).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k_last")), copy), lambda c: c["words"] > 0)
    out = placed.withColumn("schedule", copies).withColumn("source_size", F.col("s"))
    out = out.withColumn("taken", F.aggregate("schedule", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], *ADDED)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, range-sorted by training position: columns of the documents, pass, words, position."""
    names = without_clashes(mixed, [*ADDED, "pass", "words", "position"]).columns
    copies = mixed.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], F.col("doc_id").alias("k_id"), F.explode("schedule").alias("copy"))
    ordered = copies.select("*", "copy.position").repartitionByRange("position", "k_id").sortWithinPartitions("position", "k_id", "copy.pass")
    return ordered.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], "copy.pass", "copy.words", "position")


def digest(mixed: DataFrame) -> DataFrame:
    """The columns of the contract, how often each document is taken and where its first and last copies stand, range-sorted by the first."""
    place = lambda at: F.round(F.try_element_at("schedule", F.lit(at))["position"], 6)
    rows = mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("schedule").alias("copies"), place(1).alias("first_position"), place(-1).alias("last_position"),
        F.try_element_at("schedule", F.lit(1))["position"].alias("k_position"),
    )
    return rows.repartitionByRange("k_position", "doc_id").sortWithinPartitions("k_position", "doc_id").drop("k_position")
