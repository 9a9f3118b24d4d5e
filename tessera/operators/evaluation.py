"""Experiments: grid and resume, token counts and cost, judging, accuracy reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json_repair import grade
from ..functions.text import token_count

#: Fixed values of the reference behaviour: how many results each method is asked for, and USD per million tokens.
K_SCHEDULE = {"baseline": [0], "text_rag": [1, 2, 3, 5, 7, 10, 12, 15], "graph_rag": [10, 15, 20, 30, 50, 70, 90], "hybrid_rag": [1, 2, 3, 5, 6]}
PRICES = [("small", 0.18, 0.18), ("medium", 0.88, 0.88), ("efficient", 0.05, 0.2), ("large", 0.15, 0.6), ("proprietary", 1.25, 10.0), ("small_proprietary", 0.5, 3.0)]
SIGNATURE = ["model_id", "method", "k", "question"]


def k_schedule(spark: SparkSession, schedule: dict[str, list[int]] = K_SCHEDULE) -> DataFrame:
    return spark.createDataFrame([(m, k) for m, ks in schedule.items() for k in ks], "method string, k int")


def prices(spark: SparkSession, rows: list[tuple[str, float, float]] = PRICES) -> DataFrame:
    return spark.createDataFrame(rows, "model_category string, in_rate double, out_rate double")


def grid(models: DataFrame, schedule: DataFrame, questions: DataFrame) -> DataFrame:
    """Every model with every (method, k) and question: the product is the result asked for, and models and schedule are literals."""
    return questions.crossJoin(F.broadcast(models.crossJoin(schedule)))


def finished(results: DataFrame) -> DataFrame:
    return results.select(*SIGNATURE).distinct()


def pending(runs: DataFrame, results: DataFrame) -> DataFrame:
    return runs.join(finished(results), SIGNATURE, "left_anti")


def capped(questions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n questions of each category in a seeded order that does not depend on the partitions."""
    order = Window.partitionBy("category").orderBy(F.xxhash64(F.lit(seed), "question"), "question")
    return questions.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= n).drop("n_")


def cost(df: DataFrame, price: DataFrame, tokens_in: str = "total_input_tokens", tokens_out: str = "output_tokens") -> DataFrame:
    """df with est_cost_usd by its model_category; the price table's size decides about its broadcast."""
    dollars = F.col(tokens_in) / F.lit(1e6) * F.col("in_rate") + F.col(tokens_out) / F.lit(1e6) * F.col("out_rate")
    return df.join(price, "model_category", "left").withColumn("est_cost_usd", dollars).drop("in_rate", "out_rate")


def token_columns(df: DataFrame) -> DataFrame:
    """df (question, context, prediction, usage_out) with token counts. The context counts twice in total_input_tokens, as the reference has it; gen_input_tokens counts it once."""
    question, context = token_count(F.col("question")), token_count(F.col("context"))
    return df.withColumns({
        "question_tokens": question, "context_tokens": context, "gen_input_tokens": question + context, "total_input_tokens": question + context + context,
        "output_tokens": F.coalesce(F.nullif(F.col("usage_out"), F.lit(0)), token_count(F.col("prediction"))),
    })


def called(df: DataFrame, column: str, call: Callable[[dict], str], latency: str) -> DataFrame:
    """df with the reply of an injected model call on each row, its seconds, and the error if it failed."""
    schema = df.withColumns({column: F.lit(None).cast("string"), latency: F.lit(0.0), f"{column}_error": F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, took, errors = [], [], []
            for row in batch.to_pylist():
                began = time.perf_counter()
                try:
                    out.append(call(row))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  kept in the row
                    out.append(None)
                    errors.append(str(e))
                took.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(took, pa.float64()), pa.array(errors, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def run_experiment(runs: DataFrame, results: DataFrame, price: DataFrame, retrieve: Callable[[dict], str], generate: Callable[[dict], str], judges: list[Callable[[dict], str]]) -> DataFrame:
    """Rows for the runs that are not finished: retrieval, generation, tokens, cost, and the mean of the judges' correctness grades."""
    found = called(pending(runs, results), "context", retrieve, "retrieval_latency")
    answered = called(found.withColumn("context", F.coalesce("context", F.lit(""))), "prediction", generate, "generation_latency")
    counted = cost(token_columns(answered.withColumn("usage_out", F.lit(None).cast("long"))), price)
    for i, judge in enumerate(judges):
        counted = called(counted, f"judge_{i}", judge, f"judge_{i}_latency").withColumn(f"judge_{i}", grade(F.col(f"judge_{i}")))
    mean = sum((F.coalesce(F.col(f"judge_{i}"), F.lit(0.0)) for i in range(len(judges))), F.lit(0.0)) / max(1, len(judges))
    return counted.withColumn("score", mean).withColumn("end_to_end_latency", F.col("retrieval_latency") + F.col("generation_latency"))


def consensus(a: DataFrame, b: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """The mean of two judges over the union of their keys; a score that is missing counts 0."""
    left = a.select(*keys, *[F.col(s).cast("double").alias(f"{s}_a") for s in scores])
    right = b.select(*keys, *[F.col(s).cast("double").alias(f"{s}_b") for s in scores])
    both = left.join(right, keys, "full_outer")
    return both.select(*keys, *[((F.coalesce(f"{s}_a", F.lit(0.0)) + F.coalesce(f"{s}_b", F.lit(0.0))) / 2).alias(s) for s in scores])


def accuracy(results: DataFrame) -> DataFrame:
    return results.groupBy("method", "k").agg(F.avg("score").alias("accuracy"), F.count("*").alias("runs"))


def best_k(results: DataFrame) -> DataFrame:
    """(method, k, accuracy): each method's most accurate k, the smallest of equals."""
    rounded = accuracy(results).withColumn("accuracy", F.round("accuracy", 6))
    return rounded.groupBy("method").agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "k")).alias("b")).select("method", "b.k", (-F.col("b.a")).alias("accuracy"))


def best_per_question(results: DataFrame) -> DataFrame:
    """One row: the mean over questions of the best score that any method has."""
    return results.groupBy("question").agg(F.max("score").alias("best")).agg(F.avg("best").alias("oracle_accuracy"), F.count("*").alias("questions"))


def uniquely_best(results: DataFrame) -> DataFrame:
    """(method, questions, share): questions on which this method alone has the best score."""
    each = results.groupBy("question", "method").agg(F.max("score").alias("s"))
    winners = each.groupBy("question").agg(F.max("s").alias("best"), F.collect_set(F.struct("s", "method")).alias("all"))
    alone = winners.select("question", F.filter("all", lambda x: x["s"] == F.col("best")).alias("w"))
    total = alone.agg(F.count("*").alias("n")).scalar()
    return alone.where(F.size("w") == 1).groupBy(F.col("w")[0]["method"].alias("method")).agg(F.count("*").alias("questions")).select("method", "questions", (F.col("questions") / total).alias("share"))


def cost_rollup(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.rollup(*by).agg(F.sum(value).alias("total"), F.count("*").alias("rows"))
