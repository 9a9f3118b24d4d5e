"""New questions as a stream: each batch answers what the result table doesn't hold yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluation import pending


def answer_stream(runs: DataFrame, results_path: str, schema: str, answer: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """runs: a streaming DataFrame of (model_id, method, k, question, ...). The state is the result table itself: a batch is written to a folder of its own number, so a batch
    that is repeated after a failure replaces what it had written."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(schema).parquet(results_path).where(f"batch <> {number}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], schema)
        fresh = answer(pending(batch.dropDuplicates(["model_id", "method", "k", "question"]), known))
        fresh.write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    return runs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
