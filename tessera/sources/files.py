"""Sources and sinks of the retrieval pipeline: PDF, JSON lines, caches, logs.

Every source has an explicit schema; unreadable lines are dropped where the reference skips them and kept in a column of
their own where a caller wants to see them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunking import slices

EDGE = "source string, target string, relation string, properties string, edge_properties string, props string"
QUESTION = "question string, answer string, rationale string, key_facts array<string>, facts array<string>, category string, difficulty string, source_type string, gold_context string"
QUESTION_DATA = (
    "ind bigint, data struct<question:string,answer:string,rationale:string,expected_terms:array<string>,gold_evidence:array<struct<id:string,text:string,"
    "sentence_index:int,char_start:int,char_end:int>>,facts:array<struct<references:array<string>,fact:map<string,string>>>,query_terms:array<string>,"
    "query_variants:array<string>,difficulty:string,reasoning_type:array<string>,checks:struct<uses_multiple_blocks:boolean,all_spans_verbatim:boolean,answer_supported_by_gold:boolean>>"
)
OLD_EDGE = "source struct<name:string,label:string>, target struct<name:string,label:string>, relation string"
QNA = "question_is string, question_en string, answer string, answer_en string, why string"
TOC = "level int, num int, name string, page int, subchapters map<string,int>"
RESULT = (
    "model_category string, model_id string, method string, k int, q_category string, question string, target string, prediction string, context string, "
    "context_tokens bigint, question_tokens bigint, total_input_tokens bigint, gen_input_tokens bigint, output_tokens bigint, retrieval_latency double, generation_latency double, "
    "end_to_end_latency double, est_cost_usd double, score double, faithfulness double, judge_a_correctness double, judge_b_correctness double, judge_a_faithfulness double, judge_b_faithfulness double"
)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _string_map(c: Column) -> Column:
    return F.from_json(c, "map<string,string>")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of the PDF files of a folder; a missing folder has none."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    except Exception as e:  # noqa: BLE001  Spark reports a missing path with several classes
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "source string, content binary")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "content")


def pdf_pages(files: DataFrame, parse: Callable[[bytes], list[str]], empty: str, offset: int = 0, skip_first: int = 0) -> DataFrame:
    """(source, page from 1, logical_page, text, error) by an injected parser; a file that fails gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(source, n, text, None) for n, text in enumerate(parse(content), 1)]
                except Exception as e:  # noqa: BLE001  a file that can't be read is reported, not fatal
                    rows.append((source, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["source", "page", "text", "error"])

    raw = files.select("source", "content").mapInArrow(run, "source string, page int, text string, error string")
    kept = raw.where(F.col("page").isNull() | (F.col("page") > skip_first))
    return kept.select("source", "page", (F.col("page") - offset).alias("logical_page"), F.when(F.trim("text") == "", empty).otherwise(F.col("text")).alias("text"), "error")


def pdf_text(pages: DataFrame) -> DataFrame:
    """(source, text): pages that are not empty, joined by blank lines in page order."""
    full = pages.where(F.trim("text") != "").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return full.select("source", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def edges(spark: SparkSession, path: str, legacy_props: bool = False) -> DataFrame:
    """Edges with properties as a map and `line`, which rises with the place in the file; lines without source, target or relation are dropped. A qualifier that is
    a list becomes its values, parted by slashes. legacy_props reads the names that the old reader knew."""
    raw = _lines(spark, path, EDGE).withColumn("line", F.monotonically_increasing_id()).where("source is not null and target is not null and relation is not null")
    props = F.coalesce(_string_map(F.col("edge_properties")), _string_map(F.col("props")), *([] if legacy_props else [_string_map(F.col("properties"))]), F.create_map().cast("map<string,string>"))
    values = F.transform_values(props, lambda k, v: F.coalesce(F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), "/")), v))
    return raw.select("source", "target", "relation", values.alias("properties"), "line")


def questions(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, QUESTION).where("question is not null")


def sampled_questions(spark: SparkSession, path: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """In a seeded order that does not depend on the partitions; n is the reference's debugging limit, off by default."""
    ordered = questions(spark, path).orderBy(F.xxhash64(F.lit(seed), "question"), "question")
    return ordered.limit(n) if n else ordered


def qna(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(QNA).option("multiLine", True).json(paths)


def question_data(spark: SparkSession, path: str) -> DataFrame:
    """Nested questions with defaults for what is missing; lines without data are dropped."""
    raw = _lines(spark, path, QUESTION_DATA).where("data is not null").select("ind", "data.*")
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("question", "answer", "rationale", "difficulty")}
    lists = {c: F.coalesce(F.col(c), F.array().cast(raw.schema[c].dataType)) for c in ("expected_terms", "gold_evidence", "facts", "query_terms", "query_variants", "reasoning_type")}
    return raw.withColumns(empty | lists)


def old_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of an earlier graph up to the first line that can't be read."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    parsed = raw.withColumn("edge", F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", OLD_EDGE)))
    bad = F.min(F.when(F.col("edge").isNull(), F.col("line"))).over(Window.partitionBy("file"))
    return parsed.withColumn("bad", bad).where("edge is not null and (bad is null or line < bad)").select("edge.*")


def toc(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of contents; of rows with the same (level, num) the last one counts."""
    last = {(r[0], r[1]): r for r in rows}
    return spark.createDataFrame(list(last.values()), TOC)


def write_edges(df: DataFrame, path: str) -> None:
    df.select("source", "target", "relation", "properties").write.mode("overwrite").json(path)


def write_nodes(df: DataFrame, path: str) -> None:
    df.select("name", "type", "abstraction").write.mode("overwrite").json(path)


def write_canonical_map(df: DataFrame, path: str) -> None:
    df.select("name", "canonical").write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, in place of a pickled graph."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    links.write.mode("overwrite").parquet(f"{path}/edges")


def write_questions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


class IndexCache:
    """Index tables by name, made once: Parquet that is read again when it is there and whole, else built and written anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        where = f"{self.path}/{name}"
        try:
            return self.spark.read.parquet(where)
        except Exception:  # noqa: BLE001  missing or broken: both mean that it is made again
            build().write.mode("overwrite").parquet(where)
            return self.spark.read.parquet(where)


class ExtractionCache:
    """Triples by hash of the chunk: Parquet that grows by appending; a folder that can't be read counts as empty."""

    SCHEMA = "chunk_hash string, reply string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path).dropDuplicates(["chunk_hash"])
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def split(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cached, uncached) chunks, by their md5."""
        hashed = chunks.withColumn("chunk_hash", F.md5(F.col("text").cast("binary")))
        known = self.load().select("chunk_hash")
        return hashed.join(known, "chunk_hash", "left_semi"), hashed.join(known, "chunk_hash", "left_anti")

    def extract(self, chunks: DataFrame, extractor: Callable[[str], str]) -> DataFrame:
        """(chunk_hash, reply) for all chunks; only unknown ones are extracted, once per text, and appended."""
        hashed = chunks.select(F.md5(F.col("text").cast("binary")).alias("chunk_hash"), "text").dropDuplicates(["chunk_hash"])
        fresh = hashed.join(self.load().select("chunk_hash"), "chunk_hash", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, 1)):
                replies = []
                for text in batch.column(1).to_pylist():
                    try:
                        replies.append(extractor(text))
                    except Exception:  # noqa: BLE001  not cached, so that the next run tries again
                        replies.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], names=["chunk_hash", "reply"])

        fresh.mapInArrow(run, self.SCHEMA).where("reply is not null").write.mode("append").parquet(self.path)
        return self.load().join(hashed.select("chunk_hash"), "chunk_hash", "left_semi")


class RetrievalCache:
    """Contexts by (method, k, question): an append-only table in which the last write counts."""

    SCHEMA = "method string, k int, question string, context string, latency double, seq bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        try:
            raw = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raw = self.spark.createDataFrame([], self.SCHEMA)
        last = raw.groupBy("method", "k", "question").agg(F.max_by(F.struct("context", "latency"), "seq").alias("v"))
        return last.select("method", "k", "question", "v.context", "v.latency")

    def save(self, rows: DataFrame, seq: int) -> None:
        """Rows with an error column that is set are not kept."""
        kept = rows.where("error is null") if "error" in rows.columns else rows
        kept.select("method", F.col("k").cast("int").alias("k"), "question", "context", "latency", F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(self.path)

    def lookup(self, runs: DataFrame) -> DataFrame:
        """runs with context and latency where known, else null."""
        return runs.join(self.load(), ["method", "k", "question"], "left")
