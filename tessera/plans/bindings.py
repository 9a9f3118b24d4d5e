"""The driver's tables in the roles of the reference's inputs: documents as passages, benchmark as queries, a graph of suppliers and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (query_id, id): seeds of three graph queries
SEEDS = [(0, "Supplier#000000000"), (1, "Brand#2"), (1, "Brand#17"), (2, "Supplier#000000003"), (2, "Brand#5")]
#: (query_id, text): graph queries
GRAPH_QUESTIONS = [(0, "What does Supplier#000000001 offer in ECONOMY and PROMO types?"), (1, "Which brand#12 goods are STANDARD?"), (2, "nothing that occurs"), (3, "SMALL LARGE brand#7 supplier#000000005")]
#: (level, num, name, page, subchapters): chapters of two levels over document ids as pages
CONTENTS = [
    (0, 1, "Start", 20, {"Opening": 20, "Aims": 25, "Means": 25}), (0, 2, "Middle", 120, {"Turn": 140}), (0, 3, "Gap", None, {}), (0, 4, "End", 400, {"Close": 410, "Afterword": 500}),
    (1, 1, "Basics", 3, {"Words": 3}), (1, 2, "Details", 300, {"Numbers": 301, "Tables": 350}),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it lies in fewer files than there are cores: texts in one row group would keep one core busy. Inputs of many files are read as they lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "source", F.col("doc_id").alias("chunk_id"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, numbered in their order."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("query_id"), F.col("embedding").alias("vec"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triple per line item: supplier -flag-> brand, turned round for the flag R; line status and part type are its qualifiers."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").join(part, "l_partkey").join(supplier, "l_suppkey")
    back = F.col("l_returnflag") == "R"
    kind = lambda turned: F.when(turned, F.col("p_type")).otherwise("Supplier")
    level = lambda turned: F.when(turned, "Category").otherwise("Instance")
    return lines.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), F.col("l_returnflag").alias("relation"),
        F.when(back, F.col("p_brand")).otherwise(F.col("s_name")).alias("source"), F.when(back, F.col("s_name")).otherwise(F.col("p_brand")).alias("target"),
        kind(back).alias("source_type"), level(back).alias("source_abstraction"), kind(~back).alias("target_type"), level(~back).alias("target_abstraction"),
        F.col("l_linestatus").alias("modality"), F.when(F.col("l_linenumber") > 1, F.col("p_type")).alias("instruction"),
    )


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEEDS, "query_id long, id string")


def graph_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRAPH_QUESTIONS, "query_id long, text string")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as experiment rows: type as method, user modulo 5 as k, value over 1000 held to 0..1 as score, user as question."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("method"), (F.col("user_id") % 5).cast("int").alias("k"), F.col("user_id").cast("string").alias("question"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("value"), F.lit(0.0)) / F.lit(1000.0))).alias("score"),
    )
