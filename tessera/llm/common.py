"""What the operators of this subpackage share: reading, bounded samples, hashing rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parts the words of the shingle and mixing contracts: ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: Words of the decontamination and license contracts: runs of ASCII letters, digits and all other code points from U+0080.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts those.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table: A-Z to a-z, separators of ALNUM_WORD to a blank.
ALNUM_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column, separators: str) -> Column:
    """How many words the runs of separators part a text into; null: 0. Splitting is several times as fast here as counting matches."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, separators), ""))).cast("long")


def id_text(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_fold(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(id_text(name).cast("binary")) % F.lit(folds)


def without_clashes(df: DataFrame, made: list[str]) -> DataFrame:
    """df without the input columns whose names (in any case) an operator is about to give to its own."""
    taken = {x.lower() for x in made}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, kept_out: int, bound: int) -> list[tuple[str, int]]:
    """At most `bound` (text, label) training rows: labelled ids outside the held-out fold, in order of the md5 of the id.

    The choice is made on the narrow label table; its ids, at most `bound`, are the only thing sent to the document scan.
    An id labelled more than once counts once with its largest label; null ids, labels and texts are left out.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_fold("doc_id", folds) != kept_out))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.md5(id_text().cast("binary")), "doc_id").limit(bound)
    )
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    got = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    return [(r.text, int(r.label > 0)) for r in sorted(got, key=lambda r: r.doc_id)]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def sized_partitions(spark: SparkSession, rows: int, per_part: int) -> int:
    """Enough partitions for `rows` at about `per_part` each, and never fewer than spark.sql.shuffle.partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))
