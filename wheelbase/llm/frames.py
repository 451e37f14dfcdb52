"""Reading the corpus tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.staging import TIDY, checkpointed, written  # noqa: F401

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The frame, written once to the folder of spark.checkpoint.dir and read from there: lineage is cut, lost executors do no harm."""
    return checkpointed(df)


def texts(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id long, text string): the two columns that the operators need; a null text counts as empty.

    Rows without an id are left out. A repeated row stays: it gets its own result row and never counts as another document.
    """
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).filter("doc_id is not null")


def versions(docs: DataFrame) -> DataFrame:
    """``texts`` with ``version``, a 64-bit number of the text: (doc_id, version) tells the rows of one doc_id apart, and rows equal in both are one document."""
    return texts(docs).withColumn("version", F.xxhash64("text"))


def bucket_of_id(modulus: int, column: str = "doc_id"):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def crc32_sql(column: str) -> str:
    """The unsigned crc32 of a column's decimal text in the SQL of the side-by-side check: one step a bit."""
    steps = f"flatten(list_transform(string_split({column}::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda x, y: {step}), 4294967295::BIGINT)"
