"""The given tables and the unit views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from juryframe.functions import text as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def document_units(spark: SparkSession, folder: str) -> DataFrame:
    """One unit per document: id, pos, file, text."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"),
                       F.col("source").alias("file"), "lang", "text")


def document_lines(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """One row per line of each document: doc_id, line (from 1), text. Lines stay in the task that read the row."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", *keep, F.posexplode(T.lines(F.col("text"))).alias("line0", "line_text")).select(
        "doc_id", *keep, (F.col("line0") + 1).alias("line"), F.col("line_text").alias("text"))
