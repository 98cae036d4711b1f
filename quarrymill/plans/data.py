"""The tables as the core queries take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks, each id once: the last delivery."""
    ties = ("title", "authority", "last_modified", "rel_path", "ordinal")
    wanted = list(dict.fromkeys(["id", *columns, "indexed_at", *ties])) if columns else read(spark, d, "chunks").columns
    return dedupe.latest(read(spark, d, "chunks").select(*wanted), "id", "indexed_at", *ties)


def pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Pages, each source_id once: the last fetch."""
    ties = ("title", "authority", "last_modified", "rel_path")
    wanted = list(dict.fromkeys(["source_id", *columns, "fetched_at", *ties])) if columns else read(spark, d, "kb_documents").columns
    return dedupe.latest(read(spark, d, "kb_documents").select(*wanted), "source_id", "fetched_at", *ties)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every document whose id is divisible by 100 and that has a title."""
    return read(spark, d, "documents").where((F.col("doc_id") % 100 == 0) & F.col("title").isNotNull()).select(F.col("doc_id").alias("qid"), F.col("title").alias("text"))
