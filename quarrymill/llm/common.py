"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    return shared_folder(spark)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared folder, so a lost executor costs no rerun of what went before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """Round robin over the cores where a scan has fewer parts than they; large inputs have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


#: Texts longer than this do not serve to fit a model, so that a sample's rows bound its bytes too.
MAX_FIT_CHARS = 200_000


#: Characters of text that a sample holds at most, whatever its rows are.
MAX_SAMPLE_CHARS = 64_000_000


def hash_sample(df: DataFrame, key: str, rows: int, total: int, text: str | None = None) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of ``key``: a bounded sample that no order of the input changes.

    ``total`` is about how many rows there are (a count that a file's footer answers will do); a threshold from
    it leaves about twice ``rows`` before the sort, so what the tasks send on does not grow with the input.
    Where ``text`` names a column, the sample ends with ``MAX_SAMPLE_CHARS`` of it.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    if total > 2 * rows:
        df = df.where(h < F.lit(int(-(2**63) + (2 * rows + 200) / total * 2**64)))
    taken = df.orderBy(h, key).limit(rows)
    if text is None:
        return taken
    length = F.sum(F.coalesce(F.length(text), F.lit(0))).over(W.orderBy(h, key))  # over ``rows`` rows at most
    return taken.withColumn("_chars", length).where(F.col("_chars") <= MAX_SAMPLE_CHARS).drop("_chars")
