"""The stored tables: passages with vectors, the manifest, JSON-lines reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "id string, source_id string, source_type string, kind string, title string, source_url string, authority string, lang string, last_modified string, rel_path string, "
    "ordinal int, heading_path string, content string, text string, line_start int, line_end int, vector array<float>"
)


def to_stored(chunks: DataFrame, docs: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """Rows of the passage table: missing texts are ``''``, missing lines -1; a vector of another length is an error."""
    meta = docs.select("source_id", "source_type", "kind", "title", "source_url", "authority", "lang", "last_modified", "rel_path")
    j = chunks.select("id", "source_id", "ordinal", "heading_path", "content", "text", "line_start", "line_end").join(meta, "source_id").join(vectors.select("id", "vector"), "id")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    line = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    checked = F.when(F.size("vector") == dims, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of "), F.col("id"), F.lit(f" has not {dims} numbers")))).cast("array<float>").alias("vector")
    return j.select("id", "source_id", "source_type", "kind", "title", blank("source_url"), "authority", "lang", blank("last_modified"), "rel_path", "ordinal", "heading_path", "content", "text", line("line_start"), line("line_end"), checked)


def from_stored(rows: DataFrame) -> DataFrame:
    """The passage table as it is worked with: blank texts and lines of -1 are null; columns of older tables are added."""
    for name, value in (("kind", "doc"), ("source_url", ""), ("last_modified", ""), ("line_start", -1), ("line_end", -1)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    null = lambda c, v: F.nullif(F.col(c), F.lit(v))
    return rows.withColumns({"source_url": null("source_url", ""), "last_modified": null("last_modified", ""), "line_start": null("line_start", -1), "line_end": null("line_end", -1)})


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``ids`` (``id, pos``) in the order asked for; unknown ids are left out."""
    return rows.join(ids, "id").orderBy("pos")


def write_version(rows: DataFrame, path: str, version: int) -> None:
    """A whole table as a new version; readers see the last version that was written to its end."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version:012d}")


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines, blank and comment lines left out, missing fields filled.

    A line that is no JSON is an error that names the line.
    """
    raw = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|//|$)"))
    schema = "id string, question string, lang string, category string, difficulty string, source_type string, expected_source_ids array<string>, expected_keywords array<string>, expected_answer string, should_abstain boolean"
    parsed = raw.withColumn("r", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    checked = F.when(F.col("r._bad").isNull() & F.col("r").isNotNull(), F.col("r.id")).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.col("value"))))
    text = lambda n, v: F.coalesce(F.col(f"r.{n}"), F.lit(v)).alias(n)
    items = lambda n: F.coalesce(F.filter(F.transform(F.col(f"r.{n}"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>")).alias(n)
    return parsed.select(
        checked.cast("string").alias("id"), "r.question", text("lang", "en"), text("category", "general"), text("difficulty", "medium"), text("source_type", "any"), items("expected_source_ids"), items("expected_keywords"), "r.expected_answer", F.coalesce("r.should_abstain", F.lit(False)).alias("should_abstain"),
    )
