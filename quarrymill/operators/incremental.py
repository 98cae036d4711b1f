"""What changed since the last run, and what can be reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(raw: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(raw, 256))


def embed_hash(kind: Column, title: Column, breadcrumb: Column, project: Column, body: Column) -> Column:
    """Hash of all that an embedding depends on."""
    parts = [F.coalesce(c, F.lit("")) for c in (kind, title, breadcrumb, project, body)]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n\u0000", *parts), 256))


def classify(documents: DataFrame, manifest: DataFrame, complete: bool = True) -> DataFrame:
    """``source_id, status`` of documents (``source_id, content_hash, embed_hash``) against the manifest.

    unchanged: same content.  refresh: same embedding input, other content.  changed, added, removed.
    A run that saw only some documents (``complete`` false) removes nothing.
    """
    d = documents.select("source_id", F.col("content_hash").alias("c"), F.col("embed_hash").alias("e"), F.lit(True).alias("here"))
    m = manifest.select("source_id", F.col("content_hash").alias("mc"), F.col("embed_hash").alias("me"), F.lit(True).alias("known"))
    status = (
        F.when(F.col("known").isNull(), "added")
        .when(F.col("here").isNull(), "removed")
        .when(F.col("c") == F.col("mc"), "unchanged")
        .when(F.col("e") == F.col("me"), "refresh")
        .otherwise("changed")
    )
    out = d.join(m, "source_id", "full").select("source_id", status.alias("status"))
    return out if complete else out.where(F.col("status") != "removed")


def reusable(chunks: DataFrame, stored: DataFrame, dims: int) -> DataFrame:
    """``source_id, reuse``: whether all vectors of a document can be kept.

    They can when every new chunk (``source_id, ordinal, text``) has a stored one with the same text and a vector
    of ``dims``, and there are as many.
    """
    s = stored.select("source_id", "ordinal", F.col("text").alias("old"), F.size("vector").alias("d"))
    met = chunks.select("source_id", "ordinal", "text").join(s, ["source_id", "ordinal"], "left")
    good = F.coalesce((F.col("text") == F.col("old")) & (F.col("d") == dims), F.lit(False))
    by_doc = met.groupBy("source_id").agg(F.bool_and(good).alias("all_good"), F.count("*").alias("n"))
    counts = stored.groupBy("source_id").agg(F.count("*").alias("stored_n"))
    return by_doc.join(counts, "source_id", "left").select("source_id", (F.col("all_good") & (F.coalesce("stored_n", F.lit(0)) == F.col("n"))).alias("reuse"))


def current_items(events: DataFrame) -> DataFrame:
    """The sync state that a log of events leaves: the last event of each (source, source_id), each event_id once.

    ``doc`` and ``unchanged`` keep an item, ``skip`` and ``error`` say nothing about it.
    """
    seen = events.where(F.col("event_type").isin("doc", "unchanged") & F.col("source_id").isNotNull())
    return seen.groupBy("source", "source_id").agg(F.max_by("event_type", F.struct("emitted_at", "event_id")).alias("last_type"), F.max("emitted_at").alias("last_seen"), F.count_distinct("event_id").alias("events"))


def removed_items(previous: DataFrame, seen: DataFrame, completed: DataFrame) -> DataFrame:
    """Items of sources that completed their run and were not seen in it."""
    return previous.join(completed.select("source"), "source", "left_semi").join(seen.select("source", "source_id"), ["source", "source_id"], "left_anti")


def skip_reasons(events: DataFrame) -> DataFrame:
    """``source, reason, n``: skipped items by reason, numbers and quoted parts removed; each event_id once."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("reason"), r"\([^)]*\)", ""), r"\"[^\"]*\"", ""), r"\d+", "N"))
    once = events.where((F.col("event_type") == "skip") & F.col("reason").isNotNull()).select("source", "event_id", plain.alias("reason")).distinct()
    return once.groupBy("source", "reason").agg(F.count("*").alias("n"))


def upsert(stored: DataFrame, incoming: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunk table after a run: documents of ``incoming`` replaced, those of ``gone`` left out."""
    touched = incoming.select("source_id").union(gone.select("source_id")).distinct()
    return stored.join(touched, "source_id", "left_anti").unionByName(incoming, allowMissingColumns=True)
