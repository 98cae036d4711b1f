"""Whole runs: a sync from its events, an ingest from documents and manifest, and what each reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import incremental

#: The order in which kinds are taken in.
KIND_ORDER = ("project", "doc", "api", "code")
#: Chunks that are embedded and written at a time.
BATCH_CHUNKS = 256


def last_events(events: DataFrame) -> DataFrame:
    """Each (source, source_id) with its last event, each event_id once.

    Events without a source_id are about the source as a whole and left out.  The aggregate combines in the map, so one source
    with a third of all events is no hot task.
    """
    rank = F.struct("emitted_at", "event_id", "received_at")
    keyed = events.where(F.col("source_id").isNotNull() & F.col("source").isNotNull())
    pick = F.max_by(F.struct("event_type", "fingerprint", "rel_path", "title", "last_modified", "reason", "emitted_at"), rank)
    return keyed.groupBy("source", "source_id").agg(pick.alias("e")).select("source", "source_id", "e.*")


def sync_run(previous: DataFrame, events: DataFrame) -> DataFrame:
    """``source, source_id, action, fingerprint``: what a run's events do to the items of the run before.

    ``previous`` has ``source, source_id, fingerprint``.  A ``doc`` writes: ``added``, ``changed``, or ``unchanged`` where the
    fingerprint is the same; ``unchanged`` and ``meta`` keep; ``skip`` drops what was there (``skipped``); after an ``error`` an item is
    kept as it was (``failed``).  Items that no event names are ``removed`` where their source had events and no
    error in the run, else ``kept``.
    """
    last = last_events(events).select("source", "source_id", F.col("event_type").alias("t"), F.col("fingerprint").alias("f"))
    old = previous.select("source", "source_id", F.col("fingerprint").alias("was"), F.lit(True).alias("known"))
    health = events.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.col("event_type") == "error").alias("ill"))
    j = old.join(last, ["source", "source_id"], "full").join(health, "source", "left")
    action = (
        F.when(F.col("t").isNull(), F.when(F.col("ill") == F.lit(False), "removed").otherwise("kept"))
        .when(F.col("t") == "error", "failed")
        .when(F.col("t") == "skip", "skipped")
        .when(F.col("t") == "meta", F.when(F.col("known"), "refreshed").otherwise("ignored"))
        .when(F.col("t") == "unchanged", F.when(F.col("known"), "unchanged").otherwise("added"))
        .when(F.col("known").isNull(), "added")
        .when(F.col("was").eqNullSafe(F.col("f")), "unchanged")
        .otherwise("changed")
    )
    return j.select("source", "source_id", action.alias("action"), F.when(F.col("t") == "doc", F.col("f")).otherwise(F.coalesce("was", "f")).alias("fingerprint"))


def next_items(run: DataFrame) -> DataFrame:
    """The items that a run leaves: ``source, source_id, fingerprint``."""
    return run.where(~F.col("action").isin("removed", "skipped", "ignored")).select("source", "source_id", "fingerprint")


def counters(run: DataFrame, by: str, value: str) -> DataFrame:
    """``by, value, n``: how often each value occurs."""
    return run.groupBy(by, value).agg(F.count("*").alias("n"))


def ingest_run(documents: DataFrame, manifest: DataFrame, chunks: DataFrame, stored: DataFrame, dims: int, complete: bool = True) -> DataFrame:
    """``source_id, status, reuse, chunks``: what an ingest does with each document.

    ``status`` as ``incremental.classify``; a ``refresh`` whose stored chunks all have the same texts and usable vectors keeps
    them (``reuse``), any other is embedded anew; ``chunks`` are those it then has.
    """
    found = incremental.classify(documents, manifest, complete)
    kept = incremental.reusable(chunks, stored, dims)
    n = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"))
    return found.join(kept, "source_id", "left").join(n, "source_id", "left").select("source_id", "status", (F.col("status").isin("unchanged", "refresh") & F.coalesce("reuse", F.lit(False))).alias("reuse"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def ingest_report(run: DataFrame) -> DataFrame:
    """``status, documents, chunks, embedded, batches``: an ingest's counters by status."""
    work = F.when(F.col("status").isin("added", "changed") | ((F.col("status") == "refresh") & ~F.col("reuse")), F.col("chunks")).otherwise(0)
    return run.groupBy("status").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum(work).alias("embedded")).withColumn("batches", F.ceil(F.col("embedded") / BATCH_CHUNKS).cast("long"))


def apply_ingest(run: DataFrame, stored: DataFrame, embedded: DataFrame) -> DataFrame:
    """The chunk table after an ingest: documents of ``embedded`` replaced, removed ones left out, all others kept."""
    return incremental.upsert(stored, embedded, run.where(F.col("status") == "removed").select("source_id"))


def needs_rebuild(state: dict | None, wanted: dict) -> str | None:
    """Why an index must be built anew: no state, or the first setting that differs; sizes of code default to those of prose."""
    if state is None:
        return "no state"
    for name in ("version", "model", "dims", "target_tokens", "max_tokens", "overlap_tokens", "code_target_tokens", "code_max_tokens"):
        prose = name.removeprefix("code_")
        if state.get(name, state.get(prose)) != wanted.get(name, wanted.get(prose)):
            return name
    return None


def ingest_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``place``: by kind (project, doc, api, code, others), then path.

    Places are ranks within a kind, behind the counted documents of the kinds before it, so no sort spans all documents.
    """
    order = F.coalesce(F.array_position(F.lit(list(KIND_ORDER)), F.lower("kind")), F.lit(0))
    keyed = docs.withColumn("_k", F.when(order == 0, len(KIND_ORDER) + 1).otherwise(order).cast("int"))
    counts = keyed.groupBy("_k").agg(F.count("*").alias("_n"))
    before = counts.select("_k", F.coalesce(F.sum("_n").over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # five rows
    ranked = keyed.withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy("rel_path", "source_id")))
    return ranked.join(F.broadcast(before), "_k").withColumn("place", F.col("_b") + F.col("_r")).drop("_k", "_b", "_r")


def foreign_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """``rel_path`` of files that no item of the state owns."""
    return files.where(F.col("rel_path").isNotNull()).select("rel_path").distinct().join(state.select("rel_path"), "rel_path", "left_anti")


def stale_documents(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """``source_id, stale``: whether a document's content differs from what is indexed; those not indexed are left out."""
    m = manifest.select("source_id", F.col("content_hash").alias("indexed"))
    return documents.join(m, "source_id").select("source_id", (~F.col("content_hash").eqNullSafe(F.col("indexed"))).alias("stale"))


def space_counters(pages: DataFrame, space: Column, kept: Column) -> DataFrame:
    """``space, pages, kept, left_out, untitled, last_modified`` of each space."""
    return pages.withColumns({"_s": space, "_k": F.coalesce(kept, F.lit(False))}).where(F.col("_s").isNotNull()).groupBy(F.col("_s").alias("space")).agg(
        F.count("*").alias("pages"), F.count_if("_k").alias("kept"), F.count_if(~F.col("_k")).alias("left_out"), F.count_if(F.col("title").isNull()).alias("untitled"), F.max(F.nullif("last_modified", F.lit(""))).alias("last_modified")
    )


def placed_counts(rows: DataFrame, placed: DataFrame, key: str, level: str = "subarea") -> DataFrame:
    """``level, n``: rows by where their document lies; rows of documents without a place count under ``(none)``."""
    return rows.join(placed.select(key, level), key, "left").groupBy(F.coalesce(level, F.lit("(none)")).alias(level)).agg(F.count("*").alias("n"))


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """``column, code``: the distinct values of a facet, numbered from 0, the most frequent first."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return counted.select(column, (F.row_number().over(W.orderBy(F.desc("_n"), column)) - 1).cast("int").alias("code"))


def encoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the columns' values replaced by their codes; null stays null."""
    out = rows
    for c in columns:
        out = out.join(dictionary(rows, c), c, "left").drop(c).withColumnRenamed("code", c)
    return out.select(*rows.columns)


def decoded(rows: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """The inverse of ``encoded``."""
    out = rows
    for c, d in dictionaries.items():
        out = out.withColumnRenamed(c, "code").join(d, "code", "left").drop("code")
    return out.select(*rows.columns)


def doc_payload(edges: DataFrame) -> DataFrame:
    """``a, b, relation`` of document edges by compact indices: documents with an edge, numbered from 0 in order of their id."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    numbered = ids.select("id", (F.row_number().over(W.orderBy("id")) - 1).alias("k"))
    x = edges.join(numbered.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(numbered.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    return x.select("a", "b", "relation")


def all_neighbours(listed: DataFrame, places: DataFrame, of: DataFrame) -> DataFrame:
    """``src, dst, rank``: the listed neighbours, then every other document of the same place, by id.

    ``places`` has ``id, place``; those without a place add none.
    """
    p = places.where(F.col("place").isNotNull())
    mine = of.join(p, "id").select(F.col("id").alias("src"), "place")
    same = mine.join(p.select(F.col("id").alias("dst"), "place"), "place").where(F.col("src") != F.col("dst")).select("src", "dst")
    more = same.join(listed.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("_t", F.lit(1)).withColumn("_r", F.lit(0))
    rows = listed.join(of.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", F.lit(0).alias("_t"), F.col("rank").alias("_r")).unionByName(more)
    return rows.select("src", "dst", F.row_number().over(W.partitionBy("src").orderBy("_t", "_r", "dst")).alias("rank"))
