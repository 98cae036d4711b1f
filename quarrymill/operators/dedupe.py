"""Exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import near


def latest(rows: DataFrame, key: str = "id", at: str = "indexed_at", *ties: str) -> DataFrame:
    """Each ``key`` once: the row delivered last, then the smallest of ``ties``.

    The aggregate combines in the map, so a key delivered without end is no hot partition.
    """
    cols = [c for c in rows.columns if c != key]
    ties = ties or tuple(c for c in ("title", "authority", "last_modified", "rel_path", "ordinal") if c in cols)
    stamp = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62)))
    rank = F.struct((-stamp).alias("_at"), *ties)
    picked = F.min_by(F.struct(*cols), rank)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(picked.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols]).select(*rows.columns)


def duplicate_groups(docs: DataFrame, key: str, text: str, least: int = 80) -> DataFrame:
    """``dup_key, n, first_id`` of normalised bodies that occur more than once; keys below ``least`` characters do not count."""
    keyed = docs.select(F.col(key).alias("id"), T.duplicate_key(F.col(text)).alias("k")).where(F.length("k") >= least)
    # The key travels as a hash: bodies are long.
    return keyed.groupBy(F.sha2("k", 256).alias("dup_key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") > 1)


def first_wins(docs: DataFrame, scope: str, order: str, text: str, key: str, least: int = 80, exempt: Column | None = None) -> DataFrame:
    """``key, kept_id``: the documents that repeat an earlier body of their scope, and which one they repeat.

    First by ``order``, then ``key``.  Short keys and ``exempt`` rows neither drop nor are dropped.
    """
    k = T.duplicate_key(F.col(text))
    rows = docs.where(F.length(k) >= least)
    if exempt is not None:
        rows = rows.where(~F.coalesce(exempt, F.lit(False)))
    rows = rows.select(F.col(scope).alias("scope"), F.col(order).alias("o"), F.col(key).alias("id"), F.sha2(k, 256).alias("h"))
    kept = rows.groupBy("scope", "h").agg(F.min(F.struct("o", "id")).alias("first"))
    joined = rows.join(kept, rows["scope"].eqNullSafe(kept["scope"]) & (rows["h"] == kept["h"]))
    return joined.where(F.col("id") != F.col("first.id")).select(F.col("id").alias(key), F.col("first.id").alias("kept_id"))


def shingles(words: Column, size: int = V.SHINGLE_WORDS) -> Column:
    """Hashes of the distinct runs of ``size`` words; no run is put together as a text."""
    run = lambda x, i: F.xxhash64(*[F.element_at(x, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: run(words, i)))).otherwise(F.array().cast("array<bigint>"))


def drop_near_duplicates(ranked: DataFrame, threshold: float = V.CONTAINMENT, least: int = V.LEAST_SHINGLES) -> DataFrame:
    """``qid, id, source_id, rank, text`` without passages that repeat an earlier kept one of another document.

    Adds ``duplicates``: the documents whose passages a kept one stands for.  Greedy in rank order and against
    kept passages only, so it runs by query over its few candidates (twice ``CANDIDATES`` at most).
    """
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", duplicates array<string>"

    def one_query(pdf):
        import re

        pdf = pdf.sort_values("rank")
        kept: list[tuple[int, set, str]] = []
        twins: dict[int, list[str]] = {}
        for i, row in zip(pdf.index, pdf.itertuples()):
            w = re.findall(r"[^\W_]+", (row.text or "").lower())
            own = {" ".join(w[k : k + V.SHINGLE_WORDS]) for k in range(len(w) - V.SHINGLE_WORDS + 1)}
            twin = None
            if len(own) >= least:
                for j, other, source in kept:
                    if source != row.source_id and len(other) >= least and len(own & other) / min(len(own), len(other)) >= threshold:
                        twin = j
                        break
            if twin is None:
                kept.append((i, own, row.source_id))
                twins[i] = []
            elif row.source_id not in twins[twin]:
                twins[twin].append(row.source_id)
        out = pdf.loc[[i for i, _, _ in kept]].copy()
        out["duplicates"] = [twins[i] for i in out.index]
        return out

    return ranked.groupBy("qid").applyInPandas(one_query, schema)


def near_duplicate_links(docs: DataFrame, key: str, text: str, threshold: float = V.CONTAINMENT, least: int = V.LEAST_SHINGLES) -> DataFrame:
    """``a, b, shared, containment``: links between *different* texts whose shingle sets contain each other.

    Equal texts are one class, named by its smallest key; copies are not expanded into pairs
    (``duplicate_classes`` gives the membership).  No candidate is capped (``near`` says how they are found).
    """
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    pairs = near.contained_pairs(docs, key, spaced, threshold, least)
    return pairs.select("a", "b", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


def duplicate_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class_id, class_size``: documents with the same words in the same order, named by the smallest key."""
    w = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    hashed = docs.select(key, F.sha2(w, 256).alias("h"))
    classes = hashed.groupBy("h").agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"))
    return hashed.join(classes, "h").select(key, "class_id", "class_size")
