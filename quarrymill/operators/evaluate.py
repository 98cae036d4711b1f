"""Retrieval quality: scores by case, summaries by any grouping, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_documents(hits: DataFrame) -> DataFrame:
    """``qid, retrieved``: the distinct documents of a ranking, in order of their best passage."""
    best = hits.groupBy("qid", "source_id").agg(F.min("rank").alias("r"))
    return best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "source_id"))), lambda x: x["source_id"]).alias("retrieved"))


def score_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """``cases`` (qid, expected, …) with ``retrieved, rank, recall``.

    ``rank`` counts distinct documents and is null when none expected was found.  ``recall`` is the share of the
    expected documents found, 0 when none is expected.
    """
    j = cases.join(distinct_documents(hits), "qid", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    positions = F.filter(F.transform("expected", lambda e: F.array_position("retrieved", e)), lambda p: p > 0)
    found = F.size(F.array_intersect("expected", "retrieved"))
    n = F.size(F.array_distinct("expected"))
    return j.withColumns({"rank": F.array_min(positions).cast("int"), "recall": F.when(n > 0, F.round(found / n, 6)).otherwise(F.lit(0.0))})


def passed(should_abstain: Column, rank: Column, k: int) -> Column:
    """A case passes when an expected document is in the first ``k``; one that expects nothing passes without answers."""
    return should_abstain | F.coalesce(rank <= k, F.lit(False))


def measures(k: int) -> list[Column]:
    r = F.col("rank")
    positive = ~F.col("should_abstain")
    ratio = lambda x: F.round(F.avg(F.when(positive, x)), 6)
    return [
        F.count("*").alias("n"),
        F.count_if(positive).alias("answerable"),
        ratio(F.when(r <= k, 1.0).otherwise(0.0)).alias("hit_at_k"),
        ratio(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
        ratio(F.col("recall")).alias("recall"),
        F.round(F.avg(passed(F.col("should_abstain"), r, k).cast("double")), 6).alias("pass_rate"),
    ]


def summarise(scored: DataFrame, groups: list[str], k: int = 6) -> DataFrame:
    """Measures overall and by each of ``groups`` in one pass: ``grouping, value`` and the measures."""
    sets = scored.groupingSets([[F.col(g)] for g in groups] + [[]], *[F.col(g) for g in groups]).agg(*measures(k), *[F.grouping(g).alias(f"_g_{g}") for g in groups])
    name = F.lit("all")
    value = F.lit("all")
    for g in groups:
        name = F.when(F.col(f"_g_{g}") == 0, g).otherwise(name)
        value = F.when(F.col(f"_g_{g}") == 0, F.coalesce(F.col(g).cast("string"), F.lit("(none)"))).otherwise(value)
    return sets.select(name.alias("grouping"), value.alias("value"), "n", "answerable", "hit_at_k", "mrr", "recall", "pass_rate")


def percentile(column: str, p: float) -> Column:
    """Nearest rank, 0 when there is nothing."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {column})").cast("double"), F.lit(0.0))


def compare(before: DataFrame, after: DataFrame, k: int = 6) -> DataFrame:
    """``qid, change``: cases that one run passes and the other does not."""
    b = before.select("qid", passed(F.col("should_abstain"), F.col("rank"), k).alias("was"))
    a = after.select("qid", passed(F.col("should_abstain"), F.col("rank"), k).alias("is"))
    change = F.when(F.col("was") & ~F.col("is"), "regression").when(~F.col("was") & F.col("is"), "fix")
    return b.join(a, "qid").select("qid", change.alias("change")).where(F.col("change").isNotNull())


def compare_without_first(queries: DataFrame, hits: DataFrame, known: DataFrame, first: int, k: int = 6) -> DataFrame:
    """``qid, change``: ``compare`` of ``hits`` (qid, source_id, rank) with the same hits without the ``first`` ranks.

    ``queries`` is ``qid, t``; ``known`` names the documents that answer a ``t`` (t, source_id).  What is expected meets the few
    hits as rows: as lists, each query would carry every document that answers it.
    """
    known = known.where(F.col("t").isNotNull() & F.col("source_id").isNotNull()).select("t", "source_id").distinct()
    later = F.min(F.when(F.col("rank") > first, F.col("rank")))
    docs = hits.groupBy("qid", "source_id").agg(F.min("rank").alias("r"), later.alias("l"))
    place = lambda c: F.row_number().over(W.partitionBy("qid").orderBy(F.asc_nulls_last(c), "source_id"))
    docs = docs.withColumns({"was": place("r"), "now": F.when(F.col("l").isNotNull(), place("l"))})
    expected = docs.where((F.col("was") <= k) | (F.col("now") <= k)).join(queries, "qid").join(known, ["t", "source_id"], "left_semi")
    ranks = expected.groupBy("qid").agg(F.min("was").alias("was"), F.min("now").alias("now"))
    answered = queries.join(known.select("t").distinct().withColumn("_known", F.lit(True)), "t", "left").join(ranks, "qid", "left")
    judged = answered.select("qid", *[passed(F.col("_known").isNull(), F.col(c), k).alias(c) for c in ("was", "now")])
    return judged.where(F.col("was") != F.col("now")).select("qid", F.when(F.col("was"), "regression").otherwise("fix").alias("change"))


def validate_cases(cases: DataFrame, known: DataFrame) -> DataFrame:
    """``qid, problem``: repeated ids, repeated questions, expected documents that do not exist, documents with more than four questions."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    ids = cases.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("qid", F.lit("repeated id").alias("problem"))
    q = cases.withColumn("_q", norm)
    seen = q.groupBy("_q").agg(F.min("qid").alias("_first"))
    same = q.join(seen, "_q").where(F.col("qid") != F.col("_first")).select("qid", F.lit("repeated question").alias("problem"))
    exp = cases.select("qid", F.explode("expected").alias("source_id"))
    missing = exp.join(known.select("source_id").distinct(), "source_id", "left_anti").select("qid", F.lit("unknown document").alias("problem")).distinct()
    crowd = exp.groupBy("source_id").agg(F.count_distinct("qid").alias("n")).where(F.col("n") > 4)
    crowded = exp.join(crowd, "source_id", "left_semi").select("qid", F.lit("crowded document").alias("problem")).distinct()
    return ids.unionByName(same).unionByName(missing).unionByName(crowded)


def stride_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """A deterministic sample in steps over the order of ``key``: at most ``size`` rows, evenly spread."""
    n = rows.count()
    step = max(1, n // max(1, size))
    # The position is a prefix sum over range partitions, not one global window.
    ranged = rows.orderBy(key).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offset, at = {}, 0
    for p in sorted(sizes):
        offset[p] = at
        at += sizes[p]
    if not offset:
        return rows
    shift = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])
    local = F.row_number().over(W.partitionBy("_p").orderBy("_i")) - 1
    return ranged.withColumn("_pos", local + shift[F.col("_p")]).where((F.col("_pos") % step == 0) & (F.col("_pos") < step * size)).drop("_p", "_i", "_pos")


def missing_keywords(text: Column, keywords: Column) -> Column:
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return F.filter(keywords, lambda k: ~F.contains(flat(text), flat(k)))
