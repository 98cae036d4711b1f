"""Hybrid retrieval: two rankers fused, boosted, capped, without near duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from . import bm25, dedupe, vectors
from .filters import Filters, predicate


@dataclass(frozen=True)
class Options:
    candidates: int = V.CANDIDATES
    top_k: int = V.TOP_K
    rrf_k: int = V.RRF_K
    weight_vector: float = V.RRF_WEIGHT_VECTOR
    weight_keyword: float = V.RRF_WEIGHT_KEYWORD
    max_per_document: int = V.MAX_PER_DOCUMENT
    boost: bool = True
    drop_duplicates: bool = True
    dims: int = 64


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, o: Options = Options()) -> DataFrame:
    """``qid, id, score, vector_rank, keyword_rank, similarity`` by reciprocal ranks; a ranker that missed a row adds nothing."""
    v = vector_hits.select("qid", "id", F.col("rank").alias("vector_rank"), "similarity")
    b = keyword_hits.select("qid", "id", F.col("rank").alias("keyword_rank"))
    term = lambda w, r: F.coalesce(F.lit(w) / (F.lit(o.rrf_k) + F.col(r)), F.lit(0.0))
    return v.join(b, ["qid", "id"], "full").withColumn("score", term(o.weight_vector, "vector_rank") + term(o.weight_keyword, "keyword_rank"))


def authority_boost(authority: Column) -> Column:
    out = F.lit(1.0)
    for name, factor in V.AUTHORITY_BOOST.items():
        out = F.when(authority == name, factor).otherwise(out)
    return out


def best_order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.asc("id")]


def rank_fused(fused: DataFrame, chunks: DataFrame, o: Options = Options()) -> DataFrame:
    """Fused candidates with their rows, boosted, capped by document, ranked.

    The order is fixed: boost, sort, cap, then duplicates; a capped passage never claims to be a twin.
    The wide columns meet the candidates here, after both rankers' cut.
    """
    rows = fused.join(chunks.select("id", "source_id", "authority", "text"), "id")
    if o.boost:
        rows = rows.withColumn("score", F.col("score") * authority_boost(F.col("authority")))
    rows = rows.withColumn("score", F.round("score", 6))
    within = F.row_number().over(W.partitionBy("qid", "source_id").orderBy(*best_order()))
    capped = rows.withColumn("_n", within).where(F.col("_n") <= o.max_per_document).drop("_n")
    return capped.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*best_order())))


def search(chunks: DataFrame, queries: DataFrame, index: bm25.Index | None = None, filters: Filters = Filters(), o: Options = Options()) -> DataFrame:
    """``qid, id, source_id, score, rank, vector_rank, keyword_rank, similarity, duplicates`` for ``queries`` (qid, text, qvec).

    Filters restrict both rankers before they cut; the keyword index keeps its statistics of all rows.
    """
    index = index or bm25.build(chunks)
    allowed = chunks.where(predicate(filters)) if filters else chunks
    by_vector = vectors.search(allowed.select("id", "vector"), queries.select("qid", "qvec"), o.candidates, o.dims)
    by_keyword = bm25.search(index, queries.select("qid", "text"), o.candidates, allowed if filters else None)
    ranked = rank_fused(fuse(by_vector, by_keyword, o), chunks, o)
    cols = ["qid", "id", "source_id", "score", "vector_rank", "keyword_rank", "similarity", "rank"]
    if o.drop_duplicates:
        kept = dedupe.drop_near_duplicates(ranked.select(*cols, "text")).drop("text")
    else:
        kept = ranked.select(*cols).withColumn("duplicates", F.array().cast("array<string>"))
    final = F.row_number().over(W.partitionBy("qid").orderBy("rank"))
    return kept.withColumn("rank", final).where(F.col("rank") <= o.top_k)


def rerank(hits: DataFrame, scores: DataFrame, k: int, wide: int = 3) -> DataFrame:
    """``qid, id, score, rank``: the first ``wide * k`` hits ordered by a judge's scores (0 to 10), then by their own.

    ``hits`` has ``qid, id, score, rank``; ``scores`` has ``qid, id, judged``.  A hit's new score is a tenth of the judged one and its own;
    those that the judge left out count as 0.
    """
    few = hits.where(F.col("rank") <= wide * k).join(scores.select("qid", "id", "judged"), ["qid", "id"], "left")
    judged = F.least(F.greatest(F.coalesce("judged", F.lit(0.0)), F.lit(0.0)), F.lit(10.0))
    scored = few.withColumn("_j", judged).withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("_j"), F.desc("score"), "rank")))
    return scored.where(F.col("_r") <= k).select("qid", "id", F.round(F.col("_j") / 10 + F.col("score"), 6).alias("score"), F.col("_r").alias("rank"))
