"""What an answering loop needs from data: history, budgets, carried passages, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def budget_prefix(rows: DataFrame, by: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The first rows of each ``by`` whose sizes add up to ``budget``; always one, and none after the first that does not fit."""
    w = W.partitionBy(by).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"_n": F.row_number().over(w), "_sum": total}).where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_n", "_sum")


def carry_blocks(blocks: DataFrame, max_blocks: int = 24, budget: int = 24_000) -> DataFrame:
    """``conv, n, chunk_id, size, cited`` passages that a later turn keeps, by ``n``.

    Cited ones first, then the newest; each chunk once.  A passage that does not fit is skipped and smaller ones
    after it may still fit, so the choice is a fold over a conversation's passages, in the JVM.
    """
    once = blocks.groupBy("conv", "chunk_id").agg(F.max(F.struct(F.col("cited").cast("int").alias("cited"), "n", "size")).alias("b"))
    ordered = once.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct((-F.col("b.cited")).alias("c"), (-F.col("b.n")).alias("m"), F.col("chunk_id").alias("id"), F.col("b.size").cast("long").alias("size"))), asc=True).alias("bs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<n:bigint,chunk_id:string,size:bigint>>").alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["size"] <= budget) & (F.size(acc["kept"]) < max_blocks)
        item = F.struct((-x["m"]).cast("long").alias("n"), x["id"].alias("chunk_id"), x["size"].alias("size"))
        return F.when(fits, F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["kept"], F.array(item)).alias("kept"))).otherwise(acc)

    folded = ordered.select("conv", F.aggregate("bs", start, take).alias("f"))
    return folded.select("conv", F.explode(F.sort_array("f.kept")).alias("k")).select("conv", "k.n", "k.chunk_id", "k.size")


def cited_numbers(text: Column, valid: Column) -> Column:
    """The numbers in ``[1]`` marks that exist, in order of first use."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    return F.array_intersect(found, valid)


def last_question(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The last user turn of each conversation."""
    return turns.where(F.col("role") == "user").groupBy(conv).agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("turn"))


def history_window(turns: DataFrame, last: int, conv: str = "conv_id") -> DataFrame:
    """The ``last`` turns of each conversation that are no system turns."""
    w = W.partitionBy(conv).orderBy(F.desc("turn"))
    return turns.where(F.col("role") != "system").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).drop("_n")


def without_context(hits: DataFrame, seen_chunks: DataFrame, seen_documents: DataFrame, want: int) -> DataFrame:
    """Search results minus the passages and whole documents that a conversation already has, then ``want`` of each query."""
    left = hits.join(seen_chunks, ["qid", "id"], "left_anti").join(seen_documents, ["qid", "source_id"], "left_anti")
    return left.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("_n") <= want).drop("_n")


def number_blocks(blocks: DataFrame, spent: DataFrame) -> DataFrame:
    """New passages numbered after the greatest number that a conversation has spent; numbers are never used again."""
    w = W.partitionBy("conv").orderBy("rank")
    return blocks.join(spent, "conv", "left").withColumn("n", F.coalesce("spent", F.lit(0)) + F.row_number().over(w)).drop("spent")


def weak_match(best_similarity: Column, query: Column, contains: Column, threshold: float = 0.65) -> Column:
    """Whether results are probably beside the question: low similarity, three words or more, no literal filter."""
    return (best_similarity < threshold) & (F.size(F.split(F.trim(query), r"\s+")) >= 3) & contains.isNull()


def deep_link(url: Column, kind: Column, line_start: Column, line_end: Column) -> Column:
    """The address of a passage; source files get their line range."""
    lines = F.when(line_end > line_start, F.concat(F.lit("#L"), line_start.cast("string"), F.lit("-"), line_end.cast("string"))).otherwise(F.concat(F.lit("#L"), line_start.cast("string")))
    blob = url.contains("/-/blob/") & (line_start > 0) & (F.lower(kind) == "code")
    return F.when(blob, F.concat(F.regexp_replace(url, "#.*$", ""), lines)).otherwise(url)


def group_by_document(hits: DataFrame) -> DataFrame:
    """Results grouped by document, in the order of their best passage."""
    g = hits.groupBy("qid", "source_id").agg(F.min("rank").alias("best"), F.count("*").alias("passages"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("best")))
