"""Problem 7: a mixture of sources that meets target shares within repeat caps.

Method: Poisson replication.  A record's number of copies is the inverse of the
Poisson distribution function at a uniform number hashed from its id, cut at
its source's cap.  The mean is set for each source so that the copies' tokens
come to the source's share: the tokens of every record are summed by source and
by ``STEPS`` steps of the hashed number, a table of fixed size, over which the
mean is solved.  So the shares hold for the very records drawn, not only on
average.

Unless a total is given, the mixture is ``MARGIN`` of the largest at which every
source that has records can reach its share within its cap, so that the scarcest source
is drawn by a finite mean as the others are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens as T
from .common import spread

#: Steps of the hashed number by which tokens are summed.
STEPS = 4096
SEED = 7
#: Share of the largest possible mixture that is drawn: at all of it the scarcest source would repeat every record up to its cap.
MARGIN = 0.98
NO_SOURCE = "(none)"


def source_name(column: str) -> F.Column:
    """Sources without case and outer blanks; null and blank are no source."""
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def poisson_counts(u: np.ndarray, mean: float, cap: int) -> np.ndarray:
    """The inverse Poisson distribution function at ``u``, at most ``cap``."""
    if mean == math.inf:
        return np.full(len(u), cap)
    term = total = math.exp(-mean)
    out = np.zeros(len(u), np.int64)
    for k in range(cap):
        out += u >= total
        term *= mean / (k + 1)
        total += term
    return out


def solve_mean(tokens: np.ndarray, wanted: float, cap: int) -> float:
    """The mean whose copies come nearest to ``wanted`` tokens; ``tokens`` by step of the hashed number."""
    u = (np.arange(len(tokens)) + 0.5) / len(tokens)
    drawn = lambda mean: float((tokens * poisson_counts(u, mean, cap)).sum())
    if wanted <= 0 or cap <= 0:
        return 0.0
    if wanted >= tokens.sum() * cap * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while drawn(high) < wanted and high < 600:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if drawn(mid) < wanted else (low, mid)
    return low if abs(drawn(low) - wanted) <= abs(drawn(high) - wanted) else high


def records_of(documents: DataFrame) -> DataFrame:
    """``doc_id, text, source, u``: every record with its source and hashed number; rows without doc_id are left out."""
    h = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.coalesce("text", F.lit("")))
    u = F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2**53))
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.coalesce(source_name("source"), F.lit(NO_SOURCE)).alias("source"), u.alias("u"))


def with_tokens(records: DataFrame, path: str = T.VOCABULARY, keep_text: bool = True) -> DataFrame:
    """``records`` with their size in tokens; records without tokens are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["tokens"] = [T.count(t if isinstance(t, str) else None, path) for t in b["text"]]
            yield b if keep_text else b.drop(columns="text")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema if keep_text or f.name != "text")
    return spread(records).mapInPandas(run, schema + ", tokens int").where(F.col("tokens") > 0)


def plan(records: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """For each target source: share, cap, tokens there are, tokens wanted, and the mean that reaches them."""
    aims = [r.asDict() for r in targets.withColumn("source", source_name("source")).where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect()]
    step = F.least(F.floor(F.col("u") * STEPS), F.lit(STEPS - 1)).cast("int")
    summed = records.where(F.col("source").isin([a["source"] for a in aims])).groupBy("source", step.alias("step")).agg(F.sum("tokens").alias("tokens")).toPandas()
    for a in aims:
        own = summed[summed["source"] == a["source"]]
        a["by_step"] = np.zeros(STEPS)
        a["by_step"][own["step"].to_numpy(int)] = own["tokens"].to_numpy(float)
        a["available"] = float(a["by_step"].sum())
        a["share"], a["cap"] = float(a["share"] or 0), int(a["cap"] or 0)
    if total is None:
        reach = [a["available"] * a["cap"] / a["share"] for a in aims if a["share"] > 0 and a["available"] * a["cap"] > 0]
        total = min(reach) * MARGIN if reach else 0.0
    for a in aims:
        a["wanted"] = min(total * a["share"], a["available"] * a["cap"])
        a["mean"] = solve_mean(a.pop("by_step"), a["wanted"], a["cap"])
    return aims


def copies(records: DataFrame, aims: list[dict]) -> DataFrame:
    """``records`` with their number of copies, in built-in expressions: one comparison for each possible copy."""
    number = F.lit(0)
    for a in aims:
        if a["mean"] == math.inf:
            own = F.lit(a["cap"])
        else:
            term = total = math.exp(-a["mean"])
            own = F.lit(0)
            for k in range(a["cap"]):
                own = own + (F.col("u") >= F.lit(total)).cast("int")
                term *= a["mean"] / (k + 1)
                total += term
        number = F.when(F.col("source") == a["source"], own).otherwise(number)
    return records.withColumn("n", number)


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = T.VOCABULARY) -> tuple[DataFrame, list[dict]]:
    """The mixture in random order, and its plan.

    ``doc_id, source, copy, tokens, place, text``: one row for each copy, numbered from 1; ``place`` is the
    hashed place in the global order.  Records of no target source, or without tokens, take no part; repeated
    rows are records of their own and draw alike.
    """
    records = records_of(documents)
    aims = plan(with_tokens(records, path, keep_text=False), targets, total)
    # Only what is drawn is sized again: cheaper than a second copy of every text on disk.
    drawn = with_tokens(copies(records, aims).where(F.col("n") > 0), path).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    place = F.xxhash64(F.lit(SEED + 1), "doc_id", "copy")
    return drawn.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "tokens", place.alias("place"), "text"), aims


def p7_mixture(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The mixture in the order of ``place``.

    Places are hashes, evenly spread, so the parts of the order are known beforehand and nothing is sampled for it.
    """
    mixture, _ = mix(documents, targets)
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions())
    part = F.least(F.floor((F.col("place") / F.lit(2.0**64) + F.lit(0.5)) * parts), F.lit(parts - 1)).cast("int")
    return mixture.repartitionById(parts, part).sortWithinPartitions("place", "doc_id", "copy")


def p7_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target source: the share wanted and the share really reached, and how often records repeat."""
    mixture, aims = mix(documents, targets)
    spark = documents.sparkSession
    schema = "source string, target_share double, max_repeats int, available_tokens double, mean double"
    wanted = spark.createDataFrame([(a["source"], a["share"], a["cap"], a["available"], a["mean"]) for a in aims], schema)
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.max("copy").alias("most_copies"))
    joined = wanted.join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(W.partitionBy(F.lit(0))))  # a row for each target
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), "max_repeats", "available_tokens", F.round("mean", 6).alias("mean"), z("tokens"), z("copies"), z("most_copies"))
