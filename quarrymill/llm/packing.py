"""Problem 6: texts assigned to containers of fixed capacity.

Method: vector bin packing by the dot-product heuristic.  An example has three
sizes: tokens, segments (one) and loss-bearing tokens (those outside heading
lines, which act as the prompt).  An open container takes, of the examples that
fit all three limits, the one whose sizes have the largest dot product with
what is left of each limit, until none fits.

Examples are dealt at random into groups of about ``GROUP_ROWS``, each packed
by one task.  Containers that a group could not fill to ``KEEP_FILL`` are
opened again, and their examples are packed together in a second round, so
what is left over is a matter of the last round's few groups.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import checkpointed, spread

GROUP_ROWS = 8192
KEEP_FILL = 0.995
#: Segments that a container may hold, as tokens of capacity for one segment.
TOKENS_A_SEGMENT = 16
#: Share of a container's tokens that may bear loss.
LOSS_SHARE = 1.0
#: Limits of ``p6_limits``, at which all three bind.
TIGHT_SEGMENT = 192
TIGHT_LOSS_SHARE = 0.9

_HEADING = re.compile(rb"(?m)^[ \t]{0,3}#{1,6}[ \t][^\n]*\n?")


def text_parts(text: str | None, capacities: list[int], path: str = T.VOCABULARY) -> list[tuple[int, int, int, int, int]]:
    """(capacity, part, first token, tokens, loss-bearing tokens) of a text for each capacity.

    A text is split only when it is above the capacity, into full parts and a rest.  Null and empty texts have none.
    """
    if not text:
        return []
    ids = T.encode(text, path)
    raw = text.encode("utf-8")
    begins = np.concatenate([[0], np.cumsum(T.token_bytes(path)[ids])])
    prompt = np.zeros(len(ids) + 1, np.int64)
    for m in _HEADING.finditer(raw):
        a, b = np.searchsorted(begins[:-1], [m.start(), m.end()])
        prompt[a] += 1
        prompt[b] -= 1
    loss = np.concatenate([[0], np.cumsum(np.cumsum(prompt[:-1]) == 0)])
    out = []
    for capacity in capacities:
        for k, at in enumerate(range(0, len(ids), capacity)):
            end = min(len(ids), at + capacity)
            out.append((capacity, k, at, end - at, int(loss[end] - loss[at])))
    return out


def examples(documents: DataFrame, capacities: list[int], path: str = T.VOCABULARY) -> DataFrame:
    """``doc_id, capacity, part, first_token, tokens, loss_tokens`` of every text for every capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *p) for d, t in zip(b["doc_id"], b["text"]) for p in text_parts(t if isinstance(t, str) else None, capacities, path)]
            yield pd.DataFrame(rows, columns=["doc_id", "capacity", "part", "first_token", "tokens", "loss_tokens"])

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, capacity int, part int, first_token long, tokens int, loss_tokens int")


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each example.  ``sizes`` is examples x limits; every example fits an empty container.

    Examples of equal sizes are one kind, so the work grows with the containers and the kinds, not the
    examples squared.
    """
    scaled = sizes / limits
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=len(kinds)))
    next_of = ends - np.bincount(kind, minlength=len(kinds))
    share = kinds / limits
    # Dimensions that are short overall weigh more.
    weight = scaled.sum(axis=0) / max(scaled.sum(), 1e-12)
    columns = [np.ascontiguousarray(c) for c in kinds.T]
    worth = [np.ascontiguousarray(c) for c in (share * weight).T]
    out = np.zeros(len(sizes), np.int64)
    alive = np.arange(len(kinds))
    bin_no = 0
    while len(alive):
        left = limits.astype(float).copy()
        fit = alive
        while len(fit):
            ok = columns[0][fit] <= left[0] + 1e-9
            for c, room in zip(columns[1:], left[1:]):
                ok &= c[fit] <= room + 1e-9
            fit = fit[ok]
            if not len(fit):
                break
            score = worth[0][fit] * (left[0] / limits[0])
            for w, part in zip(worth[1:], left[1:] / limits[1:]):
                score += w[fit] * part
            best = fit[np.argmax(score)]
            room = int(np.floor(((left + 1e-9) / np.maximum(kinds[best], 1e-9)).min()))
            # Take one: the next best may differ when less is left.
            take = 1 if room < 64 else min(room // 2, ends[best] - next_of[best])
            out[order[next_of[best] : next_of[best] + take]] = bin_no
            next_of[best] += take
            left -= kinds[best] * take
            if next_of[best] == ends[best]:
                fit = fit[fit != best]
                alive = alive[alive != best]
        bin_no += 1
    return out


def limits_of(capacity: int, tokens_a_segment: int = TOKENS_A_SEGMENT, loss_share: float = LOSS_SHARE) -> np.ndarray:
    """A container's limits on tokens, segments and loss-bearing tokens."""
    return np.array([capacity, max(1, capacity // tokens_a_segment), max(1, math.floor(capacity * loss_share))], float)


_PACKED = "capacity int, grp long, bin int, doc_id long, part int, first_token long, tokens int, loss_tokens int"


def _packer(tokens_a_segment: int, loss_share: float):
    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        limits = limits_of(int(pdf["capacity"].iloc[0]), tokens_a_segment, loss_share)
        pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        sizes = np.stack([pdf["tokens"].to_numpy(float), np.ones(len(pdf)), pdf["loss_tokens"].to_numpy(float)], axis=1)
        alone = sizes[:, 2] > limits[2]  # more loss than a container may bear: nothing else joins it
        bins = np.zeros(len(pdf), np.int64)
        bins[~alone] = pack(sizes[~alone], limits)
        bins[alone] = bins.max(initial=-1, where=~alone) + 1 + np.arange(alone.sum())
        pdf["bin"] = bins
        return pdf[["capacity", "grp", "bin", "doc_id", "part", "first_token", "tokens", "loss_tokens"]]

    return pack_group


def _round(items: DataFrame, counts: dict[int, int], seed: int, packer) -> DataFrame:
    groups = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, math.ceil(n / GROUP_ROWS)))]) if counts else F.create_map(F.lit(0), F.lit(1))
    grp = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "part", "capacity"), groups[F.col("capacity")].cast("long"))
    return items.withColumn("grp", grp).groupBy("capacity", "grp").applyInPandas(packer, _PACKED)


def pack_documents(documents: DataFrame, capacities: list[int], path: str = T.VOCABULARY, tokens_a_segment: int = TOKENS_A_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """``capacity, container, doc_id, part, first_token, tokens, loss_tokens``: where every text goes.

    Each capacity is a packing of its own.  ``container`` names it uniquely within its capacity.  Parts of
    one text are numbered from 0; rows with a null or empty text, or without a doc_id, are left out, repeated
    rows are examples of their own.
    """
    packer = _packer(tokens_a_segment, loss_share)
    items = checkpointed(examples(documents.where(F.col("doc_id").isNotNull()), capacities, path))
    full = items.where(F.col("tokens") >= F.col("capacity"))
    rest = items.where(F.col("tokens") < F.col("capacity"))
    counts = {r["capacity"]: r["n"] for r in rest.groupBy("capacity").agg(F.count("*").alias("n")).collect()}
    first = checkpointed(_round(rest, counts, 1, packer))
    fill = first.groupBy("capacity", "grp", "bin").agg(F.sum("tokens").alias("used"))
    open_bins = fill.where(F.col("used") < F.col("capacity") * KEEP_FILL).select("capacity", "grp", "bin")
    kept = first.join(open_bins, ["capacity", "grp", "bin"], "left_anti")
    again = first.join(open_bins, ["capacity", "grp", "bin"], "left_semi").drop("bin", "grp")
    left = {r["capacity"]: r["n"] for r in again.groupBy("capacity").agg(F.count("*").alias("n")).collect()}
    second = _round(again, left, 2, packer)
    name = lambda tag: F.concat_ws("-", F.lit(tag), F.col("grp").cast("string"), F.col("bin").cast("string")).alias("container")
    cols = ["doc_id", "part", "first_token", "tokens", "loss_tokens"]
    whole = full.select("capacity", F.concat_ws("-", F.lit("whole"), F.col("doc_id").cast("string"), F.col("part").cast("string")).alias("container"), *cols)
    return kept.select("capacity", name("a"), *cols).unionByName(second.select("capacity", name("b"), *cols)).unionByName(whole)


def p6_packing(documents: DataFrame, capacities: DataFrame, path: str = T.VOCABULARY, tokens_a_segment: int = TOKENS_A_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """The packing of ``documents`` for every row of ``pack_capacities`` (a few rows)."""
    sizes = [r for r in capacities.where(F.col("capacity_tokens") > 0).select("container", "capacity_tokens").distinct().collect()]
    packed = pack_documents(documents, sorted({r["capacity_tokens"] for r in sizes}), path, tokens_a_segment, loss_share)
    names = F.broadcast(capacities.select(F.col("container").alias("kind"), F.col("capacity_tokens").cast("int").alias("capacity")).distinct())
    return packed.join(names, "capacity").select("kind", "container", "doc_id", "part", "first_token", "tokens", "loss_tokens")


def p6_fill(documents: DataFrame, capacities: DataFrame, path: str = T.VOCABULARY) -> DataFrame:
    """For each kind of container: how many, how full, how many segments at most."""
    packed = p6_packing(documents, capacities, path)
    bins = packed.groupBy("kind", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"))
    sizes = F.broadcast(capacities.select(F.col("container").alias("kind"), F.col("capacity_tokens")).distinct())
    return bins.join(sizes, "kind").groupBy("kind").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / F.sum("capacity_tokens"), 6).alias("fill"), F.max("segments").alias("most_segments"), F.max("used").alias("most_tokens")
    )


def p6_limits(documents: DataFrame, capacities: DataFrame, path: str = T.VOCABULARY) -> DataFrame:
    """The packing under limits that all bind, by kind of container: how far each limit is used, and how often it is what is short.

    ``fill_tokens``, ``fill_segments`` and ``fill_loss`` are what is used of each limit, ``fullest`` the mean of each
    container's most used limit; ``by_tokens``, ``by_segments`` and ``by_loss`` count the containers by that limit.  A text
    that bears more loss than a container may is ``alone`` in one.
    """
    packed = p6_packing(documents, capacities, path, TIGHT_SEGMENT, TIGHT_LOSS_SHARE)
    bins = packed.groupBy("kind", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"))
    c = F.col("capacity_tokens")
    most = {"tokens": c, "segments": F.greatest(F.lit(1), F.floor(c / TIGHT_SEGMENT)), "loss": F.greatest(F.lit(1), F.floor(c * F.lit(TIGHT_LOSS_SHARE)))}
    sizes = F.broadcast(capacities.select(F.col("container").alias("kind"), "capacity_tokens").distinct())
    used = bins.join(sizes, "kind").withColumns({f"u_{k}": F.col(k) / v for k, v in most.items()})
    used = used.withColumn("top", F.greatest(*[F.col(f"u_{k}") for k in most]))
    within = F.col("u_loss") <= 1
    return used.groupBy("kind").agg(
        F.count("*").alias("containers"),
        *[F.round(F.avg(F.when(within, F.col(f"u_{k}"))), 4).alias(f"fill_{k}") for k in most],
        F.round(F.avg(F.when(within, F.col("top"))), 4).alias("fullest"),
        *[F.count_if(within & (F.col(f"u_{k}") == F.col("top"))).alias(f"by_{k}") for k in most],
        F.count_if(~within).alias("alone"),
        F.max(F.when(~within, F.col("segments"))).alias("most_alone"),
    )
