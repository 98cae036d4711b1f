"""Vectors: normalise, embed, exact search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from .graph import _checkpointed

#: Queries that one pass over the rows answers, and bytes of a task's product of queries and rows.
MAX_QUERIES = 50_000
PRODUCT_BYTES = 64 << 20


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it: a lambda's variable is not expanded."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    by = lambda v: bound(F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)), lambda n: F.transform(v, lambda x: x.cast("double") / n))
    return F.when(v.isNotNull(), bound(v, by))


def truncate(v: Column, dims: int) -> Column:
    """The first ``dims`` numbers, normalised again; null when there are fewer."""
    return F.when(F.size(v) >= dims, l2_normalise(F.slice(v, 1, dims)))


def usable(v: Column, dims: int) -> Column:
    """Exactly ``dims`` finite numbers, not all of them zero."""
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return bound(v, lambda v: F.coalesce((F.size(v) == dims) & finite(v) & F.exists(v, lambda x: x != 0), F.lit(False)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mock_embedding(text: Column, dims: int = 256) -> Column:
    """A deterministic embedding without a model.

    Each lower-case word adds +1 or -1 (the fifth byte of its md5, odd or even) at the index of its first
    four bytes, little endian, modulo ``dims``; the sum is normalised.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def place(w: Column) -> Column:
        h = F.md5(w.cast("binary"))
        le = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
        return F.struct((F.conv(le, 16, 10).cast("long") % dims).cast("int").alias("i"), F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0).alias("s"))

    places = F.transform(found, place)
    zero = F.array_repeat(F.lit(0.0), dims)
    summed = F.aggregate(places, zero, lambda acc, p: F.transform(acc, lambda x, i: F.when(i == p["i"], x + p["s"]).otherwise(x)))
    return l2_normalise(summed)


def embedding_components(texts: DataFrame, key: str, dims: int = 256) -> DataFrame:
    """The mock embedding in long form (``key, i, value``), one shuffle, for texts of any length."""
    w = texts.select(key, F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    h = F.md5(F.col("w").cast("binary"))
    le = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    return w.select(key, (F.conv(le, 16, 10).cast("long") % dims).alias("i"), sign.alias("s")).groupBy(key, "i").agg(F.sum("s").alias("value"))


def search(vectors: DataFrame, queries: DataFrame, k: int = V.CANDIDATES, dims: int = 64) -> DataFrame:
    """``qid, id, distance, similarity, rank``: each query's ``k`` nearest by exact cosine distance.

    ``vectors`` is ``id, vector``, ``queries`` ``qid, qvec``: a stated set, scored against every row in blocks of
    Arrow batches with one matrix product a block; a block hands on its ``k`` best, so what is shuffled is
    blocks x queries x k rows, not all pairs.  Ties by id.  Unusable vectors take no part.
    """
    asked = queries.where(usable(F.col("qvec"), dims)).select("qid", F.col("qvec").cast("array<double>").alias("qvec"))
    passes = max(1, -(-asked.count() // MAX_QUERIES))
    if passes > 1:
        # Too many for one broadcast: a pass over the rows for each part of them, its result written before the next.
        part = F.pmod(F.xxhash64("qid"), F.lit(passes))
        done = [_checkpointed(_search_pass(vectors, asked.where(part == p), k, dims)) for p in range(passes)]
        hits = reduce(DataFrame.unionByName, done)
    else:
        hits = _search_pass(vectors, asked, k, dims)
    order = W.partitionBy("qid").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_pass(vectors: DataFrame, queries: DataFrame, k: int, dims: int) -> DataFrame:
    """The candidates of at most about ``MAX_QUERIES`` queries, which go out once: 25 MB at 64 numbers."""
    rows = [(r["qid"], r["qvec"]) for r in queries.collect()]
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    id_kind = vectors.schema["id"].dataType.simpleString()
    schema = f"qid {kinds['qid']}, id {id_kind}, distance double, similarity double"

    def block(batches):
        import numpy as np
        import pandas as pd

        q = np.array([v for _, v in rows], float).reshape(-1, dims)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        qids = np.array([r for r, _ in rows])
        for b in batches:
            if not len(b) or not len(q):
                continue
            x = np.stack(b["vector"].to_numpy()).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            ids = b["id"].to_numpy()
            most = min(k, len(ids)) - 1
            step = max(1, PRODUCT_BYTES // (8 * len(ids)))
            for at in range(0, len(q), step):
                near = np.clip(np.round(1 - q[at : at + step] @ x.T, 6), 0, 2)
                # All that tie with the k-th stay, so that ties are broken once, over all blocks.
                i, j = np.nonzero(near <= np.partition(near, most, axis=1)[:, most : most + 1])
                yield pd.DataFrame({"qid": qids[at + i], "id": ids[j], "distance": near[i, j], "similarity": np.round(1 - near[i, j], 6)})

    return vectors.where(usable(F.col("vector"), dims)).select("id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(block, schema)


def random_projection(vectors: DataFrame, dims_in: int, dims_out: int, seed: int = 42) -> DataFrame:
    """``id, vector`` projected by a seeded Gaussian matrix over sqrt(out), then normalised."""
    shipped = vectors.sparkSession.sparkContext.broadcast(_matrix(dims_in, dims_out, seed))  # dims_in x dims_out numbers

    def block(batches):
        import numpy as np

        for b in batches:
            x = np.stack(b["vector"].to_numpy()).astype(float) @ shipped.value if len(b) else np.zeros((0, dims_out))
            n = np.linalg.norm(x, axis=1, keepdims=True)
            b["vector"] = list((x / np.where(n == 0, 1, n)).astype("float32"))
            yield b

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.where(usable(F.col("vector"), dims_in)).select("id", "vector").mapInPandas(block, f"id {kind}, vector array<float>")


def _matrix(dims_in: int, dims_out: int, seed: int):
    """Gaussians by Box and Muller from the 32-bit mixer ``mulberry32``, so that a seed means the same everywhere."""
    import math

    import numpy as np

    state = seed & 0xFFFFFFFF

    def uniform() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    out = np.empty(dims_in * dims_out)
    for i in range(len(out)):
        u = 0.0
        while u == 0.0:
            u = uniform()
        out[i] = math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * uniform())
    return out.reshape(dims_in, dims_out) / math.sqrt(dims_out)
