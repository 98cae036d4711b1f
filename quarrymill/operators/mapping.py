"""The map of a collection: clusters, their names, a plane and its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectors as V


def fit_clusters(vectors: DataFrame, k: int, dims: int, sample: int = 20_000, seed: int = 42):
    """Centroids of spherical k-means, fitted on at most ``sample`` rows (smallest hashes of the id) by ML's k-means||."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    h = F.xxhash64("id")
    found = vectors.where(V.usable(F.col("vector"), dims))
    total = vectors.count()
    if total > 2 * sample:  # about twice the sample is left before the sort, so what tasks send on does not grow
        found = found.where(h < F.lit(int(-(2**63) + (2 * sample + 200) / total * 2**64)))
    rows = found.orderBy(h, "id").limit(sample)
    fitted = KMeans(k=k, distanceMeasure="cosine", maxIter=25, seed=seed, featuresCol="f").fit(rows.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("f")))
    return [[float(x) for x in c] for c in fitted.clusterCenters()]


def assign_clusters(vectors: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """``id, cluster, similarity``: the most similar centroid (``cluster, center``) of each row; the first wins ties.

    Centroids are a stated few (k): each block of rows meets them in one matrix product, without a join.
    """
    rows = [(r["cluster"], list(r["center"])) for r in centroids.orderBy("cluster").collect()]
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cluster {centroids.schema['cluster'].dataType.simpleString()}, similarity double"

    def block(batches):
        import numpy as np
        import pandas as pd

        c = np.array([x for _, x in rows], float).reshape(-1, dims)
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        names = np.array([n for n, _ in rows])
        for b in batches:
            if len(b) and len(c):
                x = np.stack(b["vector"].to_numpy()).astype(float)
                sim = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ c.T, 6)
                best = sim.argmax(axis=1)
                yield pd.DataFrame({"id": b["id"], "cluster": names[best], "similarity": sim[np.arange(len(x)), best]})

    return vectors.where(V.usable(F.col("vector"), dims)).select("id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(block, schema)


def split_words(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")


def label_tokens(text: Column, stop: list[str]) -> Column:
    """Words that could name a group: three letters or more, no numbers, no record keys, no codes."""
    from ..functions.text import fold

    w = F.split(fold(split_words(text)), "[^a-z0-9]+")
    stops = F.array(*[F.lit(s) for s in stop])

    def good(t: Column) -> Column:
        code = (F.length(t) > 5) & t.rlike("[bcdfghjklmnpqrstvwxz]{4}")
        return F.length(t).between(3, 24) & ~F.array_contains(stops, t) & ~t.rlike(r"^\d+$") & ~((F.length(t) > 4) & t.rlike(r"\d[a-z]")) & ~code & ~t.rlike(r"^[a-z]{1,2}\d+$")

    return F.array_distinct(F.filter(w, good))


def name_scores(rows: DataFrame, stop: list[str]) -> DataFrame:
    """``grp, term, f, df, score`` of ``grp, key, text`` rows: words frequent in a group and rare in the others.

    A word counts once for each ``key`` (document) of a group, so one long document cannot name it.
    """
    terms = rows.select("grp", "key", F.explode(label_tokens(F.col("text"), stop)).alias("term"))
    f = terms.groupBy("grp", "term").agg(F.count_distinct("key").alias("f"))
    df = f.groupBy("term").agg(F.count("*").alias("df"))
    groups = rows.agg(F.count_distinct("grp")).scalar()
    s = (1 + F.log("f")) * F.log((F.col("g") + 1) / (F.col("df") + 0.5))
    return f.join(df, "term").withColumn("g", groups).select("grp", "term", "f", "df", F.round(s, 6).alias("score"))


def name_groups(scores: DataFrame, terms: int = 3) -> DataFrame:
    """``grp, name``: the best words of each group, none that begins like one already taken.

    A word gives way to a better one with its first five letters; what is left is taken in order.
    """
    stem = F.row_number().over(W.partitionBy("grp", F.substring("term", 1, 5)).orderBy(F.desc("score"), "term"))
    left = scores.withColumn("_s", stem).where(F.col("_s") == 1)
    ranked = left.withColumn("_r", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("score"), "term"))).where(F.col("_r") <= terms)
    return ranked.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]), " ").alias("name"))


def common_spelling(rows: DataFrame, text: str) -> DataFrame:
    """``word, spelling``: how a folded word is mostly written; ties go to capitals, then the alphabet."""
    from ..functions.text import fold

    w = rows.select(F.explode(F.split(split_words(F.col(text)), r"[^\p{L}\p{N}]+")).alias("spelling")).where(F.col("spelling") != "")
    n = w.groupBy("spelling").agg(F.count("*").alias("n")).withColumn("word", fold(F.col("spelling")))
    order = F.struct((-(F.col("n") * 10 + F.col("spelling").rlike("[A-Z]").cast("int"))).alias("s"), "spelling")
    return n.groupBy("word").agg(F.min(order).alias("b"), F.sum("n").alias("uses")).select("word", F.col("b.spelling").alias("spelling"), "uses")


def grid_cells(points: DataFrame, cells: int, least: int) -> DataFrame:
    """``cx, cy, n, x, y``: dense cells of a grid over the points' bounds, with their mean."""
    b = points.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))).scalar()
    side = lambda a, z: F.coalesce(F.nullif(F.col(z) - F.col(a), F.lit(0.0)), F.lit(1.0)) / cells
    at = lambda v, a, z: F.least(F.lit(cells - 1), F.floor((F.col(v) - F.col(a)) / side(a, z)).cast("int"))
    r3 = lambda c: F.floor(c * 1000 + 0.5) / 1000
    placed = points.withColumn("_b", b).select("x", "y", "_b.*").select(at("x", "x0", "x1").alias("cx"), at("y", "y0", "y1").alias("cy"), "x", "y")
    return placed.groupBy("cx", "cy").agg(F.count("*").alias("n"), r3(F.avg("x")).alias("x"), r3(F.avg("y")).alias("y")).where(F.col("n") >= least)


def plane(vectors: DataFrame, dims: int) -> DataFrame:
    """``id, x, y``: the first two principal components (in place of a neighbour embedding, which Spark lacks)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where(V.usable(F.col("vector"), dims)).select("id", array_to_vector(V.l2_normalise(F.col("vector"))).alias("f"))
    out = PCA(k=2, inputCol="f", outputCol="p").fit(rows).transform(rows)
    return out.select("id", vector_to_array("p").alias("p")).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
