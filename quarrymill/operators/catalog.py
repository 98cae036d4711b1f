"""Catalogs of entities, repositories and pages: who belongs to what, what is taken, what is left out."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import wildcard_regex


def discover(listings: list[DataFrame], path: str = "path") -> DataFrame:
    """Repositories of several listings, each once whatever the case of its path; earlier listings win."""
    tagged = [l.withColumn("_p", F.lit(i)) for i, l in enumerate(listings)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = [c for c in rows.columns if c != "_p"]
    return rows.groupBy(F.lower(path).alias("_k")).agg(F.min_by(F.struct(*cols), F.struct("_p", path)).alias("r")).select("r.*")


def catalog_parts(modules: DataFrame, components: DataFrame) -> DataFrame:
    """``part, module``: the module of every component; what modules list comes before what components say.

    ``modules`` has ``module, targets`` (``component:default/name``), ``components`` ``name, module``; the first by
    name wins.
    """
    listed = modules.select("module", F.explode("targets").alias("t")).select("module", F.regexp_extract("t", r"^(?:component|api|resource):(?:[^/]+/)?(.+)$", 1).alias("part"), F.lit(0).alias("_p"))
    said = components.where(F.col("module").isNotNull()).select("module", F.col("name").alias("part"), F.lit(1).alias("_p"))
    return listed.unionByName(said).where(F.col("part") != "").groupBy("part").agg(F.min(F.struct("_p", "module")).alias("m")).select("part", "m.module")


def repository_entities(entities: DataFrame) -> DataFrame:
    """``repo, name``: the entity of each repository: the last that documents it, else the first."""
    g = entities.where(F.col("repo").isNotNull()).groupBy(F.lower("repo").alias("repo"))
    return g.agg(F.max_by("name", F.when(F.col("documents"), F.col("pos"))).alias("d"), F.min_by("name", "pos").alias("f")).select("repo", F.coalesce("d", "f").alias("name"))


def lookup_pages(by_title: DataFrame, by_text: DataFrame, most: int) -> DataFrame:
    """``key, url, place``: pages that a search found, title matches first, text matches for what is left, each address once."""
    rows = by_title.withColumn("_p", F.lit(0)).unionByName(by_text.withColumn("_p", F.lit(1)))
    once = rows.groupBy("key", "url").agg(F.min(F.struct("_p", "pos")).alias("o"))
    return once.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("o", "url"))).where(F.col("place") <= most).select("key", "url", "place")


def excluded_by_tree(pages: DataFrame, chains: DataFrame, ids: list[str], titles: list[str]) -> DataFrame:
    """``id`` of the pages that are, or lie below, an excluded one.

    ``pages`` has ``id, title``, ``chains`` the pages' ancestors (``id, ancestor``).
    """
    hit = F.col("id").isin(ids)
    for t in titles:
        hit = hit | F.coalesce(F.col("title"), F.lit("")).rlike(wildcard_regex(t))
    roots = pages.where(hit).select("id")
    below = chains.join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    return roots.union(below).distinct()


def free_paths(docs: DataFrame) -> DataFrame:
    """``source_id, rel_path``: later claimants of a path get the last six characters of their encoded id."""
    claim = F.row_number().over(W.partitionBy("rel_path").orderBy("seq", "source_id"))
    coded = F.regexp_replace(F.translate(F.base64(F.col("source_id").cast("binary")), "+/", "-_"), r"[=\r\n]", "")
    other = F.regexp_replace("rel_path", r"\.md$", "")
    return docs.withColumn("_c", claim).select("source_id", F.when(F.col("_c") == 1, F.col("rel_path")).otherwise(F.concat(other, F.lit("-"), F.right(coded, F.lit(6)), F.lit(".md"))).alias("rel_path"))


def language_shares(files: DataFrame, key: str, language: str, size: str, most: int = 6) -> DataFrame:
    """``key, language, percent, rank``: the languages of each key by share of size."""
    sums = files.groupBy(key, F.col(language).alias("language")).agg(F.sum(size).alias("s"))
    share = F.round(100 * F.col("s") / F.sum("s").over(W.partitionBy(key)), 1)
    ranked = sums.withColumn("percent", share).withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("s"), "language")))
    return ranked.where(F.col("rank") <= most).select(key, "language", "percent", "rank")


def filter_spec(spec: str) -> Column:
    """``lang=it|en,id=adr-``: any of the values; ``id`` by its beginning, booleans as text."""
    out = F.lit(True)
    for part in spec.split(","):
        name, sep, values = part.partition("=")
        if sep and name.strip():
            wanted = [v.strip() for v in values.split("|")]
            if name.strip() == "id":
                out = out & reduce(lambda a, b: a | b, [F.col("id").startswith(v) for v in wanted])
            else:
                out = out & F.col(name.strip()).cast("string").isin(wanted)
    return F.coalesce(out, F.lit(False))


def reports_of(pages: DataFrame, reports: DataFrame, most: int = 3) -> DataFrame:
    """``source_id, report_id, rank``: the newest open reports about each page, by their target or else any of their sources."""
    about = F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.coalesce("sources", F.array().cast("array<string>")))
    open_ = reports.where(F.col("status") == "new").select(F.col("id").alias("report_id"), "ts", F.explode(F.array_distinct(about)).alias("source_id"))
    met = open_.join(pages.select("source_id"), "source_id", "left_semi")
    return met.withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("ts"), "report_id"))).where(F.col("rank") <= most).select("source_id", "report_id", "rank")


def pinned_reports(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each report's sources with the hashes they have now; null for sources that are not indexed."""
    s = reports.select(F.col("id").alias("report_id"), F.explode("sources").alias("source_id"))
    return s.join(manifest.select("source_id", "content_hash", "embed_hash"), "source_id", "left").select("report_id", "source_id", "content_hash", "embed_hash")


def tool_calls(text: str) -> list[tuple[str, dict]]:
    """(name, arguments) of the calls that a model wrote into its text, as JSON or as tags."""
    found = []
    for m in re.finditer(r"<tool_call>\s*(\{.*?\})\s*(?:</tool_call>|\Z)", text, re.S):
        try:
            call = json.loads(m[1])
        except ValueError:
            continue
        inner = call.get("function") if isinstance(call.get("function"), dict) else {}
        name, args = call.get("name") or inner.get("name"), call.get("arguments") or inner.get("arguments")
        if name:
            found.append((name, args if isinstance(args, dict) else {}))
    for m in re.finditer(r"<function=([\w.-]+)>(.*?)(?:</function>|</tool_call>|\Z)", text, re.S):
        found.append((m[1], {k: v.strip() for k, v in re.findall(r"<parameter=([\w.-]+)>(.*?)(?:</parameter>|\Z)", m[2], re.S)}))
    return found
