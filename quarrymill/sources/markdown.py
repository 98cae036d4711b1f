"""Folders of markdown files as documents, and documents as such files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import content_hash

#: Order of the fields in a written file's head.
FIELDS = ("source_id", "source_type", "kind", "title", "source_url", "authority", "lang", "last_modified", "fetched_at")


def parse_frontmatter(raw: str | None) -> tuple[dict[str, str], str]:
    """(fields, body) of a file.  A head that is no YAML is read line by line as ``key: value``; nothing is ever raised."""
    m = re.match(r"\A﻿?---[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\Z)", raw or "", re.S | re.M)
    if not m:
        return {}, raw or ""
    fields = None
    try:
        import yaml

        fields = yaml.safe_load(m[1])
    except Exception:
        fields = None
    if not isinstance(fields, dict):
        fields = {k.strip(): v.strip().strip("\"'") for k, sep, v in (l.partition(":") for l in m[1].split("\n")) if sep and re.match(r"[\w-]+\s*$", k)}
    flat = lambda v: "" if v is None else "/".join(map(str, v)) if isinstance(v, list) else ("true" if v else "false") if isinstance(v, bool) else str(v)
    return {str(k): flat(v) for k, v in fields.items()}, raw[m.end() :]


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``rel_path, raw, frontmatter, body`` of the ``.md`` and ``.markdown`` files below ``path``; dot files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").load(path)
    base = path.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", base)), "")
    raw = files.select(rel.alias("rel_path"), F.decode("content", "UTF-8").alias("raw")).where(~F.col("rel_path").rlike(r"(^|/)\."))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            parsed = [parse_frontmatter(x) for x in b["raw"]]
            yield pd.DataFrame({"rel_path": b["rel_path"], "raw": b["raw"], "frontmatter": [p[0] for p in parsed], "body": [p[1] for p in parsed]})

    return raw.mapInPandas(run, "rel_path string, raw string, frontmatter map<string,string>, body string")


def documents(files: DataFrame) -> DataFrame:
    """Documents of ``read_folder`` rows: metadata from the head, else from the path and the first heading.

    Of files with one source_id the first by path counts.
    """
    fm = lambda k: F.nullif(F.trim(F.col("frontmatter")[k]), F.lit(""))
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.(md|markdown)$", ""), "[-_]+", " ")
    heading = F.nullif(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*#*\s*$", 1), F.lit(""))
    folder = F.when(F.contains("rel_path", F.lit("/")), F.split_part("rel_path", F.lit("/"), F.lit(1))).otherwise("manually-curated")
    rows = files.select(
        F.coalesce(fm("source_id"), F.col("rel_path")).alias("source_id"),
        F.coalesce(fm("source_type"), folder).alias("source_type"),
        F.coalesce(fm("kind"), F.lit("doc")).alias("kind"),
        F.coalesce(fm("title"), heading, name).alias("title"),
        fm("source_url").alias("source_url"),
        F.coalesce(fm("authority"), F.lit("unknown")).alias("authority"),
        F.coalesce(fm("lang"), F.lit("und")).alias("lang"),
        F.substring(fm("last_modified"), 1, 10).alias("last_modified"),
        content_hash(F.col("raw")).alias("content_hash"),
        "rel_path", "body", "frontmatter",
    )
    cols = [c for c in rows.columns if c != "source_id"]
    return rows.groupBy("source_id").agg(F.min_by(F.struct(*cols), "rel_path").alias("r")).select("source_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def render(docs: DataFrame) -> DataFrame:
    """``rel_path, text`` of documents as files: head in a fixed order, empty fields left out, a title heading."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    present = [c for c in FIELDS if c in docs.columns]
    lines = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), quoted(c))) for c in present]
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")
    titled = F.when(body.rlike(r"^#\s"), body).otherwise(F.concat(F.lit("# "), F.coalesce("title", F.lit("untitled")), F.lit("\n\n"), body))
    return docs.select("rel_path", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), titled, F.lit("\n")).alias("text"))
