"""Whole documents: status, authority, sections, lookup by a loose id, bundles."""

from __future__ import annotations

import io
import json
import re
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .chunking import heading_words

_STATUS_HEADING = r"(?im)^#{1,6}\s*(?:\d+[.)]?\s*)?(?:status|stato)\b[^\n]*\n+(?:[ \t]*\n)*([^\n]+)"
_STATUS_INLINE = r"(?im)^[ \t]*(?:[-*][ \t]+)?\|?[ \t]*(?:\*\*|__)?(?:status|stato)(?:\*\*|__)?[ \t]*(?:[:：|—–-][ \t]*)+(?:\*\*|__)?([^\n|]+)"
_RECORD = r"(?im)^#{1,6}\s*(?:\d+[.)]?\s*)?(?:decision|decisione|context|contesto|status|stato)\b"


def _worded(raw: Column) -> Column:
    s = F.regexp_replace(raw, r"[*_`>#|]", " ")
    s = F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, 120)


def _status_of(raw: Column) -> Column:
    low = F.lower(_worded(raw))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(V.DECISION_STATUS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return F.when(low != "", out)


def decision_status(body: Column, stated: Column) -> Column:
    """The status a decision record states: in its head, under a heading, or in a line; the first that can be read."""
    return F.coalesce(_status_of(stated), _status_of(F.regexp_extract(body, _STATUS_HEADING, 1)), _status_of(F.regexp_extract(body, _STATUS_INLINE, 1)))


def effective_authority(authority: Column, body: Column, stated: Column) -> Column:
    """``binding`` holds for decisions in force, or without a status for what reads like a decision; else ``descriptive``."""
    status = decision_status(body, stated)
    holds = F.when(status.isNotNull(), status == "accepted").otherwise(body.rlike(_RECORD))
    return F.when((authority == "binding") & ~F.coalesce(holds, F.lit(False)), "descriptive").otherwise(authority)


@dataclass(frozen=True)
class Heading:
    level: int
    text: str
    line: int


def outline_of(lines: list[str]) -> list[Heading]:
    out, fence = [], None
    for i, line in enumerate(lines):
        if m := re.match(r"\s{0,3}(`{3,}|~{3,})", line):
            fence = m[1] if fence is None else None if line.lstrip().startswith(fence) else fence
        elif fence is None and (m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)):
            out.append(Heading(len(m[1]), heading_words(m[2]), i))
    return out


def _plain(s: str) -> str:
    return re.sub(r"[^a-z0-9]", "", s.lower())


def section(body: str, wanted: str) -> tuple[str, str, list[str]] | None:
    """(text, heading, other headings that fit) of one section: to the next heading of its level or above.

    ``wanted`` is a heading or a path ``A > B``.  Equal headings come before those that contain it, then those it
    contains (four letters or more).
    """
    lines = body.split("\n")
    headings = outline_of(lines)
    end = lambda h: next((n.line for n in headings if n.line > h.line and n.level <= h.level), len(lines))

    def fitting(pool: list[Heading], want: str) -> list[Heading]:
        tests = (lambda t: t == want, lambda t: want in t, lambda t: t in want and len(t) > 3)
        return next((hit for test in tests if (hit := [h for h in pool if test(_plain(h.text))])), [])

    found: list[Heading] = []
    parts = [p for p in map(_plain, re.split(r"\s*[>›]\s*", wanted)) if p]
    if len(parts) > 1:
        pool = headings
        for part in parts:
            found = fitting(pool, part)
            if not found:
                break
            pool = [h for h in headings if found[0].line < h.line < end(found[0])]
    if not found and _plain(wanted):
        found = fitting(headings, _plain(wanted))
    if not found:
        return None
    h = found[0]
    return "\n".join(lines[h.line : end(h)]).strip(), h.text, [x.text for x in found[1:6]]


def fetch(body: str, wanted: str | None = None, offset: int = 0, most: int = 20_000) -> dict:
    """A part of a document that fits: from the line an offset falls in, cut at a line, with where to go on."""
    picked = section(body, wanted) if wanted else None
    text = picked[0] if picked else body
    at = max(0, min(offset, len(text)))
    if at and text[at - 1] != "\n":
        at = text.rfind("\n", 0, at) + 1
    part = text[at : at + most]
    if at + most < len(text):
        cut = part.rfind("\n")
        part = part[:cut] if cut > most * 0.5 else part
    end = at + len(part)
    while end < len(text) and text[end].isspace():
        end += 1
    return {"text": part, "section": picked[1] if picked else None, "others": picked[2] if picked else [], "offset": at, "next": end if end < len(text) else None}


def outline_rows(headings: DataFrame) -> DataFrame:
    """Headings of levels 2 to 4 of each document; of documents with more than 120, levels 2 and 3."""
    useful = headings.where(F.col("level").between(2, 4))
    many = F.count("*").over(W.partitionBy("source_id")) > 120
    return useful.withColumn("_m", many).where(~F.col("_m") | (F.col("level") <= 3)).drop("_m")


def resolve_ids(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``q, source_id``: documents by a loose id: the id or the path, with or without ``.md``, letters and digits alone.

    Of documents with the same handle the last by id wins.
    """
    handle = T.normalised_id
    names = F.array(F.col("source_id"), F.coalesce("rel_path", F.col("source_id")), F.regexp_replace(F.coalesce("rel_path", F.col("source_id")), r"\.md$", ""))
    known = docs.select("source_id", F.explode(names).alias("n")).select("source_id", handle(F.col("n")).alias("h")).where(F.col("h") != "").groupBy("h").agg(F.max("source_id").alias("source_id"))
    return asked.select("q", handle(F.col("q")).alias("h")).join(known, "h").select("q", "source_id")


def suggest_ids(asked: DataFrame, docs: DataFrame, most: int = 5) -> DataFrame:
    """``q, source_id, rank``: documents whose handle contains the last 24 letters of what was asked, four at least.

    Requests are few; they go out once.
    """
    a = asked.select("q", F.substring(T.normalised_id(F.col("q")), -24, 24).alias("tail")).where(F.length("tail") >= 4)
    hit = docs.select("source_id", T.normalised_id(F.col("source_id")).alias("h")).join(F.broadcast(a), F.contains("h", F.col("tail")))
    return hit.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("source_id"))).where(F.col("rank") <= most).select("q", "source_id", "rank")


def bundle_documents(citations: DataFrame, most: int = 100) -> DataFrame:
    """``source_id, first, numbers, passages, place``: cited passages by document, in order of their first number, at most ``most``."""
    g = citations.groupBy("source_id").agg(F.min("n").alias("first"), F.sort_array(F.collect_set("n")).alias("numbers"), F.count("*").alias("passages"))
    return g.orderBy("first").limit(most).withColumn("place", F.row_number().over(W.orderBy("first")))


def zip_bundle(question: str, answer: str, files: list[tuple[str, str]], manifest: dict) -> bytes:
    """A zip of an answer with its sources: question and answer, manifest, one file for each source."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("README.md", f"# {question}\n\n{answer}\n")
        z.writestr("manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2))
        for name, text in files:
            z.writestr(f"sources/{re.sub(r'[^A-Za-z0-9._-]+', '-', name).strip('-') or 'source'}", text)
    return out.getvalue()


def judge_verdict(text: str) -> dict | None:
    """The first balanced JSON object of a judge's answer, scores held to 0, 1 and 2; None when there is none."""
    start = text.find("{")
    depth = 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            try:
                found = json.loads(text[start : i + 1])
            except ValueError:
                return None
            number = lambda v: max(0, min(2, round(float(v)))) if isinstance(v, (int, float)) or (isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?", v)) else 0
            return {"correctness": number(found.get("correctness")), "grounded": number(found.get("grounded")), "abstained": found.get("abstained") in (True, "true"), "rationale": found["rationale"] if isinstance(found.get("rationale"), str) else ""}
    return None


def search_index_pages(index: DataFrame) -> DataFrame:
    """``path`` of the pages in a docs search index (``location``), without fragments, each once."""
    base = F.split_part("location", F.lit("#"), F.lit(1))
    path = F.when(base == "", "index.html").when(base.endswith("/"), F.concat(base, F.lit("index.html"))).when(base.endswith(".html"), base).otherwise(F.concat(base, F.lit("/index.html")))
    return index.select(path.alias("path")).where(~F.col("path").rlike(r"^(assets|search)/|(^|/)404\.html$")).distinct()


def context_rows(rows: DataFrame) -> DataFrame:
    """A passage as it is cited: heading, address and the first 600 characters."""
    body = F.when(F.length("content") > 600, F.concat(F.substring("content", 1, 600), F.lit("…"))).otherwise(F.col("content"))
    dated = F.when(F.coalesce("last_modified", F.lit("")) != "", F.concat(F.lit(" (as of "), F.col("last_modified"), F.lit(")")))
    return rows.select("id", F.concat(F.concat_ws(" — ", "heading_path", F.nullif("source_url", F.lit(""))), F.coalesce(dated, F.lit("")), F.lit("\n"), body).alias("block"))
