"""Problem 2: source files that nobody wrote by hand for their project.

Method: an Aho-Corasick automaton finds generation notices, warnings not to edit and
third-party notices in file headers, and path rules add vendored folders, generated-name suffixes and
minified names.  But for names that only tools give (lockfiles, protocol
compilers), a path alone never condemns a file: it must also lack a declaration
that it belongs to one of the collection's own projects.  Two
things the notices cannot show are added after them: bodies made of one line
pattern (templates, data, dense code) and bodies that occur in several
projects (copies of a library whose notice was cut off).

Everything is a sum over chunks, so a file of any size needs no single task
that holds it: each chunk yields counts and an order-free line fingerprint,
and Spark adds them up by file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases by which tools mark what they wrote.  They begin a header comment, say it of "this file", or stand by a warning.
GENERATED_NOTICES = (
    "@generated",
    "<auto-generated",
    "auto-generated file",
    "auto generated file",
    "autogenerated",
    "automatically generated",
    "code generated by",
    "created by",
    "diese datei wurde automatisch",
    "diese datei wurde maschinell",
    "file generato automaticamente",
    "fichier généré automatiquement",
    "archivo generado automáticamente",
    "generated by",
    "generated from",
    "machine generated",
    "machine-generated",
    "machine-written",
    "made by",
    "output of",
    "produced by",
    "this file is generated",
    "this file was automatically",
    "this file was generated",
    "this is an automatically generated",
    "this is a generated file",
)
#: Of these, the phrases that people use too, so that they need a warning in the same header.
WEAK_NOTICES = ("created by", "made by", "output of", "produced by")
#: Warnings that what is written here will not last.
EDIT_WARNINGS = (
    "be overwritten",
    "changes will be lost",
    "do not change",
    "do not edit",
    "do not modify",
    "don't edit",
    "don't modify",
    "edit the source",
    "edit the template",
    "get overwritten",
    "ne pas modifier",
    "nicht bearbeiten",
    "nicht ändern",
    "no editar",
    "no modificar",
    "non modificare",
    "regenerate",
)
#: Marks of a foreign package's header.
FOREIGN_NOTICES = ("authors |", " contributors", ", release ", "homepage: http", "@license", "@preserve", "/*! ")
#: Folders that hold foreign code when a package folder follows or they hold files themselves.
VENDORED_FOLDERS = ("vendor", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "pods", "external", "deps", "site-packages", "vendored")
#: Names that only tools give: lockfiles and what protocol compilers and form designers write.
TOOL_NAME = r"(?i)(\.pb\.(go|cc|h)|\.pb\.gw\.go|_grpc\.pb\.go|_pb2(_grpc)?\.pyi?|\.designer\.cs|/zz_generated[^/]*|/(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|deno\.lock|poetry\.lock|uv\.lock|pdm\.lock|pipfile\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock|pubspec\.lock|mix\.lock|packages\.lock\.json|podfile\.lock|package\.resolved|flake\.lock|gradle\.lockfile))$"
#: Names that tools give their output and people rarely theirs.
GENERATED_NAME = r"(?i)(\.min\.(js|css)|\.bundle\.js|[.-][0-9a-f]{8,}\.(js|css)|\.g\.(dart|cs)|\.freezed\.dart|\.generated\.\w+|[._-]gen\.(go|ts|py|rs)|_generated\.(go|ts|py|rs|rb))$"

MIN_BODY_LINES = 5

_COMMENT = re.compile(r"^\s*(//+|/\*+|\*+|#+|--+|<!--|;+|%+)\s?")
#: What opens a comment of several lines, and what closes it.
_OPENS = re.compile(r"(?:[rRuU]?(?=[\"']))?(/\*|<!--|\"\"\"|''')(?:(?<=/\*)(?:\*+(?!/)|!))?")
_CLOSES = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_SIGN = re.compile(r"\s*(?:\*+|(?://+|#+|--+|;+|%+)(?=\s|$))?")
#: Lines that may stand above a header comment.
_PROLOGUE = re.compile(r"""(?i)<\?(?:php\b|xml\b[^>]*\?>)|<!doctype\b[^>]*>|["']use strict["'];?|@charset\s+["'][^"']*["'];?|\ufeff""")
_NAMESPACE = (
    re.compile(r"^package\s+(?:[\w-]+\.)*([\w-]+)\s*;?$"),
    re.compile(r"^from\s+([\w-]+)\.[\w.]+\s+import\b"),
    re.compile(r"^import\b.*\bfrom\s+[\"'](?:\.\./)+([\w-]+)[\"'/]"),
    re.compile(r"^set\s+search_path\s+to\s+\"?([\w-]+)", re.I),
)
#: A line of literals.  Atomic throughout: a long run of digits has one reading, not one for each way to cut it.
_DATA_LINE = re.compile(r"""^[\[{(]?\s*+(?>(?>"[^"]*+"|'[^']*+'|[-+]?(?:0x[0-9a-f]++|\d[\d_.]*+(?:e[-+]?\d++)?+)|true|false|null|none|\[[^\]]*+\]|\{[^}]*+\})\s*+[:,]?+\s*+){2,}+[\]})]*+[,;]?$""", re.I)
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{80,}")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d+")


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("generated", GENERATED_NOTICES), ("warning", EDIT_WARNINGS), ("foreign", FOREIGN_NOTICES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def unfenced(content: str) -> list[str]:
    """The lines of a chunk without the code fence that chunking put around them."""
    lines = content.split("\n")
    if lines and lines[0].lstrip().startswith("```"):
        lines = lines[1:]
    if lines and lines[-1].strip() == "```":
        lines = lines[:-1]
    return lines


def header_comments(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """(text, whether it begins something) of each comment line above the first code line, without the comment signs.

    Block comments and docstrings go on until they close.  A line of running text in them begins something unless
    it goes on with the sentence of the line before.
    """
    closing, going_on = "", False
    for line in lines:
        text = line.strip()
        if closing and not text:
            going_on = False
        while text:
            if closing:
                inner, shut, text = text.partition(closing)
                signed = _SIGN.match(inner)
                inner = inner[signed.end() :].strip()
                if inner:
                    yield inner, bool(signed[0].strip()) or not (going_on and inner[0].islower())
                going_on = bool(inner) and inner[-1] not in ".!?:"
                if shut:
                    closing = ""
                text = text.strip()
            elif m := _OPENS.match(text):
                closing, going_on = _CLOSES[m[1]], False
                text = text[m.end() :]
                if m[0].endswith("!"):
                    yield "/*!" + text.partition(closing)[0], True
                text = text.strip()
            elif m := _COMMENT.match(text):
                yield text[m.end() :].strip(), True
                text = ""
            elif m := _PROLOGUE.match(text):
                text = text[m.end() :].strip()
            else:
                return


#: What may stand before a notice that is about the file itself: a warning word, "this file is", "file", or the name of a kind of file.
_SUBJECT = re.compile(
    r"\W*(?:(?:warning|note|notice|attention|caution|important|achtung|attenzione)\b\W*)*"
    r"(?:(?:this|the following)\s+(?:\w+\s+){0,2}?(?:file|code|source|module|script|document|header|class|package)?\s*(?:is|are|was|were|has been|have been)?|file)?"
    r"\s*(?:(?:an?\s+(?:[\w-]+\s+){0,3})?(?:automatically|mechanically|entirely)?)\s*"
)
_KIND_OF_FILE = re.compile(r"\W*an?\s+(?:[\w-]+\s+){1,4}")


def header_marks(lines: list[str]) -> tuple[bool, bool]:
    """(generated, foreign) by the notices in the comments above the first code line.

    A notice says of this file that a tool wrote it: the phrase begins a comment, its subject is the file, or a warning not
    to edit stands in the same header.  What people also say of their own work needs that warning.
    """
    generated = foreign = warned = said = False
    for text, begins in header_comments(lines):
        low = text.lower()
        for end, (kind, n) in _automaton().iter(low):
            start = end - n + 1
            phrase = low[start : end + 1]
            if kind == "foreign":
                foreign = foreign or _is_foreign(low, start)
            elif kind == "warning":
                warned = True
            elif not re.search(r"\b(?:not|never|isn't)\s+(?:\w+\s+)?$", low[:start]):
                said = True
                if begins and phrase not in WEAK_NOTICES:
                    generated = generated or bool(_SUBJECT.fullmatch(low[:start])) or (phrase == "generated by" and bool(_KIND_OF_FILE.fullmatch(low[:start])))
    return generated or (said and warned), foreign


def _is_foreign(low: str, start: int) -> bool:
    """A package notice names its package, with a version, a year or its own page."""
    if low.startswith(("homepage: http", "@license", "@preserve", "/*! "), start):
        return True
    return bool(re.search(r"\bv?\d+\.\d+|\b(19|20)\d\d\b", low))


def namespace(lines: list[str]) -> str:
    """The project a file says it belongs to: package clause, project import or search path; '' when none."""
    for line in lines:
        text = line.strip()
        for pattern in _NAMESPACE:
            if m := pattern.match(text):
                return m[1].replace("_", "-").lower()
    return ""


def chunk_features(content: str | None) -> tuple:
    """Counts of one chunk.  Null and empty content count nothing."""
    if not content:
        return (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, False, False, "")
    lines = unfenced(content)
    code = [s for x in lines if (s := " ".join(x.split())) and not _COMMENT.match(s)]
    body = [s for s in code if not any(p.match(s) for p in _NAMESPACE)]
    n_chars = sum(map(len, code))
    shapes = [_NUMBER.sub("0", _WORD.sub("a", s)) for s in code]
    shapes = [re.sub(r"(?:a|0|_)+", "a", x) for x in shapes]
    often = Counter(shapes)
    digits = sum(1 for s in code if _NUMBER.search(s))
    repeated = sum(n for shape, n in often.items() if n >= 3 and len(shape) > 3)
    data = sum(1 for s in code if _DATA_LINE.match(s) or s.lower().startswith("insert into "))
    dense = sum(len(s) for s in code if len(s) >= 90 and s.count(" ") < len(s) * 0.1 and sum(map(s.count, ";{}()=,")) > len(s) * 0.1)
    blob = sum(len(m) for s in code for m in _BLOB.findall(s))
    low = high = 0
    for s in body:
        h = xxhash.xxh64_intdigest(s)
        low += h & 0x7FFFFFFF
        high += (h >> 31) & 0x7FFFFFFF
    generated, foreign = header_marks(lines)
    return (len(code), n_chars, repeated, digits, data, dense, blob, len(body), low, high, generated, foreign, namespace(lines))


_FEATURES = ("n_code", "n_chars", "n_repeated", "n_digits", "n_data", "dense_chars", "blob_chars", "n_body", "fp_low", "fp_high", "generated", "foreign", "namespace")
_SCHEMA = "source_id string, id string, rel_path string, ordinal int, n_code long, n_chars long, n_repeated long, n_digits long, n_data long, dense_chars long, blob_chars long, n_body long, fp_low long, fp_high long, generated boolean, foreign boolean, namespace string"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = pd.DataFrame([chunk_features(c) for c in b["content"]], columns=list(_FEATURES), index=b.index)
        yield pd.concat([b[["source_id", "id", "rel_path", "ordinal"]], out], axis=1)


def file_profiles(chunks: DataFrame) -> DataFrame:
    """One row for each source file, with its summed counts.

    A file is every chunk of a ``source_id`` whose ``rel_path`` has a ``code/`` folder below the project.
    Repeated deliveries of an ``id`` count once.  Rows without source_id or rel_path are no source file.
    """
    code = chunks.where(F.col("source_id").isNotNull() & F.col("rel_path").rlike("^[^/]+/.+/code/.+")).select(
        "source_id",
        F.coalesce("id", F.concat_ws("::", "source_id", F.col("ordinal").cast("string"))).alias("id"),
        "rel_path",
        F.coalesce(F.col("ordinal"), F.lit(0)).cast("int").alias("ordinal"),
        "content",
    )
    feats = code.mapInPandas(_features, _SCHEMA)
    cols = ["rel_path", "ordinal", *_FEATURES]
    one = feats.groupBy("source_id", "id").agg(F.max(F.struct(*cols)).alias("f")).select("source_id", *[F.col(f"f.{c}").alias(c) for c in cols])
    sums = [F.sum(c).alias(c) for c in _FEATURES if c not in ("generated", "foreign", "namespace")]
    first = F.min(F.struct("ordinal", "generated", "foreign", "namespace", "rel_path")).alias("head")
    return one.groupBy("source_id").agg(first, *sums).select("source_id", F.col("head.rel_path").alias("rel_path"), F.col("head.generated").alias("generated"), F.col("head.foreign").alias("foreign"), F.col("head.namespace").alias("namespace"), *[c for c in _FEATURES if c not in ("generated", "foreign", "namespace")])


def classify_source_files(chunks: DataFrame) -> DataFrame:
    """``source_id, reason`` for every source file; ``reason`` is null for hand-written ones.

    Reasons, the first that holds: ``generated`` (notice, or a generated name, or one repeated line pattern),
    ``data`` (literals only), ``minified``, ``third_party`` (notice, vendored folder, or the same body in
    another project while it declares none of the collection's projects).  Null contents count as empty;
    an empty file has no reason unless its path gives one.
    """
    p = F.regexp_extract("rel_path", r"^(.+?)/code/", 1)
    inner = F.concat(F.lit("/"), F.regexp_replace("rel_path", r"^.+?/code/", ""))
    files = file_profiles(chunks).withColumns({"project": p, "inner": inner})
    own = files.select(F.lower(F.regexp_replace(F.regexp_extract("project", r"([^/]+)$", 1), "_", "-")).alias("own_name")).distinct()
    files = files.join(own, files["namespace"] == own["own_name"], "left").withColumn("declared", F.col("own_name").isNotNull()).drop("own_name")

    vendored = F.lower("inner").rlike(rf"/({'|'.join(VENDORED_FOLDERS)})/")
    n = F.greatest(F.col("n_code"), F.lit(1))
    files = files.withColumns(
        {
            "third_party": F.col("foreign") | (vendored & ~F.col("declared")),
            "data": ((F.col("n_code") >= 4) & (F.col("n_data") / n >= 0.7)) | ((F.col("n_chars") > 300) & (F.col("blob_chars") / F.greatest(F.col("n_chars"), F.lit(1)) >= 0.6)),
            "minified": ~F.col("declared") & (F.col("n_chars") > 300) & (F.col("dense_chars") / F.greatest(F.col("n_chars"), F.lit(1)) >= 0.6),
            "templated": ~F.col("declared") & (F.col("n_code") >= 5) & (F.col("n_repeated") / n >= 0.5) & (F.col("n_digits") / n >= 0.25),
            "named": F.col("inner").rlike(TOOL_NAME) | (~F.col("declared") & F.col("inner").rlike(GENERATED_NAME)),
            "body": F.struct("n_body", "fp_low", "fp_high"),
        }
    )
    # A body is foreign for every copy when two projects hold it and none of the copies declares a project.
    bodies = (
        files.where(F.col("n_body") >= MIN_BODY_LINES)
        .groupBy("body", "project").agg(F.max("declared").alias("declared"), F.max("third_party").alias("marked"), F.count("*").alias("files"))
        .groupBy("body").agg(F.count("*").alias("projects"), F.max("declared").alias("any_declared"), F.max("marked").alias("any_marked"), F.sum("files").alias("files"))
        .where((F.col("files") > 1) & (F.col("any_marked") | ((F.col("projects") > 1) & ~F.col("any_declared"))))
        .select(F.col("body").alias("copied"))
    )
    # Shorter bodies are never compared: they get keys that spread them and meet nothing.
    lone = F.struct(F.lit(-1).cast("long").alias("n_body"), F.xxhash64("source_id").alias("fp_low"), F.lit(0).cast("long").alias("fp_high"))
    files = files.withColumn("key", F.when(F.col("n_body") >= MIN_BODY_LINES, F.col("body")).otherwise(lone))
    files = files.join(bodies, F.col("key") == F.col("copied"), "left")
    copied = F.col("copied").isNotNull() & ~F.col("declared")
    reason = (
        F.when(F.col("generated"), "generated")
        .when(F.col("data"), "data")
        .when(F.col("minified"), "minified")
        .when(F.col("third_party") | copied, "third_party")
        .when(F.col("named") | F.col("templated"), "generated")
    )
    return files.select("source_id", "rel_path", reason.alias("reason"), "declared", "n_code", "n_repeated", "n_digits", "n_data", "dense_chars", "n_chars")


def p2_found(chunks: DataFrame) -> DataFrame:
    return classify_source_files(chunks).where(F.col("reason").isNotNull()).select("source_id")
