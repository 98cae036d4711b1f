"""Small expressions over paths, addresses, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import wildcard_regex

#: Words too general to search a wiki for a repository.
GENERIC_TERMS = (
    "api apis app apps web core common lib libs library service services frontend backend platform docs doc documentation demo test tests tools utils util sdk cli ui client server infra infrastructure "
    "config configuration template templates example examples training playground archive archived deprecated legacy old new main master monorepo repo repository project"
).split()
#: Ids and titles of decision records.
DECISION_ID = r"(?i)(?:^|[/:_-])adrs?(?:[/_.-]|\d|$)"
DECISION_TITLE = r"(?i)\badr[- _]?\d"
#: Fixed value: words by which a question shows that it is Italian.
ITALIAN_QUESTION = r"(?i)(^|[^\p{L}])(quali|quale|come|cosa|perch[eé]|dove|quando|sono|della|delle|degli|nel|nella|posso|deve|devono|possibile|funziona|utilizzare|usare)($|[^\p{L}])"


def search_terms(candidates: Column) -> Column:
    """Terms worth searching for: four characters or more, no general words, each once whatever its case."""
    plain = F.transform(candidates, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r'["\\]', " "), r"\s+", " ")))
    kept = F.filter(plain, lambda t: (F.length(t) >= 4) & ~F.lower(t).isin(GENERIC_TERMS))
    return F.filter(kept, lambda t, i: F.array_position(F.transform(kept, lambda x: F.lower(x)), F.lower(t)) == i + 1)


def guess_language(question: Column) -> Column:
    return F.when(question.rlike(ITALIAN_QUESTION), "it").otherwise("en")


def date_prefix(text: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``; a time of day is cut off, anything else is null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(\d{4}(?:-\d{2}(?:-\d{2})?)?)(?:$|T)", 1), F.lit(""))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_timestamp(F.to_date(F.substring(a, 1, 10))) - F.unix_timestamp(F.to_date(F.substring(b, 1, 10)))) / 86400


def duration(ms: Column) -> Column:
    """``1h 04m``, ``3m 20s``, ``45s``; ``?`` for what is no duration."""
    total = F.round(ms / 1000).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(ms.isNull() | (ms < 0), "?")
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(s), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def path_group(path: Column) -> Column:
    """The folder that a file counts under: three levels in repositories, two in wikis, one elsewhere."""
    parts = F.split(path, "/")
    depth = F.when(parts[0] == "gitlab", 3).when(parts[0] == "confluence", 2).otherwise(1)
    return F.array_join(F.slice(parts, F.lit(1), F.least(depth, F.greatest(F.size(parts) - 1, F.lit(1)))), "/")


def repository_of(location: Column, host: str | None = None) -> Column:
    """``group/project`` of a catalog location (``url:https://host/group/project/-/tree/…``), lower case; null elsewhere."""
    raw = F.trim(F.regexp_replace(location, "^url:", ""))
    its = F.lower(F.regexp_extract(raw, r"^https?://([^/?#]+)", 1))
    p = F.regexp_replace(F.regexp_extract(raw, r"^https?://[^/?#]+/+([^?#]*)", 1), r"/(?:-|blob|tree|raw|commits)(?:/.*)?$", "")
    p = F.lower(F.regexp_replace(F.regexp_replace(p, r"\.git$", ""), "/+$", ""))
    ok = (its != "") & F.contains(p, F.lit("/"))
    return F.when(ok if host is None else ok & (its == host.lower()), p)


def build_day(stamp: Column) -> Column:
    """The day of a build time in seconds or milliseconds; null for none."""
    seconds = F.when(stamp > 1e12, stamp / 1000).otherwise(stamp)
    return F.when(stamp > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def page_path(file: Column) -> Column:
    """``a/b/index.html`` reads ``a/b/``, ``a/b.html`` too; the root's index reads empty."""
    return F.when(file == "index.html", "").when(file.endswith("/index.html"), F.regexp_replace(file, "index\\.html$", "")).otherwise(F.concat(F.regexp_replace(file, r"\.html$", ""), F.lit("/")))


def definition_kind(text: Column) -> Column:
    """``openapi``, ``asyncapi`` or ``swagger`` by the head of a file; null for other files."""
    return F.nullif(F.regexp_extract(F.substring(text, 1, 4096), r"(?m)^\s*\{?\s*[\"']?(openapi|asyncapi|swagger)[\"']?\s*:\s*[\"']?\d", 1), F.lit(""))


def cut_definition(text: Column, most: int) -> Column:
    """A definition cut at ``most`` characters, with a last line that says so and names the whole length."""
    note = F.concat(F.lit("\n[truncated: "), F.length(text).cast("string"), F.lit(" characters]"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), note)).otherwise(text)


def token_usage(texts: Column) -> Column:
    """Tokens of a list of texts, at four characters each."""
    return F.ceil(F.aggregate(texts, F.lit(0).cast("long"), lambda acc, t: acc + F.coalesce(F.length(t), F.lit(0))) / 4)


def round3(x: Column) -> Column:
    """To three decimals, halves upwards."""
    return F.floor(x * 1000 + 0.5) / 1000


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within the bounds; null and NaN become the lower one."""
    return F.least(F.greatest(F.when(F.isnan(x.cast("double")), None).otherwise(x), F.lit(low)), F.lit(high))


def as_int(x: Column, default: int, low: int, high: int) -> Column:
    """A whole number within the bounds from a number or text, rounded down; the default where there is none."""
    n = F.floor(x.cast("string").try_cast("double"))
    return F.when(n.isNull() | F.isnan(n.cast("double")), default).otherwise(F.least(F.greatest(n, F.lit(low)), F.lit(high))).cast("long")


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``12.5%``; a dash where the whole is 0."""
    return F.when(whole == 0, "–").otherwise(F.concat(F.format_string(f"%.{digits}f", F.round(part * F.lit(100.0) / whole, digits)), F.lit("%")))


def entity_ref(namespace: Column, kind: Column, name: Column) -> Column:
    """``ns/kind/name``: namespace (``default`` when missing) and kind in lower case, the name as it is."""
    return F.concat_ws("/", F.lower(F.coalesce(F.nullif(F.trim(namespace), F.lit("")), F.lit("default"))), F.lower(kind), name)


def entity_excluded(ref: Column, patterns: list[str]) -> Column:
    """Whether wildcards name an entity, as ``kind/name`` or ``ns/kind/name``."""
    short = F.regexp_replace(ref, "^[^/]+/", "")
    out = F.lit(False)
    for p in patterns:
        out = out | ref.rlike(wildcard_regex(p)) | short.rlike(wildcard_regex(p))
    return out


def is_decision(source_id: Column, source_type: Column, title: Column) -> Column:
    """Whether an id, a source or a title is that of a decision record."""
    return F.coalesce((source_type == "adr") | source_id.rlike(DECISION_ID) | title.rlike(DECISION_TITLE), F.lit(False))


def demote_headings(text: Column) -> Column:
    """Every heading one level deeper; the sixth stays."""
    return F.regexp_replace(text, r"(?m)^(#{1,5})(?=[ \t])", "$1#")


def first_heading(text: Column) -> Column:
    """The words of the first heading of level 1, else null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)), F.lit(""))


def with_title(text: Column, title: Column) -> Column:
    """A body that begins with a heading of level 1: its own, or one put before it."""
    return F.when(first_heading(text).isNotNull(), text).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), text))


def query_text(question: Column, instruction: str) -> Column:
    """What is embedded for a question: documents are embedded as they are, questions after an instruction."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), question) if instruction else question


def highlighted(text: Column, question: Column) -> Column:
    """``text`` with the words of ``question`` (two characters or more) between asterisks, the longest first."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    longest = F.array_sort(found, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(F.size(found) > 0, F.regexp_replace(text, F.concat(F.lit("(?iu)("), F.array_join(longest, "|"), F.lit(")")), F.lit("**$1**"))).otherwise(text)


def search_clause(field: str, values: list[str]) -> str:
    """``field in ("a","b")`` of a wiki's query language, quotes escaped; empty for no values."""
    quoted = ",".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values)
    return f"{field} in ({quoted})" if values else ""
