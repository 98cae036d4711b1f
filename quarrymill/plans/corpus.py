"""Queries: texts, filters, duplicates, quality and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.patterns import glob_regex, wildcard_regex
from ..operators import answers, chunking, dedupe, documents, evaluate, hierarchy, incremental, links, quality
from ..operators.filters import Filters, predicate
from . import data
from .sql import CHUNKS, PAGES, fold, q

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- filters and facets


@query(f"WITH {CHUNKS} SELECT id FROM ch WHERE source_type IN ('gitlab', 'confluence') AND authority IN ('binding', 'normative')")
def filter_in_lists(spark: SparkSession, d: str) -> DataFrame:
    return data.chunks(spark, d, "source_type", "authority").where(predicate(Filters(source_type=["gitlab", "confluence"], authority=["binding", "normative"]))).select("id")


@query(f"WITH {CHUNKS} SELECT id FROM ch WHERE coalesce(last_modified, '') <> '' AND last_modified >= '2025-03' AND last_modified < '2026' AND NOT coalesce(source_type = 'devportal' AND kind = 'doc', true)")
def filter_date_prefix(spark: SparkSession, d: str) -> DataFrame:
    return data.chunks(spark, d, "source_type", "kind", "last_modified").where(predicate(Filters(after="2025-03", before="2026"))).select("id")


@query(f"WITH {CHUNKS} SELECT id FROM ch WHERE contains(lower(text), 'e_') OR contains(lower(text), '0%')")
def filter_contains_literal(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "text")
    return ch.where(predicate(Filters(contains="E_")) | predicate(Filters(contains="0%"))).select("id")


@query(
    f"""WITH {CHUNKS}, f AS (SELECT source_type, lower(kind) AS kind, authority, lang, grouping(source_type) AS a, grouping(lower(kind)) AS b, grouping(authority) AS c, grouping(lang) AS d, count(*) AS n
    FROM ch GROUP BY GROUPING SETS ((source_type), (lower(kind)), (authority), (lang)))
    SELECT CASE WHEN a = 0 THEN 'source_type' WHEN b = 0 THEN 'kind' WHEN c = 0 THEN 'authority' ELSE 'lang' END AS facet, coalesce(source_type, kind, authority, lang, '(none)') AS value, n FROM f"""
)
def facets(spark: SparkSession, d: str) -> DataFrame:
    names = ["source_type", "kind", "authority", "lang"]
    ch = data.chunks(spark, d, *names).withColumn("kind", F.lower("kind"))
    sets = ch.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.count("*").alias("n"), *[F.grouping(n).alias(f"_{n}") for n in names])
    facet = F.lit("lang")
    for n in names[:3]:
        facet = F.when(F.col(f"_{n}") == 0, n).otherwise(facet)
    return sets.select(facet.alias("facet"), F.coalesce(*names, F.lit("(none)")).alias("value"), "n")


# ---- text functions


@query(f"WITH {CHUNKS} SELECT lower(kind) = 'code' AS is_code, count(*) AS n, sum(t)::BIGINT AS tokens, max(t)::BIGINT AS most, round(avg(t), 4) AS average FROM (SELECT kind, ceil((length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]'))) / CASE WHEN lower(kind) = 'code' THEN 3.2e0 ELSE 3.5e0 END) AS t FROM ch) GROUP BY 1")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    code = F.lower("kind") == "code"
    t = data.chunks(spark, d, "text", "kind").select(code.alias("is_code"), T.estimate_tokens(F.col("text"), F.coalesce(code, F.lit(False))).alias("t"))
    return t.groupBy("is_code").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.max("t").alias("most"), F.round(F.avg("t"), 4).alias("average"))


_COUNT = lambda known: f"len(list_filter(regexp_split_to_array(s, '[^a-zàèéìòù'']+'), lambda w: list_contains([{', '.join(q(w) for w in known)}], w)))"


@query(
    f"""WITH c AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), 'https?://\\S+', ' ', 'g')) AS s FROM documents),
    n AS (SELECT doc_id, {_COUNT(V.ITALIAN_WORDS)} AS it, {_COUNT([w for w in V.ENGLISH_WORDS if w not in V.ITALIAN_WORDS])} AS en FROM c)
    SELECT doc_id, CASE WHEN it + en < 8 THEN 'und' WHEN it >= en * 1.5e0 THEN 'it' WHEN en >= it * 1.5e0 THEN 'en' ELSE 'und' END AS detected FROM n"""
)
def detect_lang(spark: SparkSession, d: str) -> DataFrame:
    return data.read(spark, d, "documents").select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@query(f"SELECT DISTINCT title, rtrim(left(regexp_replace(regexp_replace({fold('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-') AS slug FROM documents WHERE title IS NOT NULL")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return data.read(spark, d, "documents").where(F.col("title").isNotNull()).select("title", T.slugify(F.col("title")).alias("slug")).distinct()


@query(f"WITH {PAGES} SELECT source_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '\\\\_', '_', 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || chr(13) || ' ')) AS n FROM kb")
def clean_body_lengths(spark: SparkSession, d: str) -> DataFrame:
    return data.pages(spark, d, "body").select("source_id", F.length(T.clean_prose(F.col("body"))).cast("long").alias("n"))


def _redact_sql(x: str) -> str:
    for name, pattern in V.SECRET_RULES:
        x = f"regexp_replace({x}, {q(pattern)}, '[REDACTED:{name}]', 'g')"
    return x


@query(f"SELECT doc_id, md5({_redact_sql('text')}) AS redacted FROM documents WHERE text IS NOT NULL")
def redact_rules(spark: SparkSession, d: str) -> DataFrame:
    return data.read(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("redacted"))


@query(f"WITH {PAGES}, s AS (SELECT source_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS s FROM kb) SELECT source_id, CASE WHEN length(s) > 160 THEN rtrim(left(s, 159)) || '…' ELSE s END AS excerpt FROM s")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return data.pages(spark, d, "body").select("source_id", T.excerpt(F.col("body"), 160).alias("excerpt"))


@query(f"WITH {CHUNKS}, l AS (SELECT lower(list_last(string_split(rel_path, '/'))) AS name FROM ch WHERE rel_path IS NOT NULL) SELECT regexp_extract(name, '\\.([a-z0-9]+)$', 1) AS ext, count(*) AS n FROM l GROUP BY 1")
def path_extensions(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    return data.chunks(spark, d, "rel_path").where(F.col("rel_path").isNotNull()).groupBy(F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


_CLASSES = [("docs", ["**/docs/**", "**/*.md"], ["**/CHANGELOG*"]), ("api", ["**/api/**"], []), ("code", ["**/code/**/*.{e}".format(e=e) for e in ("ts", "py", "go", "kt", "sql")], ["**/fixtures/**"])]


def _class_sql() -> str:
    one = lambda gs: "(" + (" OR ".join(f"regexp_matches(rel_path, {q(glob_regex(g))})" for g in gs) or "false") + ")"
    return "CASE " + " ".join(f"WHEN {one(i)} AND NOT {one(e)} THEN '{n}'" for n, i, e in _CLASSES) + " END"


@query(f"WITH {CHUNKS} SELECT {_class_sql()} AS class, count(*) AS n FROM ch WHERE rel_path IS NOT NULL GROUP BY 1")
def path_class_globs(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify_paths(data.chunks(spark, d, "rel_path").where(F.col("rel_path").isNotNull()), "rel_path", _CLASSES).groupBy("class").agg(F.count("*").alias("n"))


@query(
    f"""WITH {CHUNKS}, t AS (SELECT source_id, string_agg(content, chr(10) ORDER BY ordinal) AS t FROM ch WHERE regexp_matches(rel_path, '/code/') GROUP BY source_id),
    s AS (SELECT source_id, t, length(t) - length(replace(t, chr(10), '')) + 1 AS lines FROM t)
    SELECT source_id, CASE WHEN trim(regexp_replace(t, '\\s+', ' ', 'g')) = '' THEN 'empty' WHEN regexp_matches(left(t, 2048), '(?i)@generated\\b|auto-?generated|automatically generated|do not edit|generated by|<auto-generated') THEN 'generated file'
        WHEN lines > 200 THEN 'too many lines' WHEN length(t) / lines > 300 THEN 'minified or data file' END AS reason FROM s"""
)
def code_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "rel_path", "source_id", "content").where(F.col("rel_path").rlike("/code/"))
    files = chunking.join_ordered(ch, "source_id", "ordinal", "content")
    return files.select("source_id", quality.code_skip_reason(F.col("content"), 200).alias("reason"))


_STUB = "(?s)```.*?```|~~~.*?~~~"


@query()
def prose_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts by line with open and closed fences: Python, so rows only here and brute force in the tests."""
    stats = quality.prose_stats(data.pages(spark, d, "body"), "source_id", "body")
    return stats.withColumn("stub", quality.is_stub(40))


@query(f"WITH {PAGES} SELECT source_id, {' OR '.join(f'regexp_matches(trim(coalesce(title, {q(str())})), {q(p)})' for p in V.GENERATED_TITLES)} OR {' OR '.join(f'regexp_matches(left(body, 3000), {q(p)}) OR regexp_matches(right(body, 1500), {q(p)})' for p in V.GENERATED_BODIES)} AS generated, {' OR '.join(f'regexp_matches(left(body, 4000), {q(p)})' for p in V.BOILERPLATE_READMES)} AS boilerplate FROM kb WHERE body IS NOT NULL")
def generated_pages(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "body").where(F.col("body").isNotNull())
    return kb.select("source_id", T.looks_generated(F.coalesce("title", F.lit("")), F.col("body")).alias("generated"), T.boilerplate_readme(F.col("body")).alias("boilerplate"))


# ---- duplicates

_KEY = "trim(regexp_replace(regexp_replace(lower(text), '(?s)<!--.*?-->', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"SELECT sha256(k) AS dup_key, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, {_KEY} AS k FROM documents WHERE text IS NOT NULL) WHERE length(k) >= 80 GROUP BY k HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_groups(data.read(spark, d, "documents"), "doc_id", "text")


@query(
    f"""WITH k AS (SELECT doc_id, lower(trim(source)) AS scope, fetched_at, {_KEY} AS k FROM documents WHERE text IS NOT NULL),
    f AS (SELECT scope, k, first_value(doc_id) OVER (PARTITION BY scope, k ORDER BY fetched_at NULLS FIRST, doc_id) AS kept_id, doc_id FROM k WHERE length(k) >= 80)
    SELECT doc_id, kept_id FROM f WHERE doc_id <> kept_id"""
)
def exact_dup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = data.read(spark, d, "documents").withColumn("scope", F.lower(F.trim("source")))
    return dedupe.first_wins(docs, "scope", "fetched_at", "text", "doc_id")


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM w),
    s AS (SELECT DISTINCT doc_id AS id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)::BIGINT), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM c WHERE doc_id = class_id AND len(w) >= 5),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) >= 20),
    p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.id < y.id WHERE x.id IN (SELECT id FROM n) AND y.id IN (SELECT id FROM n) GROUP BY 1, 2)
    SELECT a, b, shared, round(shared / least(x.n, y.n), 6) AS containment FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared >= least(x.n, y.n) * 0.8 - 1e-9"""
)
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links between different texts; equal texts are classes (``duplicate_membership``)."""
    return dedupe.near_duplicate_links(data.read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string({_WORDS}, ' ')) AS class_id, count(*) OVER (PARTITION BY array_to_string({_WORDS}, ' ')) AS class_size FROM documents")
def duplicate_membership(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_classes(data.read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


# ---- incremental runs


@query("SELECT DISTINCT source_id, 'sha256:' || sha256(body) AS content_hash FROM kb_documents WHERE body IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return data.read(spark, d, "kb_documents").where(F.col("body").isNotNull()).select("source_id", incremental.content_hash(F.col("body")).alias("content_hash")).distinct()


@query(f"WITH {PAGES} SELECT source_id, 'sha256:' || sha256(coalesce(kind, '') || chr(10) || chr(0) || coalesce(title, '') || chr(10) || chr(0) || '' || chr(10) || chr(0) || coalesce(frontmatter['project'], '') || chr(10) || chr(0) || coalesce(body, '')) AS embed_hash FROM kb")
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "kind", "body", "frontmatter")
    return kb.select("source_id", incremental.embed_hash(F.col("kind"), F.col("title"), F.lit(""), F.col("frontmatter")["project"], F.col("body")).alias("embed_hash"))


@query(
    f"""WITH {PAGES} SELECT coalesce(k.source_id, m.source_id) AS source_id, CASE WHEN m.source_id IS NULL THEN 'added' WHEN k.source_id IS NULL THEN 'removed'
    WHEN k.content_hash = m.content_hash THEN 'unchanged' WHEN k.embed_hash = m.embed_hash THEN 'refresh' ELSE 'changed' END AS status
    FROM kb k FULL JOIN index_manifest m ON k.source_id = m.source_id"""
)
def incremental_classify(spark: SparkSession, d: str) -> DataFrame:
    return incremental.classify(data.pages(spark, d, "content_hash", "embed_hash"), data.read(spark, d, "index_manifest"))


@query(
    f"""WITH {CHUNKS}, old AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at, title NULLS FIRST, authority NULLS FIRST) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1),
    m AS (SELECT c.source_id, coalesce(c.text = o.text AND len(o.vector) = 64, false) AS good FROM ch c LEFT JOIN old o ON c.source_id = o.source_id AND c.ordinal = o.ordinal),
    n AS (SELECT source_id, count(*) AS stored_n FROM old GROUP BY source_id)
    SELECT source_id, bool_and(good) AND coalesce(any_value(stored_n), 0) = count(*) AS reuse FROM m LEFT JOIN n USING (source_id) GROUP BY source_id"""
)
def incremental_reuse(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of every chunk against the first one."""
    raw = data.read(spark, d, "chunks").select("id", "source_id", "ordinal", "text", "vector", "indexed_at", "title", "authority")
    old = raw.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct("source_id", "ordinal", "text", "vector"), F.struct("indexed_at", "title", "authority")).alias("r")).select("id", "r.*")
    return incremental.reusable(data.chunks(spark, d, "source_id", "ordinal", "text"), old, 64)


_ONCE = "e AS (SELECT DISTINCT ON (event_id) * FROM sync_events ORDER BY event_id, received_at)"


@query("SELECT source, source_id, arg_max(event_type, (emitted_at, event_id)) AS last_type, max(emitted_at) AS last_seen, count(DISTINCT event_id) AS events FROM sync_events WHERE event_type IN ('doc', 'unchanged') AND source_id IS NOT NULL GROUP BY source, source_id")
def sync_state(spark: SparkSession, d: str) -> DataFrame:
    return incremental.current_items(data.read(spark, d, "sync_events"))


@query(
    """WITH seen AS (SELECT DISTINCT source, source_id FROM sync_events WHERE event_type IN ('doc', 'unchanged', 'skip', 'error') AND source_id IS NOT NULL),
    done AS (SELECT source FROM sync_events GROUP BY source HAVING count_if(event_type = 'error' AND reason LIKE 'timeout%') = 0)
    SELECT source_type AS source, source_id FROM (SELECT DISTINCT source_type, source_id FROM kb_documents WHERE source_id IS NOT NULL) p WHERE source_type IN (SELECT source FROM done) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.source = p.source_type AND s.source_id = p.source_id)"""
)
def sync_removed(spark: SparkSession, d: str) -> DataFrame:
    """Documents of sources that ran without a timeout and did not see them."""
    ev = data.read(spark, d, "sync_events")
    seen = ev.where(F.col("event_type").isin("doc", "unchanged", "skip", "error") & F.col("source_id").isNotNull())
    done = ev.groupBy("source").agg(F.count_if((F.col("event_type") == "error") & F.col("reason").startswith("timeout")).alias("n")).where(F.col("n") == 0)
    previous = data.read(spark, d, "kb_documents").where(F.col("source_id").isNotNull()).select(F.col("source_type").alias("source"), "source_id").distinct()
    return incremental.removed_items(previous, seen, done)


@query(
    """WITH s AS (SELECT DISTINCT source, event_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(reason), '\\([^)]*\\)', '', 'g'), '"[^"]*"', '', 'g'), '\\d+', 'N', 'g')) AS reason FROM sync_events WHERE event_type = 'skip' AND reason IS NOT NULL)
    SELECT source, reason, count(*) AS n FROM s GROUP BY source, reason"""
)
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return incremental.skip_reasons(data.read(spark, d, "sync_events"))


@query(
    """WITH e AS (SELECT source, event_id, min(epoch_us(received_at) - epoch_us(emitted_at)) AS us FROM sync_events GROUP BY source, event_id)
    SELECT source, coalesce(quantile_disc(us, 0.5), 0)::DOUBLE AS p50, coalesce(quantile_disc(us, 0.95), 0)::DOUBLE AS p95, count(*) AS n FROM e GROUP BY source"""
)
def latency_p50_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("emitted_at").cast("timestamp"))
    once = data.read(spark, d, "sync_events").groupBy("source", "event_id").agg(F.min(us).alias("us"))
    return once.groupBy("source").agg(evaluate.percentile("us", 0.5).alias("p50"), evaluate.percentile("us", 0.95).alias("p95"), F.count("*").alias("n"))


@query(f"WITH {CHUNKS}, s AS (SELECT id, source_id, ordinal, sum(length(content)) OVER (PARTITION BY source_id ORDER BY ordinal, id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY source_id ORDER BY ordinal, id) AS n FROM ch) SELECT id, source_id FROM s WHERE total <= 2000 OR n = 1")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return answers.budget_prefix(data.chunks(spark, d, "source_id", "content"), "source_id", [F.asc("ordinal"), F.asc("id")], F.length("content"), 2000).select("id", "source_id")


@query(f"WITH {CHUNKS} SELECT id, CASE WHEN contains(source_url, '/-/blob/') AND line_start > 0 AND lower(kind) = 'code' THEN regexp_replace(source_url, '#.*$', '') || '#L' || line_start || CASE WHEN line_end > line_start THEN '-' || line_end ELSE '' END ELSE source_url END AS url FROM ch")
def deep_links(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "source_url", "kind", "line_start", "line_end")
    return ch.select("id", answers.deep_link(F.col("source_url"), F.col("kind"), F.col("line_start"), F.col("line_end")).alias("url"))


@query(f"WITH {PAGES} SELECT source_id, CASE WHEN regexp_extract(source_url, '^([a-zA-Z]+://[^/:?#]+)', 1) <> '' THEN lower(regexp_extract(source_url, '^([a-zA-Z]+://[^/:?#]+)', 1)) || regexp_replace(regexp_extract(source_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END AS url FROM kb")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return data.pages(spark, d, "source_url").select("source_id", links.canonical_url(F.col("source_url")).alias("url"))


# ---- chunking


@query()
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every page cut into passages by its structure (sequential within a page, so no SQL)."""
    kb = data.pages(spark, d, "kind", "body", "frontmatter")
    return chunking.chunk_documents(kb).select("id", "source_id", "ordinal", "heading_path", "token_estimate", "line_start", "line_end", F.md5("content").alias("content_md5"))


@query()
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return chunking.outline(data.pages(spark, d, "body"))


@query(
    f"""WITH {PAGES}, l AS (SELECT source_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS no FROM kb WHERE body IS NOT NULL),
    s AS (SELECT *, floor((sum(length(line) + 1) OVER (PARTITION BY source_id ORDER BY no) - 1) / 1500) AS piece FROM l)
    SELECT source_id, piece::BIGINT AS piece, min(no)::BIGINT AS first_line, max(no)::BIGINT AS last_line, sum(length(line) + 1)::BIGINT AS chars FROM s GROUP BY source_id, piece"""
)
def chunk_pack_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack_lines(data.pages(spark, d, "body"), 1500)


# ---- rules

_RULES = [
    {"match": {"path": "gitlab/core/*"}, "set": {"tier": "core"}},
    {"match": {"path": ["confluence/*", "devportal/*ledgerline*"], "title": "*e*"}, "set": {"tier": "pages"}},
    {"match": {"path": "*/docs/*"}, "set": {"tier": "docs"}},
    {"match": {}, "set": {"tier": "never"}},
]


def _rules_sql() -> str:
    out = "CASE "
    for r in _RULES:
        if r["match"]:
            cond = " AND ".join("(" + " OR ".join(f"regexp_matches(coalesce({'rel_path' if k == 'path' else k}, ''), {q(wildcard_regex(p))})" for p in ([v] if isinstance(v, str) else v)) + ")" for k, v in r["match"].items())
            out += f"WHEN {cond} THEN '{r['set']['tier']}' "
    return out + "END"


@query(f"WITH {PAGES} SELECT source_id, {_rules_sql()} AS tier FROM kb")
def rules_first_match(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "rel_path", "title")
    return hierarchy.first_match(kb, "source_id", _RULES, {"path": F.col("rel_path"), "title": F.col("title")}).select("source_id", "tier")


# ---- whole documents


def _status_sql() -> str:
    low = "lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '[*_`>#|]', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\s+', ' ', 'g'))[1:120])"
    return "CASE WHEN " + low + " = '' THEN NULL " + " ".join(f"WHEN regexp_matches({low}, {q(p)}) THEN '{n}'" for n, p in V.DECISION_STATUS) + " END"


@query(
    f"""WITH {PAGES}, c AS (SELECT source_id, authority, body, list_transform([regexp_extract(body, {q(documents._STATUS_HEADING)}, 1), regexp_extract(body, {q(documents._STATUS_INLINE)}, 1)], lambda x: {_status_sql()}) AS s FROM kb WHERE body IS NOT NULL)
    SELECT source_id, coalesce(s[1], s[2]) AS status, CASE WHEN authority = 'binding' AND NOT CASE WHEN coalesce(s[1], s[2]) IS NOT NULL THEN coalesce(s[1], s[2]) = 'accepted' ELSE regexp_matches(body, {q(documents._RECORD)}) END THEN 'descriptive' ELSE authority END AS effective FROM c"""
)
def effective_authority(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "body").where(F.col("body").isNotNull())
    none = F.lit(None).cast("string")
    return kb.select("source_id", documents.decision_status(F.col("body"), none).alias("status"), documents.effective_authority(F.col("authority"), F.col("body"), none).alias("effective"))


@query(
    f"""WITH {PAGES}, h AS (SELECT regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS h, max(source_id) AS source_id FROM (SELECT source_id, unnest([source_id, coalesce(rel_path, source_id), regexp_replace(coalesce(rel_path, source_id), '\\.md$', '')]) AS n FROM kb) GROUP BY 1)
    SELECT DISTINCT upper(k.rel_path) AS q, h.source_id FROM kb k JOIN h ON regexp_replace(lower(k.rel_path), '[^a-z0-9]', '', 'g') = h.h WHERE h.h <> ''"""
)
def resolve_ids(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "rel_path")
    return documents.resolve_ids(kb.where(F.col("rel_path").isNotNull()).select(F.upper("rel_path").alias("q")).distinct(), kb)


@query(
    f"""WITH {CHUNKS} SELECT id, concat_ws(' — ', heading_path, nullif(source_url, '')) || CASE WHEN coalesce(last_modified, '') <> '' THEN ' (as of ' || last_modified || ')' ELSE '' END || chr(10) || CASE WHEN length(content) > 600 THEN left(content, 600) || '…' ELSE content END AS block FROM ch"""
)
def citation_blocks(spark: SparkSession, d: str) -> DataFrame:
    return documents.context_rows(data.chunks(spark, d, "heading_path", "source_url", "content"))


@query(
    f"""WITH {PAGES} SELECT source_id, regexp_matches(lower(left(body, 600)), {q('|'.join(V.ABSTENTIONS))}) AS abstains FROM kb WHERE body IS NOT NULL"""
)
def abstentions(spark: SparkSession, d: str) -> DataFrame:
    return data.pages(spark, d, "body").where(F.col("body").isNotNull()).select("source_id", T.looks_like_abstention(F.col("body")).alias("abstains"))


@query()
def outline_rows(spark: SparkSession, d: str) -> DataFrame:
    return documents.outline_rows(chunking.outline(data.pages(spark, d, "body")))
