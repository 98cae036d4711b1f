"""Queries: whole runs, their reports, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import text as T
from ..operators import graph, retrieval, runs
from . import data, graphs, search
from .sql import CHUNKS, PAGES, q

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- a sync: what the first half of the log's time leaves is the run before, the second the run itself

_CUT = "cut AS (SELECT make_timestamp((epoch_us(min(emitted_at)) + epoch_us(max(emitted_at))) // 2) AS t FROM sync_events)"


def _last(name: str, where: str) -> str:
    return f"""{name} AS (SELECT source, source_id, arg_max({{'t': event_type, 'f': fingerprint}}, (emitted_at, event_id, received_at)) AS e
        FROM sync_events, cut WHERE source IS NOT NULL AND source_id IS NOT NULL AND {where} GROUP BY 1, 2)"""


_RUN = f"""{_CUT}, {_last('before', 'emitted_at <= t')}, {_last('now', 'emitted_at > t')},
    previous AS (SELECT source, source_id, e.f AS was FROM before WHERE e.t NOT IN ('skip', 'meta')),
    health AS (SELECT source, bool_or(event_type = 'error') AS ill FROM sync_events, cut WHERE source IS NOT NULL AND emitted_at > t GROUP BY source),
    joined AS (SELECT coalesce(p.source, n.source) AS source, coalesce(p.source_id, n.source_id) AS source_id, p.source_id IS NOT NULL AS known, p.was, n.e.t AS t, n.e.f AS f FROM previous p FULL JOIN now n ON p.source = n.source AND p.source_id = n.source_id),
    run AS (SELECT j.source, source_id, CASE WHEN t IS NULL THEN CASE WHEN ill = false THEN 'removed' ELSE 'kept' END WHEN t = 'error' THEN 'failed' WHEN t = 'skip' THEN 'skipped'
        WHEN t = 'meta' THEN CASE WHEN known THEN 'refreshed' ELSE 'ignored' END WHEN t = 'unchanged' THEN CASE WHEN known THEN 'unchanged' ELSE 'added' END
        WHEN NOT known THEN 'added' WHEN was IS NOT DISTINCT FROM f THEN 'unchanged' ELSE 'changed' END AS action, CASE WHEN t = 'doc' THEN f ELSE coalesce(was, f) END AS fingerprint
        FROM joined j LEFT JOIN health h ON j.source = h.source)"""


def _sync(spark: SparkSession, d: str) -> DataFrame:
    events = data.read(spark, d, "sync_events")
    cut = events.agg(F.timestamp_micros(F.expr("(unix_micros(CAST(min(emitted_at) AS TIMESTAMP)) + unix_micros(CAST(max(emitted_at) AS TIMESTAMP))) DIV 2")).alias("t")).scalar()
    before = runs.last_events(events.where(F.col("emitted_at") <= cut)).where(~F.col("event_type").isin("skip", "meta"))
    return runs.sync_run(before.select("source", "source_id", "fingerprint"), events.where(F.col("emitted_at") > cut))


@query(f"WITH {_RUN} SELECT source, source_id, action, fingerprint FROM run")
def sync_run(spark: SparkSession, d: str) -> DataFrame:
    return _sync(spark, d)


@query(f"WITH {_RUN} SELECT source, action, count(*) AS n FROM run GROUP BY 1, 2")
def sync_counters(spark: SparkSession, d: str) -> DataFrame:
    return runs.counters(_sync(spark, d), "source", "action")


@query(f"WITH {_RUN} SELECT source, source_id, fingerprint FROM run WHERE action NOT IN ('removed', 'skipped', 'ignored')")
def sync_state(spark: SparkSession, d: str) -> DataFrame:
    return runs.next_items(_sync(spark, d))


# ---- an ingest: pages against the manifest, their drafts against the stored chunks

_DRAFTS = "drafts AS (SELECT source_id, ordinal, any_value(content) AS text FROM (SELECT * FROM chunk_drafts WHERE id IS NOT NULL) GROUP BY source_id, ordinal)"
_INGEST = f"""{PAGES}, {_DRAFTS},
    d AS (SELECT source_id, content_hash AS c, embed_hash AS e FROM kb), m AS (SELECT source_id, content_hash AS mc, embed_hash AS me FROM index_manifest),
    found AS (SELECT coalesce(d.source_id, m.source_id) AS source_id, CASE WHEN m.source_id IS NULL THEN 'added' WHEN d.source_id IS NULL THEN 'removed' WHEN c = mc THEN 'unchanged' WHEN e = me THEN 'refresh' ELSE 'changed' END AS status FROM d FULL JOIN m ON d.source_id = m.source_id),
    stored AS (SELECT source_id, ordinal, text FROM drafts WHERE hash_ok(source_id)),
    met AS (SELECT x.source_id, bool_and(s.text IS NOT NULL AND s.text = x.text) AS good, count(*) AS n FROM drafts x LEFT JOIN stored s ON x.source_id = s.source_id AND x.ordinal = s.ordinal GROUP BY 1),
    run AS (SELECT f.source_id, status, status IN ('unchanged', 'refresh') AND coalesce(good, false) AS reuse, coalesce(n, 0) AS chunks FROM found f LEFT JOIN met ON f.source_id = met.source_id)"""
#: Half of the documents' drafts, by the last digit of their id's md5, count as stored.
_INGEST = _INGEST.replace("hash_ok(source_id)", "right(md5(source_id), 1) < '8'")


def _ingest(spark: SparkSession, d: str) -> DataFrame:
    pages = data.pages(spark, d, "content_hash", "embed_hash")
    drafts = data.read(spark, d, "chunk_drafts").where(F.col("id").isNotNull()).groupBy("source_id", "ordinal").agg(F.min("content").alias("text"))
    stored = drafts.where(F.right(F.md5("source_id"), F.lit(1)) < "8").withColumn("vector", F.array(F.lit(1.0)))
    return runs.ingest_run(pages, data.read(spark, d, "index_manifest"), drafts, stored, 1)


@query(f"WITH {_INGEST} SELECT source_id, status, reuse, chunks FROM run")
def ingest_run(spark: SparkSession, d: str) -> DataFrame:
    return _ingest(spark, d)


@query(
    f"""WITH {_INGEST} SELECT status, count(*) AS documents, sum(chunks)::BIGINT AS chunks, sum(w)::BIGINT AS embedded, ceil(sum(w) / 256.0)::BIGINT AS batches
    FROM (SELECT *, CASE WHEN status IN ('added', 'changed') OR (status = 'refresh' AND NOT reuse) THEN chunks ELSE 0 END AS w FROM run) GROUP BY status"""
)
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return runs.ingest_report(_ingest(spark, d))


_KIND = "CASE lower(kind) WHEN 'project' THEN 1 WHEN 'doc' THEN 2 WHEN 'api' THEN 3 WHEN 'code' THEN 4 ELSE 5 END"


@query(f"WITH {PAGES} SELECT source_id, row_number() OVER (ORDER BY {_KIND}, rel_path NULLS FIRST, source_id) AS place FROM kb")
def ingest_order(spark: SparkSession, d: str) -> DataFrame:
    return runs.ingest_order(data.pages(spark, d, "kind")).select("source_id", "place")


@query(f"WITH {PAGES} SELECT DISTINCT rel_path FROM kb WHERE rel_path IS NOT NULL AND rel_path NOT IN (SELECT rel_path FROM index_manifest WHERE rel_path IS NOT NULL AND right(md5(rel_path), 1) < '8')")
def foreign_files(spark: SparkSession, d: str) -> DataFrame:
    """The pages' files against the half of the manifest that a state knows."""
    state = data.read(spark, d, "index_manifest").where(F.right(F.md5("rel_path"), F.lit(1)) < "8")
    return runs.foreign_files(data.pages(spark, d), state)


@query(f"WITH {PAGES} SELECT kb.source_id, kb.content_hash IS DISTINCT FROM m.content_hash AS stale FROM kb JOIN index_manifest m ON kb.source_id = m.source_id")
def stale_documents(spark: SparkSession, d: str) -> DataFrame:
    return runs.stale_documents(data.pages(spark, d, "content_hash"), data.read(spark, d, "index_manifest"))


@query(
    f"""WITH {PAGES} SELECT nullif(trim(frontmatter['space']), '') AS space, count(*) AS pages, count_if(coalesce(length(body) >= 400, false)) AS kept, count_if(NOT coalesce(length(body) >= 400, false)) AS left_out,
    count_if(title IS NULL) AS untitled, max(nullif(last_modified, '')) AS last_modified FROM kb WHERE nullif(trim(frontmatter['space']), '') IS NOT NULL GROUP BY 1"""
)
def space_counters(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "frontmatter", "body", "last_modified", "title")
    return runs.space_counters(kb, graph.meta("space"), F.length("body") >= 400)


@query(f"SELECT via, count(*) AS n FROM ({graphs.ORACLE['place_documents']}) GROUP BY via")
def placement_counts(spark: SparkSession, d: str) -> DataFrame:
    return graphs.place_documents(spark, d).groupBy("via").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(subarea, '(none)') AS subarea, count(*) AS n FROM (SELECT c_name AS source_id FROM orders JOIN customer ON o_custkey = c_custkey) o LEFT JOIN ({graphs.ORACLE['place_documents']}) p USING (source_id) GROUP BY 1")
def placed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The customers' orders, which stand for chunks, by where their document lies."""
    c = data.read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("source_id"))
    rows = data.read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("source_id")
    return runs.placed_counts(rows, graphs.place_documents(spark, d), "source_id")


_CODES = ", ".join(f"{c}s AS (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS k FROM ch WHERE {c} IS NOT NULL GROUP BY {c})" for c in ("source_type", "lang"))


@query(f"WITH {CHUNKS}, {_CODES} SELECT id, a.k::INT AS source_type, b.k::INT AS lang FROM ch LEFT JOIN source_types a ON ch.source_type = a.source_type LEFT JOIN langs b ON ch.lang = b.lang")
def dictionary_codes(spark: SparkSession, d: str) -> DataFrame:
    return runs.encoded(data.chunks(spark, d, "source_type", "lang").select("id", "source_type", "lang"), ["source_type", "lang"])


@query(
    f"""WITH {PAGES}, {graphs._DOC_EDGES}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM doc_edges UNION SELECT dst FROM doc_edges))
    SELECT a.k AS a, b.k AS b, relation FROM doc_edges JOIN ids a ON src = a.id JOIN ids b ON dst = b.id"""
)
def graph_payload(spark: SparkSession, d: str) -> DataFrame:
    return runs.doc_payload(graphs.graph_doc_edges(spark, d))


@query(
    f"""WITH listed AS ({graphs.ORACLE['graph_neighbors']}), kbp AS (WITH {PAGES} SELECT source_id AS id, nullif(trim(frontmatter['project']), '') AS place FROM kb),
    mine AS (SELECT id AS src, place FROM kbp WHERE place IS NOT NULL),
    more AS (SELECT m.src, p.id AS dst FROM mine m JOIN kbp p ON m.place = p.place AND m.src <> p.id WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.src = m.src AND l.dst = p.id)),
    every AS (SELECT src, dst, 0 AS t, rank AS r FROM listed WHERE src IN (SELECT id FROM kbp) UNION ALL SELECT src, dst, 1, 0 FROM more)
    SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY t, r, dst) AS rank FROM every"""
)
def graph_all_neighbors(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "frontmatter")
    places = kb.select(F.col("source_id").alias("id"), graph.meta("project").alias("place"))
    return runs.all_neighbours(graphs.graph_neighbors(spark, d), places, places.select("id"))


# ---- scalars

_ENTITIES = f"""{PAGES}, e AS (SELECT source_id, regexp_extract(source_id, '^devportal:([^/]+/[^/:]+/[^/:]+)', 1) AS ref FROM kb WHERE source_id LIKE 'devportal:%')"""


@query(f"WITH {_ENTITIES} SELECT source_id, ref FROM e WHERE ref <> '' AND NOT regexp_matches(ref, '(?i)^default/component/m.*$') AND NOT regexp_matches(regexp_replace(ref, '^[^/]+/', ''), '(?i)^component/.*x$')")
def entity_refs(spark: SparkSession, d: str) -> DataFrame:
    """The entities of portal pages, without those that wildcards leave out."""
    kb = data.pages(spark, d).where(F.col("source_id").startswith("devportal:"))
    part = lambda i: F.regexp_extract("source_id", r"^devportal:([^/]+)/([^/:]+)/([^/:]+)", i)
    refs = kb.where(part(3) != "").select("source_id", scalars.entity_ref(part(1), part(2), part(3)).alias("ref"))
    return refs.where(~scalars.entity_excluded(F.col("ref"), ["default/component/m*", "component/*x"]))


@query("SELECT doc_id, coalesce(lower(trim(source)) = 'adr', false) OR coalesce(regexp_matches(title, '(?i)\\badr[- _]?\\d'), false) AS decision FROM documents")
def decision_records(spark: SparkSession, d: str) -> DataFrame:
    docs = data.read(spark, d, "documents")
    return docs.select("doc_id", scalars.is_decision(F.lit("d"), F.lower(F.trim("source")), F.col("title")).alias("decision"))


@query(
    f"""WITH {PAGES}, h AS (SELECT source_id, title, body, nullif(trim(regexp_extract(body, '(?m)^#[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1)), '') AS heading FROM kb WHERE body IS NOT NULL AND title IS NOT NULL)
    SELECT source_id, heading, md5(CASE WHEN heading IS NOT NULL THEN body ELSE '# ' || title || chr(10) || chr(10) || body END) AS titled, len(regexp_extract_all(body, '(?m)^#{{1,6}}[ \\t]')) AS headings FROM h"""
)
def titled_bodies(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "body", "title").where(F.col("body").isNotNull() & F.col("title").isNotNull())
    b = F.col("body")
    deeper = F.regexp_extract_all(scalars.demote_headings(b), F.lit(r"(?m)^#{2,6}[ \t]"), F.lit(0))  # the sixth level stays, others go down
    return kb.select("source_id", scalars.first_heading(b).alias("heading"), F.md5(scalars.with_title(b, F.col("title"))).alias("titled"), F.size(deeper).cast("long").alias("headings"))


@query(
    """SELECT l_orderkey, l_linenumber, least(greatest(l_quantity / 20, 0), 2) AS clamped, least(greatest(floor(l_extendedprice), 1), 50000)::BIGINT AS whole,
    printf('%.1f%%', round(l_discount * 100.0 / (l_discount + l_tax + 1), 1)) AS share FROM lineitem"""
)
def number_scalars(spark: SparkSession, d: str) -> DataFrame:
    li = data.read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", scalars.clamp(F.col("l_quantity") / 20, 0.0, 2.0).alias("clamped"), scalars.as_int(F.col("l_extendedprice"), 1, 1, 50000).alias("whole"), scalars.percent(F.col("l_discount"), F.col("l_discount") + F.col("l_tax") + 1).alias("share"))


@query("SELECT event_type, coalesce(avg(CASE WHEN value > 50 THEN value END), 0) AS mean FROM events GROUP BY event_type")
def means_or_zero(spark: SparkSession, d: str) -> DataFrame:
    return data.read(spark, d, "events").groupBy("event_type").agg(scalars.mean_or_zero(F.when(F.col("value") > 50, F.col("value"))).alias("mean"))


@query(
    f"""SELECT qid, id, round(j / 10.0 + score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY j DESC, score DESC, rank) AS rank
    FROM (SELECT *, ascii(right(md5(id), 1)) % 11 AS j FROM ({search.ORACLE['bm25_top24']}) WHERE rank <= 18) QUALIFY rank <= 6""".replace("QUALIFY rank <= 6", "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY j DESC, score DESC, rank) <= 6")
)
def reranked(spark: SparkSession, d: str) -> DataFrame:
    """The keyword hits ordered by a judge; a number made of the id stands for what it says."""
    hits = search.bm25_top24(spark, d)
    judged = hits.select("qid", "id", (F.ascii(F.right(F.md5("id"), F.lit(1))) % 11).cast("double").alias("judged"))
    return retrieval.rerank(hits.select("qid", "id", "score", "rank"), judged, 6)


@query(f"WITH {CHUNKS} SELECT id, string_split(rel_path, '.')[-1] AS ending, md5({q('Instruct: Find the passage')} || chr(10) || 'Query: ' || title) AS asked FROM ch WHERE rel_path IS NOT NULL AND title IS NOT NULL")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "rel_path", "title").where(F.col("rel_path").isNotNull() & F.col("title").isNotNull())
    return ch.select("id", F.element_at(F.split("rel_path", r"\."), -1).alias("ending"), F.md5(scalars.query_text(F.col("title"), "Find the passage")).alias("asked"))


@query("SELECT doc_id, regexp_replace(title, '(?i)(ledger|the|di)', '**\\1**', 'g') AS marked FROM documents WHERE title IS NOT NULL")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    docs = data.read(spark, d, "documents").where(F.col("title").isNotNull())
    return docs.select("doc_id", scalars.highlighted(F.col("title"), F.lit("di ledger, the")).alias("marked"))


@query(f"WITH {PAGES} SELECT source_id, ceil((length(body) + len(regexp_extract_all(body, '[\\x{{10000}}-\\x{{10FFFF}}]'))) / 3.5e0)::BIGINT AS tokens FROM kb WHERE body IS NOT NULL")
def body_tokens(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "body").where(F.col("body").isNotNull())
    return kb.select("source_id", T.estimate_tokens(F.col("body")).alias("tokens"))
