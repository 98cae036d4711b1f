"""Queries: links, graph, hierarchy, map and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import answers, catalog, graph, hierarchy, links, mapping
from ..streaming import events
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


# ---- links

_MD = r"(!?\[[^\]]*\]\(\s*[^)\s]+(?:\s+\"[^\"]*\")?\s*\))"


@query(
    f"""WITH {PAGES}, m AS (SELECT source_id, list_concat(list_transform(list_filter(regexp_extract_all(body, {q(_MD)}, 1), lambda m: NOT starts_with(m, '!')), lambda m: regexp_extract(m, '\\]\\(\\s*([^)\\s]+)', 1)),
    regexp_extract_all(body, '<(https?://[^>\\s]+)>', 1)) AS h FROM kb WHERE body IS NOT NULL)
    SELECT source_id, unnest(h) AS href, unnest(range(0, len(h)))::INT AS pos FROM m"""
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return links.extract_links(data.pages(spark, d, "body")).select("source_id", "href", "pos")


_HOSTS = links.Hosts(portal=["docs.ledgerline.example", "portal.quorvia.example"], wiki=["wiki.tarnfield.example", "confluence.morvane.example"], repository=["git.tarnfield.example"], page=r"/(?:pages|docs|view)/(\d+)")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    """The pages' body links, and their own addresses as links to themselves."""
    kb = data.pages(spark, d, "body", "source_url")
    own = kb.where(F.col("source_url").isNotNull()).select("source_id", F.lit(-1).alias("pos"), F.col("source_url").alias("href"), F.lit(None).cast("string").alias("text"))
    return links.resolve_links(links.extract_links(kb).unionByName(own), kb.select("source_id"), _HOSTS)


@query(
    f"""WITH {PAGES}, u AS (SELECT source_id, source_url, lower(regexp_extract(source_url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, regexp_extract(source_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM kb WHERE source_url IS NOT NULL),
    k AS (SELECT *, regexp_extract(path, '/(?:pages|docs|view)/(\\d+)', 1) AS page, lower(regexp_extract(path, '^/(.+?)/-/(?:blob|raw)/[^/]+/', 1) || ':' || regexp_extract(path, '^/.+?/-/(?:blob|raw)/[^/]+/(.*)$', 1)) AS file FROM u),
    pages AS (SELECT regexp_extract(source_id, '^[^:]+:.*[:/](\\d+)$', 1) AS page, min(source_id) AS target FROM kb WHERE source_id LIKE 'confluence:%' GROUP BY 1),
    files AS (SELECT lower(regexp_replace(source_id, '^(gitlab|adr):', '')) AS file, min(source_id) AS target FROM kb WHERE regexp_matches(source_id, '^(gitlab|adr):') GROUP BY 1),
    r AS (SELECT k.source_id, CASE WHEN host IN ('wiki.tarnfield.example', 'confluence.morvane.example') AND k.page <> '' THEN p.target WHEN host = 'git.tarnfield.example' THEN f.target END AS target, host
        FROM k LEFT JOIN pages p ON k.page = p.page AND k.page <> '' LEFT JOIN files f ON k.file = f.file)
    SELECT source_id, target FROM r WHERE target IS NOT NULL AND host NOT IN ('docs.ledgerline.example', 'portal.quorvia.example')"""
)
def link_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose own address resolves to a document of the collection."""
    r = _resolved(spark, d).where((F.col("pos") == -1) & F.col("target").isNotNull())
    host = F.lower(F.regexp_extract("href", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return r.where(~host.isin(_HOSTS.portal)).select("source_id", "target")


@query()
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Every link that resolves to a document of the collection, of any host; a page's own address has position -1."""
    return _resolved(spark, d).where(F.col("target").isNotNull()).select("source_id", "pos", "href", "target")


def _link_edges(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the resolved links of a body lead to, as edges."""
    found = link_targets(spark, d).where((F.col("pos") >= 0) & (F.col("source_id") != F.col("target")))
    return found.select(F.col("source_id").alias("src"), F.col("target").alias("dst"), F.lit("links_to").alias("relation")).distinct()


@query()
def link_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).where(F.col("pos") >= 0).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def graph_broken_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.broken_links(_resolved(spark, d).where(F.col("pos") >= 0), [name for name, fault, _ in links.REASONS if fault])


# ---- graph

_EDGES = f"""{PAGES},
    fm AS (SELECT source_id, nullif(trim(frontmatter['space']), '') AS space, nullif(trim(frontmatter['project']), '') AS project, nullif(trim(frontmatter['owner']), '') AS owner, regexp_replace(coalesce(rel_path, ''), '/?[^/]*$', '') AS folder FROM kb),
    fo AS (SELECT source_id, list_filter(string_split(folder, '/'), lambda p: p <> '') AS p FROM fm),
    edges AS (SELECT DISTINCT src, dst, relation FROM (
        SELECT source_id AS src, 'space:' || space AS dst, 'in_space' AS relation FROM fm WHERE space IS NOT NULL
        UNION ALL SELECT source_id, 'repo:' || project, 'in_repo' FROM fm WHERE project IS NOT NULL
        UNION ALL SELECT source_id, 'team:' || lower(trim(regexp_replace(regexp_replace(owner, '(?i)^(group|user):', ''), '(?i)^default/', ''))), 'owned_by' FROM fm WHERE owner IS NOT NULL
        UNION ALL SELECT source_id, 'tree:' || array_to_string(p[1:unnest(range(1, len(p) + 1))], '/'), 'under' FROM fo))"""


def _hub_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(graph.hub_edges(data.pages(spark, d, "frontmatter", "rel_path")))


@query(f"WITH {_EDGES} SELECT src, dst, relation FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _hub_edges(spark, d).select("src", "dst", "relation")


@query(f"WITH {_EDGES} SELECT dst AS hub, relation, count(*) AS size FROM edges GROUP BY 1, 2")
def graph_hub_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.hub_sizes(_hub_edges(spark, d))


@query(f"WITH {_EDGES} SELECT id, min(type) AS type FROM (SELECT source_id AS id, ' doc' AS type FROM kb UNION ALL SELECT dst, regexp_extract(dst, '^([a-z]+):', 1) FROM edges) GROUP BY id".replace("min(type)", "trim(min(type))"))
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "frontmatter", "rel_path")
    return graph.nodes(kb, graph.hub_edges(kb)).select("id", "type")


#: Cards of the projects, and the edges between documents that metadata state.  The tables' pages name neither parents nor cards, so
#: the page with the smallest number of each space stands for the parent of its pages; each project gets a card, which names its first file and two pages.
_DOC_EDGES = """fmd AS (SELECT source_id, source_url, nullif(trim(frontmatter['space']), '') AS space, nullif(trim(frontmatter['project']), '') AS project, nullif(trim(frontmatter['page_id']), '') AS page_id FROM kb),
    par AS (SELECT space, min(page_id) AS parent_id FROM fmd WHERE space IS NOT NULL AND source_id LIKE 'confluence:%' GROUP BY space),
    pgs AS (SELECT regexp_extract(source_id, '^[^:]+:.*[:/](\\d+)$', 1) AS page, min(source_id) AS target FROM kb WHERE source_id LIKE 'confluence:%' GROUP BY 1),
    fls AS (SELECT lower(regexp_replace(source_id, '^(gitlab|adr):', '')) AS file, min(source_id) AS target FROM kb WHERE regexp_matches(source_id, '^(gitlab|adr):') GROUP BY 1),
    cards AS (SELECT 'gitlab:' || project || ':__project' AS source_id, project, min(CASE WHEN source_id LIKE 'gitlab:%' THEN source_url END) AS ref FROM fmd WHERE project IS NOT NULL GROUP BY project),
    two AS (SELECT min(page_id) AS a, max(page_id) AS b FROM fmd WHERE source_id LIKE 'confluence:%'),
    doc_edges AS (SELECT DISTINCT src, dst, relation FROM (
        SELECT f.source_id AS src, p.target AS dst, 'child_of' AS relation FROM fmd f JOIN par USING (space) JOIN pgs p ON p.page = par.parent_id
        UNION ALL SELECT source_id, 'gitlab:' || project || ':__project', 'described_by' FROM fmd WHERE project IS NOT NULL
        UNION ALL SELECT c.source_id, f.target, 'documents' FROM cards c JOIN fls f ON f.file = lower(regexp_extract(ref, '^https?://[^/]+/(.+?)/-/(?:blob|raw)/[^/]+/', 1) || ':' || regexp_extract(ref, '/-/(?:blob|raw)/[^/]+/([^?#]*)', 1))
        UNION ALL SELECT c.source_id, p.target, 'related_wiki' FROM cards c, two JOIN pgs p ON p.page IN (two.a, two.b)) WHERE src <> dst)""".replace("\\\\", "\\")


def _graph_docs(spark: SparkSession, d: str) -> DataFrame:
    """The pages with their parents named, and the cards of their projects."""
    kb = data.pages(spark, d, "kind", "body", "source_url", "frontmatter", "rel_path")
    space, project, page = graph.meta("space"), graph.meta("project"), graph.meta("page_id")
    wiki = F.col("source_id").startswith("confluence:")
    parents = kb.where(space.isNotNull() & wiki).groupBy(space.alias("_s")).agg(F.min(page).alias("parent_id"))
    two = kb.where(wiki).agg(F.min(page).alias("a"), F.max(page).alias("b"))
    url = lambda c: F.concat(F.lit("https://confluence.morvane.example/pages/"), two.select(c).scalar())
    files = kb.where(project.isNotNull()).groupBy(project.alias("_p")).agg(F.min(F.when(F.col("source_id").startswith("gitlab:"), F.col("source_url"))).alias("ref"))
    null = F.lit(None).cast("string")
    named = kb.join(parents, space == F.col("_s"), "left").withColumn("frontmatter", F.map_concat(F.coalesce("frontmatter", F.create_map().cast("map<string,string>")), F.when(F.col("parent_id").isNotNull(), F.create_map(F.lit("parent_id"), "parent_id")).otherwise(F.create_map().cast("map<string,string>"))))
    # A null value in the map stands for a key that is not there.
    cards = files.select(F.concat(F.lit("gitlab:"), "_p", F.lit(":__project")).alias("source_id"), F.lit("project").alias("kind"), null.alias("body"), F.create_map(F.lit("techdocs_ref"), "ref", F.lit("confluence_pages"), F.concat_ws(", ", url("a"), url("b"))).alias("frontmatter"), null.alias("rel_path"))
    return named.select("source_id", "kind", "body", "frontmatter", "rel_path").unionByName(cards)


def _doc_edges(docs: DataFrame) -> DataFrame:
    return graph.document_edges(graph.document_references(docs, _HOSTS))


@query(f"WITH {PAGES}, {_DOC_EDGES} SELECT src, dst, relation FROM doc_edges")
def graph_doc_edges(spark: SparkSession, d: str) -> DataFrame:
    """What documents say of documents: parents, cards, what cards document and the pages that go with them, links of the bodies."""
    return _doc_edges(_graph_docs(spark, d))


@query(f"WITH {PAGES}, {_DOC_EDGES} SELECT relation, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM doc_edges GROUP BY relation")
def graph_relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return _doc_edges(_graph_docs(spark, d)).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query()
def graph_reference_gaps(spark: SparkSession, d: str) -> DataFrame:
    return graph.reference_gaps(graph.document_references(_graph_docs(spark, d), _HOSTS))


@query(
    f"""WITH {_EDGES}, {_DOC_EDGES}, sizes AS (SELECT dst AS hub, relation, count(*) AS size FROM edges GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 60),
    m AS (SELECT e.src, e.dst AS hub, e.relation, s.size FROM edges e JOIN sizes s ON e.dst = s.hub AND e.relation = s.relation),
    w AS (SELECT *, CASE relation WHEN 'child_of' THEN 0.95 WHEN 'documents' THEN 0.95 WHEN 'described_by' THEN 0.9 WHEN 'related_wiki' THEN 0.8 ELSE 1.0 END AS weight FROM doc_edges),
    every AS (SELECT src, dst, relation, 'out' AS direction, NULL AS via, round(weight, 6) AS weight, 0 AS b, 0 AS s FROM w
        UNION ALL SELECT dst, src, relation, 'in', NULL, round(weight - 0.05, 6), 1, 0 FROM w
        UNION ALL SELECT x.src, y.src, x.relation, 'sibling', x.hub, round(0.6 / log2(greatest(x.size, 2) + 2), 6), 2, x.size FROM m x JOIN m y ON x.hub = y.hub AND x.relation = y.relation AND x.src <> y.src),
    best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, b, s, relation, via) = 1)
    SELECT src, dst, relation, direction, via, weight::DOUBLE AS weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM best QUALIFY rank <= 12"""
)
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    docs = _graph_docs(spark, d)
    return graph.neighbours(_doc_edges(docs), _hub_edges(spark, d), docs.select(F.col("source_id").alias("id")))


@query(
    f"""WITH RECURSIVE {PAGES}, {_DOC_EDGES}, e AS (SELECT src AS a, dst AS b FROM doc_edges UNION SELECT dst, src FROM doc_edges), r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
    SELECT id, min(reach) AS component FROM r GROUP BY id"""
)
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_doc_edges(_graph_docs(spark, d)).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query()
def graph_link_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """As graph_neighbors, over the links of the bodies."""
    kb = data.pages(spark, d, "frontmatter", "rel_path")
    return graph.neighbours(_link_edges(spark, d), _hub_edges(spark, d), kb.select(F.col("source_id").alias("id")))


@query()
def graph_link_components(spark: SparkSession, d: str) -> DataFrame:
    """As graph_components, over the links of the bodies."""
    return graph.components(_link_edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))


_FOLDERS = f"""{PAGES}, f AS (SELECT DISTINCT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) AS id FROM (SELECT string_split(rel_path, '/') AS p FROM kb WHERE rel_path IS NOT NULL)),
    par AS (SELECT id, regexp_replace(id, '/[^/]*$', '') AS parent FROM f WHERE contains(id, '/'))"""


@query(f"WITH RECURSIVE {_FOLDERS}, w AS (SELECT id, 1 AS depth, parent AS ancestor FROM par UNION ALL SELECT w.id, depth + 1, p.parent FROM w JOIN par p ON w.ancestor = p.id WHERE depth < 100) SELECT id, depth, ancestor FROM w")
def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    paths = data.pages(spark, d, "rel_path").where(F.col("rel_path").isNotNull())
    folders = paths.select(F.explode(graph.ancestor_prefixes(F.col("rel_path"))).alias("id")).distinct()
    return graph.ancestor_chain(folders.where(F.contains("id", F.lit("/"))).withColumn("parent", F.regexp_replace("id", "/[^/]*$", "")))


@query(f"WITH {_FOLDERS} SELECT id FROM f")
def ancestor_prefixes(spark: SparkSession, d: str) -> DataFrame:
    paths = data.pages(spark, d, "rel_path").where(F.col("rel_path").isNotNull())
    return paths.select(F.explode(graph.ancestor_prefixes(F.col("rel_path"))).alias("id")).distinct()


# ---- hierarchy: regions, nations and suppliers stand for areas, subareas and modules

_MODULES = "modules AS (SELECT s_name AS module, n_name AS subarea, r_name AS area, CASE s_suppkey % 3 WHEN 0 THEN 'crew' || s_nationkey WHEN 1 THEN 'wing' || n_regionkey ELSE 'solo' || s_suppkey END AS owner, 'repo/' || (s_suppkey % 40) AS repo FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _modules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = data.read(spark, d, "nation").join(data.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = data.read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda word, c: F.concat(F.lit(word), c.cast("string"))
    owner = F.when(F.col("s_suppkey") % 3 == 0, name("crew", F.col("s_nationkey"))).when(F.col("s_suppkey") % 3 == 1, name("wing", F.col("n_regionkey"))).otherwise(name("solo", F.col("s_suppkey")))
    modules = s.select(F.col("s_name").alias("module"), F.col("n_name").alias("subarea"), F.col("r_name").alias("area"), owner.alias("owner"), F.concat(F.lit("repo/"), (F.col("s_suppkey") % 40).cast("string")).alias("repo"))
    return modules, n.select(F.col("n_name").alias("subarea"), F.col("r_name").alias("area"))


_FOOT = """foot AS (SELECT * FROM (SELECT owner, CASE WHEN n = 1 THEN m END AS module, CASE WHEN n > 1 AND s = 1 THEN ms END AS subarea, CASE WHEN n > 1 AND s <> 1 AND a = 1 THEN ma END AS area
    FROM (SELECT owner, count(*) AS n, min(module) AS m, count(DISTINCT subarea) AS s, min(subarea) AS ms, count(DISTINCT area) AS a, min(area) AS ma FROM modules WHERE owner IS NOT NULL GROUP BY owner)) WHERE module IS NOT NULL OR subarea IS NOT NULL OR area IS NOT NULL)"""


@query(f"WITH {_MODULES}, {_FOOT} SELECT * FROM foot")
def owner_footprint(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.owner_footprint(_modules(spark, d)[0])


_PLACE_RULES = [{"match": {"segment": "BUILD*"}, "set": {"area": "ASIA"}}, {"match": {"segment": ["MACH*", "AUTO*"], "name": "*1"}, "set": {"subarea": "FRANCE"}}]


@query(
    f"""WITH {_MODULES}, {_FOOT}, rep AS (SELECT lower(repo) AS repo, min(module) AS repo_module FROM modules GROUP BY 1),
    doc AS (SELECT c_name AS source_id, CASE WHEN c_custkey % 50 = 0 THEN 'Supplier#' || lpad((c_custkey % 100)::VARCHAR, 9, '0') END AS stamped, CASE WHEN c_custkey % 9 = 0 THEN 'REPO/' || (c_custkey % 80) END AS repo,
        CASE c_custkey % 3 WHEN 0 THEN 'crew' || (c_custkey % 26) WHEN 1 THEN 'wing' || (c_custkey % 6) ELSE 'solo' || (c_custkey % 100) END AS owner, c_mktsegment AS segment FROM customer),
    j AS (SELECT d.*, r.repo_module, f.module AS om, f.subarea AS os, f.area AS oa, CASE WHEN regexp_matches(segment, '(?i)^BUILD.*$') THEN 'ASIA' END AS ra,
        CASE WHEN NOT regexp_matches(segment, '(?i)^BUILD.*$') AND regexp_matches(segment, '(?i)^(MACH|AUTO).*$') AND regexp_matches(source_id, '1$') THEN 'FRANCE' END AS rs
        FROM doc d LEFT JOIN rep r ON lower(d.repo) = r.repo LEFT JOIN foot f ON d.owner = f.owner),
    v AS (SELECT *, CASE WHEN rs IS NOT NULL THEN 2 WHEN ra IS NOT NULL THEN 1 ELSE 0 END AS rsp, CASE WHEN om IS NOT NULL THEN 3 WHEN os IS NOT NULL THEN 2 WHEN oa IS NOT NULL THEN 1 ELSE 0 END AS osp FROM j),
    p AS (SELECT source_id, CASE WHEN stamped IS NOT NULL THEN 'stamp' WHEN repo_module IS NOT NULL THEN 'repo' WHEN rsp > 0 AND rsp >= osp THEN 'rule' WHEN osp > 0 THEN 'owner' ELSE 'none' END AS via, * EXCLUDE (source_id) FROM v),
    f AS (SELECT source_id, via, coalesce(stamped, repo_module, CASE via WHEN 'owner' THEN om END) AS module, CASE via WHEN 'rule' THEN rs WHEN 'owner' THEN os END AS subarea, CASE via WHEN 'rule' THEN ra WHEN 'owner' THEN oa END AS area FROM p),
    g AS (SELECT f.source_id, f.via, f.module, coalesce(f.subarea, m.subarea) AS subarea, coalesce(f.area, m.area) AS area FROM f LEFT JOIN modules m ON f.module = m.module)
    SELECT g.source_id, via, module, g.subarea, coalesce(g.area, r_name) AS area FROM g LEFT JOIN nation ON g.subarea = n_name LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def place_documents(spark: SparkSession, d: str) -> DataFrame:
    modules, areas = _modules(spark, d)
    k = F.col("c_custkey")
    docs = data.read(spark, d, "customer").select(
        F.col("c_name").alias("source_id"),
        F.when(k % 50 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 100).cast("string"), 9, "0"))).alias("stamped_module"),
        F.when(k % 9 == 0, F.concat(F.lit("REPO/"), (k % 80).cast("string"))).alias("repo"),
        F.when(k % 3 == 0, F.concat(F.lit("crew"), (k % 26).cast("string"))).when(k % 3 == 1, F.concat(F.lit("wing"), (k % 6).cast("string"))).otherwise(F.concat(F.lit("solo"), (k % 100).cast("string"))).alias("owner"),
        F.col("c_mktsegment").alias("segment"),
    )
    return hierarchy.place_documents(docs, modules, areas, _PLACE_RULES, {"segment": F.col("segment"), "name": F.col("source_id")})


@query(f"WITH {CHUNKS}, p AS (SELECT source_type, string_split(rel_path, '/') AS p FROM ch WHERE rel_path IS NOT NULL), f AS (SELECT source_type, array_to_string(p[1:least(greatest(len(p) - 1, 0), 2)], '/') AS folder, count(*) AS n FROM p GROUP BY 1, 2) SELECT source_type, folder, n, row_number() OVER (PARTITION BY source_type ORDER BY n DESC, folder) AS rank FROM f WHERE folder <> '' QUALIFY rank <= 5")
def top_folders(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.top_folders(data.chunks(spark, d, "source_type", "rel_path").where(F.col("rel_path").isNotNull()), "source_type", "rel_path")


# ---- map


def _centroids(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("label").alias("cluster")).agg(F.min_by("vector", "id").alias("center"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return data.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(
    """WITH c AS (SELECT label AS cluster, arg_min(embedding, vec_id) AS center FROM embeddings GROUP BY label),
    s AS (SELECT vec_id AS id, cluster, round(list_cosine_similarity(embedding::DOUBLE[], center::DOUBLE[]), 6) AS similarity FROM embeddings, c)
    SELECT id, cluster, similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, cluster) = 1"""
)
def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return mapping.assign_clusters(e, _centroids(e), 64)


@query()
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    centers = mapping.fit_clusters(e, 10, 64)
    c = spark.createDataFrame([(i, x) for i, x in enumerate(centers)], "cluster int, center array<double>")
    return mapping.assign_clusters(e, c, 64).groupBy("cluster").agg(F.count("*").alias("n"))


_STOP = ["the", "and", "del", "della", "delle", "dei", "degli", "des", "les", "der", "die", "das", "los", "las"]


@query(
    f"""WITH r AS (SELECT lower(trim(source)) AS grp, doc_id AS key, title AS text FROM documents WHERE source IS NOT NULL AND title IS NOT NULL),
    w AS (SELECT grp, key, unnest(list_distinct(list_filter(regexp_split_to_array({fold("regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')")}, '[^a-z0-9]+'),
        lambda t: length(t) BETWEEN 3 AND 24 AND NOT list_contains([{', '.join(q(x) for x in _STOP)}], t) AND NOT regexp_matches(t, '^\\d+$') AND NOT (length(t) > 4 AND regexp_matches(t, '\\d[a-z]'))
        AND NOT (length(t) > 5 AND regexp_matches(t, '[bcdfghjklmnpqrstvwxz]{{4}}')) AND NOT regexp_matches(t, '^[a-z]{{1,2}}\\d+$')))) AS term FROM r),
    f AS (SELECT grp, term, count(DISTINCT key) AS f FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1), g AS (SELECT count(DISTINCT grp) AS g FROM r)
    SELECT grp, term, f, df, round((1 + ln(f)) * ln((g + 1) / (df + 0.5)), 6) AS score FROM f JOIN df USING (term), g"""
)
def tfidf_names(spark: SparkSession, d: str) -> DataFrame:
    return mapping.name_scores(_titled(spark, d), _STOP)


def _titled(spark: SparkSession, d: str) -> DataFrame:
    docs = data.read(spark, d, "documents").where(F.col("source").isNotNull() & F.col("title").isNotNull())
    return docs.select(F.lower(F.trim("source")).alias("grp"), F.col("doc_id").alias("key"), F.col("title").alias("text"))


@query()
def group_names(spark: SparkSession, d: str) -> DataFrame:
    return mapping.name_groups(mapping.name_scores(_titled(spark, d), _STOP))


@query(
    f"""WITH w AS (SELECT unnest(regexp_split_to_array(regexp_replace(regexp_replace(title, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+')) AS spelling FROM documents WHERE title IS NOT NULL),
    n AS (SELECT spelling, {fold('spelling')} AS word, count(*) AS n FROM w WHERE spelling <> '' GROUP BY 1, 2)
    SELECT word, spelling, (sum(n) OVER (PARTITION BY word))::BIGINT AS uses FROM n QUALIFY row_number() OVER (PARTITION BY word ORDER BY n * 10 + CASE WHEN regexp_matches(spelling, '[A-Z]') THEN 1 ELSE 0 END DESC, spelling) = 1"""
)
def common_spellings(spark: SparkSession, d: str) -> DataFrame:
    return mapping.common_spelling(data.read(spark, d, "documents").where(F.col("title").isNotNull()), "title")


@query(
    """WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
    c AS (SELECT least(13, floor((x - x0) / ((x1 - x0) / 14)))::INT AS cx, least(13, floor((y - y0) / ((y1 - y0) / 14)))::INT AS cy, x, y FROM p, b)
    SELECT cx, cy, count(*) AS n, floor(avg(x) * 1000 + 0.5) / 1000 AS x, floor(avg(y) * 1000 + 0.5) / 1000 AS y FROM c GROUP BY 1, 2 HAVING count(*) >= 5"""
)
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d).select(F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"))
    return mapping.grid_cells(e, 14, 5)


@query()
def pca_map(spark: SparkSession, d: str) -> DataFrame:
    return mapping.plane(_embeddings(spark, d), 64)


# ---- event logs

_RATE = "RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW"


@query(f"SELECT event_id, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts {_RATE})")
def event_rate_window(spark: SparkSession, d: str) -> DataFrame:
    return events.sliding_rate(data.read(spark, d, "events"), "user_id", "ts", "value", 30 * 60)


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_facets(spark: SparkSession, d: str) -> DataFrame:
    return data.read(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(data.read(spark, d, "events"), "user_id", "ts", "2 hours")


@query("SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def event_fields(spark: SparkSession, d: str) -> DataFrame:
    return data.read(spark, d, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


_TURNS = "turns AS (SELECT user_id AS conv_id, event_id AS turn, CASE event_type WHEN 'view' THEN 'user' WHEN 'error' THEN 'system' ELSE 'assistant' END AS role, event_type || ' ' || props AS text FROM events)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """The event log read as conversations: a user's events are turns."""
    role = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "error", "system").otherwise("assistant")
    return data.read(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.concat_ws(" ", "event_type", "props").alias("text"))


@query(f"WITH {_TURNS} SELECT conv_id, arg_max(text, turn) AS question, max(turn) AS turn FROM turns WHERE role = 'user' GROUP BY conv_id")
def chat_last_question(spark: SparkSession, d: str) -> DataFrame:
    return answers.last_question(_turns(spark, d))


@query(f"WITH {_TURNS} SELECT * FROM turns WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def chat_history_window(spark: SparkSession, d: str) -> DataFrame:
    return answers.history_window(_turns(spark, d), 6)


@query(
    """WITH RECURSIVE once AS (SELECT user_id AS conv, event_type || ' ' || props AS chunk_id, max((CASE WHEN event_type = 'click' THEN 1 ELSE 0 END, event_id, floor(value * 100)::BIGINT)) AS b FROM events GROUP BY 1, 2),
    o AS (SELECT conv, chunk_id, b[2] AS n, b[3] AS size, row_number() OVER (PARTITION BY conv ORDER BY b[1] DESC, b[2] DESC, chunk_id) AS i FROM once),
    f AS (SELECT conv, i, CASE WHEN size <= 24000 THEN size ELSE 0 END AS used, CASE WHEN size <= 24000 THEN 1 ELSE 0 END AS kept, size <= 24000 AS took FROM o WHERE i = 1
        UNION ALL SELECT o.conv, o.i, CASE WHEN f.used + o.size <= 24000 AND f.kept < 24 THEN f.used + o.size ELSE f.used END, CASE WHEN f.used + o.size <= 24000 AND f.kept < 24 THEN f.kept + 1 ELSE f.kept END, f.used + o.size <= 24000 AND f.kept < 24 FROM f JOIN o ON o.conv = f.conv AND o.i = f.i + 1)
    SELECT o.conv, o.n, o.chunk_id, o.size FROM f JOIN o USING (conv, i) WHERE took"""
)
def carry_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = data.read(spark, d, "events").select(F.col("user_id").alias("conv"), F.concat_ws(" ", "event_type", "props").alias("chunk_id"), F.col("event_id").alias("n"), F.floor(F.col("value") * 100).alias("size"), (F.col("event_type") == "click").alias("cited"))
    return answers.carry_blocks(blocks)


@query("SELECT event_id, source, reason, extra['owner'] AS owner, received_at > emitted_at + INTERVAL 1 HOUR AS late FROM sync_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, source, reason) = 1")
def sync_log(spark: SparkSession, d: str) -> DataFrame:
    """The sync log, each event once, with the late ones marked."""
    ev = data.read(spark, d, "sync_events")
    first = F.row_number().over(W.partitionBy("event_id").orderBy("received_at", F.asc_nulls_last("source"), F.asc_nulls_last("reason")))
    once = ev.withColumn("_n", first).where(F.col("_n") == 1)
    return once.select("event_id", "source", "reason", F.col("extra")["owner"].alias("owner"), (F.col("received_at") > F.col("emitted_at") + F.expr("INTERVAL 1 HOUR")).alias("late"))


# ---- catalogs and scalars


@query(
    f"""WITH {CHUNKS}, p AS (SELECT string_split(rel_path, '/') AS p, count(*) AS n FROM ch WHERE rel_path IS NOT NULL GROUP BY 1)
    SELECT array_to_string(p[1:least(CASE p[1] WHEN 'gitlab' THEN 3 WHEN 'confluence' THEN 2 ELSE 1 END, greatest(len(p) - 1, 1))], '/') AS grp, sum(n)::BIGINT AS n FROM p GROUP BY 1"""
)
def path_groups(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "rel_path").where(F.col("rel_path").isNotNull())
    return ch.groupBy(scalars.path_group(F.col("rel_path")).alias("grp")).agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS}, d AS (SELECT nullif(regexp_extract(trim(last_modified), '^(\\d{{4}}(?:-\\d{{2}}(?:-\\d{{2}})?)?)(?:$|T)', 1), '') AS day FROM ch) SELECT day, count(*) AS n FROM d GROUP BY day")
def date_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return data.chunks(spark, d, "last_modified").groupBy(scalars.date_prefix(F.col("last_modified")).alias("day")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {PAGES}, r AS (SELECT source_url AS u FROM kb WHERE source_url IS NOT NULL), p AS (SELECT lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^https?://[^/?#]+/+([^?#]*)', 1), '/(?:-|blob|tree|raw|commits)(?:/.*)?$', ''), '\\.git$', ''), '/+$', '')) AS p,
    lower(regexp_extract(trim(u), '^https?://([^/?#]+)', 1)) AS h FROM r) SELECT p AS repo, count(*) AS n FROM p WHERE contains(p, '/') AND h = 'git.tarnfield.example' GROUP BY p"""
)
def repositories_of_pages(spark: SparkSession, d: str) -> DataFrame:
    kb = data.pages(spark, d, "source_url").where(F.col("source_url").isNotNull())
    repo = scalars.repository_of(F.col("source_url"), "git.tarnfield.example")
    return kb.select(repo.alias("repo")).where(F.col("repo").isNotNull()).groupBy("repo").agg(F.count("*").alias("n"))


@query(
    f"""WITH {PAGES}, f AS (SELECT source_id, split_part(rel_path, '/', 1) || '/all.md' AS rel_path, source_id AS seq FROM kb WHERE rel_path IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY seq, source_id) AS c, regexp_replace(translate(base64(source_id::BLOB), '+/', '-_'), '=', '', 'g') AS b FROM f)
    SELECT source_id, CASE WHEN c = 1 THEN rel_path ELSE regexp_replace(rel_path, '\\.md$', '') || '-' || right(b, 6) || '.md' END AS rel_path FROM n"""
)
def path_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Pages that all claim one file of their source's folder."""
    kb = data.pages(spark, d, "rel_path").where(F.col("rel_path").isNotNull())
    return catalog.free_paths(kb.select("source_id", F.concat(F.split_part("rel_path", F.lit("/"), F.lit(1)), F.lit("/all.md")).alias("rel_path"), F.col("source_id").alias("seq")))


@query(
    f"""WITH {CHUNKS}, s AS (SELECT source_type, coalesce(lang, '(none)') AS language, sum(length(content))::BIGINT AS s FROM ch GROUP BY 1, 2)
    SELECT source_type, language, round(100 * s / sum(s) OVER (PARTITION BY source_type), 1) AS percent, row_number() OVER (PARTITION BY source_type ORDER BY s DESC, language) AS rank FROM s QUALIFY rank <= 6"""
)
def language_shares(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "source_type", "lang", "content").select("source_type", F.coalesce("lang", F.lit("(none)")).alias("lang"), F.length("content").alias("n"))
    return catalog.language_shares(ch, "source_type", "lang", "n")


@query(
    f"""WITH RECURSIVE {_FOLDERS}, w AS (SELECT id, parent AS ancestor, 1 AS depth FROM par UNION ALL SELECT w.id, p.parent, depth + 1 FROM w JOIN par p ON w.ancestor = p.id WHERE depth < 100),
    roots AS (SELECT id FROM f WHERE regexp_matches(id, '(?i)^.*/docs$')) SELECT id FROM roots UNION SELECT id FROM w WHERE ancestor IN (SELECT id FROM roots)"""
)
def tree_exclusion(spark: SparkSession, d: str) -> DataFrame:
    folders = ancestor_prefixes(spark, d)
    return catalog.excluded_by_tree(folders.withColumn("title", F.col("id")), ancestor_chain(spark, d), [], ["*/docs"])
