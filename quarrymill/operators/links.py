"""Links of markdown bodies, and the documents they lead to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Why a link leads to no document, whether that is a fault of the documents, and what it means.
REASONS = (
    ("unparsable", False, "not a link to a document"),
    ("external", False, "another site"),
    ("portal-page", True, "portal page that is not indexed"),
    ("portal-other", False, "portal address that is no page"),
    ("wiki-page", True, "wiki page that is not indexed"),
    ("wiki-tiny", False, "short wiki link without a page id"),
    ("wiki-other", False, "wiki address that is no page"),
    ("repo-file", True, "file of an indexed repository that is not indexed"),
    ("repo-unknown", False, "repository outside the collection"),
    ("repo-other", False, "repository address that is neither file nor root"),
    ("relative-target", True, "relative link whose target is not indexed"),
    ("relative-outside", True, "relative link that climbs out of its repository"),
    ("relative-unsupported", False, "relative link in a source without paths"),
)


@dataclass(frozen=True)
class Hosts:
    portal: list[str]
    wiki: list[str]
    repository: list[str]
    wiki_suffix: str = r"\.atlassian\.net$"  # hosted wikis
    page: str = r"/pages/(\d+)"  # where a wiki's address names its page


def extract_links(docs: DataFrame, key: str = "source_id", body: str = "body") -> DataFrame:
    """``key, pos, href, text``: markdown links that are no images, then bare ``<https://…>`` links, in order."""
    md = F.regexp_extract_all(F.col(body), F.lit(r"(!?\[[^\]]*\]\(\s*[^)\s]+(?:\s+\"[^\"]*\")?\s*\))"), F.lit(1))
    md = F.filter(md, lambda m: ~F.startswith(m, F.lit("!")))
    href = lambda m: F.regexp_extract(m, r"\]\(\s*([^)\s]+)", 1)
    label = lambda m: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(m, r"^\[([^\]]*)\]", 1), r"[*_`]", "")), F.lit(""))
    found = F.transform(md, lambda m: F.struct(href(m).alias("href"), label(m).alias("text")))
    auto = F.transform(F.regexp_extract_all(F.col(body), F.lit(r"<(https?://[^>\s]+)>"), F.lit(1)), lambda m: F.struct(m.alias("href"), F.lit(None).cast("string").alias("text")))
    return docs.select(key, F.posexplode(F.concat(found, auto)).alias("pos", "l")).select(key, "pos", "l.href", "l.text")


def normal_path(path: Column) -> Column:
    """A posix path without ``.``, ``..`` and empty parts; one that climbs out begins with ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when((p == "..") & can_pop, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def lookup_keys(docs: DataFrame, key: str = "source_id") -> DataFrame:
    """``lookup, id``: every key under which a document can be named by a link, in lower case.

    Pages by the number at the end of their id, portal pages by path, files by project and path.
    """
    k = F.col(key)
    page = F.regexp_extract(k, r"^[^:]+:.*[:/](\d+)$", 1)
    portal = F.lower(F.regexp_replace(F.regexp_replace(k, "^devportal:", ""), "/+$", ""))
    file = F.lower(F.regexp_replace(k, "^(gitlab|adr):", ""))
    rows = F.array(
        F.when(k.startswith("confluence:") & (page != ""), F.concat(F.lit("page:"), page)),
        F.when(k.startswith("devportal:"), F.concat(F.lit("portal:"), portal)),
        F.when(k.rlike("^(gitlab|adr):"), F.concat(F.lit("file:"), file)),
    )
    keyed = docs.select(k.alias("id"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("lookup"))
    return keyed.groupBy("lookup").agg(F.min("id").alias("id"))


def resolve_links(links: DataFrame, docs: DataFrame, hosts: Hosts, key: str = "source_id") -> DataFrame:
    """``links`` with ``target`` (a document) or ``reason`` (see ``REASONS``).

    Each link has up to four lookup keys in order of preference; one equi-join finds them all and the first
    that names a document wins.
    """
    href = F.trim(F.regexp_replace("href", r"^<|>$", ""))
    raw = links.withColumn("_h", href)
    scheme = F.lower(F.regexp_extract("_h", r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    absolute = F.col("_h").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")
    bad = (F.col("_h") == "") | F.col("_h").startswith("#") | ((scheme != "") & ~absolute)
    host = F.lower(F.regexp_extract("_h", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)", 1))
    path_raw = F.regexp_extract("_h", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.coalesce(F.try_url_decode(F.regexp_replace(path_raw, r"\+", "%2B")), path_raw)
    k = F.col(key)
    self_path = F.regexp_replace(k, r"^[^:]+:", "")
    in_file, in_portal = k.rlike("^(gitlab|adr):"), k.startswith("devportal:")
    project, file = F.regexp_extract(self_path, r"^(.*):[^:]*$", 1), F.regexp_extract(self_path, r"([^:]*)$", 1)
    target = F.regexp_replace("_h", r"[#?].*$", "")
    folder = F.regexp_replace(file, r"[^/]*$", "")
    joined = normal_path(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target)))
    portal_self = F.regexp_replace(self_path, "/+$", "")
    portal_abs = normal_path(F.regexp_replace(target, "^/docs/", ""))
    portal_a = F.when(target.startswith("/"), portal_abs).otherwise(normal_path(F.concat(portal_self, F.lit("/"), target)))
    portal_b = F.when(target.startswith("/"), portal_abs).otherwise(normal_path(F.concat(F.regexp_replace(portal_self, r"[^/]*$", ""), target)))

    def portal_keys(p: Column) -> list[Column]:
        plain = F.regexp_replace(F.lower(F.regexp_replace(p, "^/+|/+$", "")), "^docs/", "")
        no_ext = F.regexp_replace(plain, r"\.(md|markdown)$", "")
        return [F.concat(F.lit("portal:"), x) for x in (plain, no_ext, F.regexp_replace(no_ext, "/?index$", ""))]

    def file_keys(proj: Column, f: Column) -> list[Column]:
        base = F.lower(F.concat(F.lit("file:"), proj, F.lit(":"), F.regexp_replace(f, r"^\.?/", "")))
        return [base, F.concat(base, F.lit(".md")), F.concat(F.regexp_replace(base, "/$", ""), F.lit("/readme.md"))]

    blob_project = F.regexp_extract(path, r"^/(.+?)/-/(?:blob|raw)/[^/]+/", 1)
    blob_file = F.regexp_extract(path, r"^/.+?/-/(?:blob|raw)/[^/]+/(.*)$", 1)
    root_project = F.regexp_replace(path, "^/|/$", "")
    page = F.regexp_extract(path, hosts.page, 1)
    none = F.array().cast("array<string>")
    is_portal, is_wiki, is_repo = host.isin(hosts.portal), host.isin(hosts.wiki) | host.rlike(hosts.wiki_suffix), host.isin(hosts.repository)
    keys = (
        F.when(bad, none)
        .when(absolute & is_wiki & (page != ""), F.array(F.concat(F.lit("page:"), page)))
        .when(absolute & is_portal, F.array(*portal_keys(path)))
        .when(absolute & is_repo & (blob_project != ""), F.array(*file_keys(blob_project, blob_file)))
        .when(absolute & is_repo, F.array(F.lower(F.concat(F.lit("file:"), root_project, F.lit(":__project")))))
        .when(absolute, none)
        .when(in_file & ~joined.startswith(".."), F.array(*file_keys(project, joined)))
        .when(in_portal, F.array(*portal_keys(portal_a), *portal_keys(portal_b)))
        .otherwise(none)
    )
    reason = (
        F.when(bad, "unparsable")
        .when(absolute & is_wiki, F.when(page != "", "wiki-page").when(path.rlike("/wiki/x/"), "wiki-tiny").otherwise("wiki-other"))
        .when(absolute & is_portal, F.when(path.rlike("^/docs/."), "portal-page").otherwise("portal-other"))
        .when(absolute & is_repo, F.when(blob_project != "", "repo-file").otherwise("repo-other"))
        .when(absolute, "external")
        .when(in_file, F.when(joined.startswith(".."), "relative-outside").when(F.lower(joined).rlike(r"\.(md|markdown|ya?ml|json)$"), "relative-target").otherwise("relative-unsupported"))
        .when(in_portal, F.when(portal_a.startswith("..") & portal_b.startswith(".."), "relative-outside").when(F.lower(target).rlike(r"\.(png|jpe?g|gif|svg|webp|pdf|zip)$"), "relative-unsupported").otherwise("portal-page"))
        .otherwise("relative-unsupported")
    )
    blob_key = F.when(absolute & is_repo, F.lower(F.when(blob_project != "", blob_project).otherwise(F.regexp_replace(root_project, "/-/.*$", ""))))
    prepared = raw.withColumns({"_keys": keys, "_reason": reason, "_project": blob_key}).drop("_h")
    wanted = prepared.select(key, "pos", F.posexplode("_keys").alias("_k", "lookup"))
    hit = wanted.join(lookup_keys(docs, key), "lookup").groupBy(key, "pos").agg(F.min_by("id", "_k").alias("target"))
    projects = docs.where(k.rlike("^(gitlab|adr):")).select(F.lower(F.regexp_extract(F.regexp_replace(k, r"^[^:]+:", ""), r"^(.*):[^:]*$", 1)).alias("_project")).distinct().withColumn("_known", F.lit(True))
    out = prepared.join(hit, [key, "pos"], "left").join(projects, "_project", "left")
    final = F.when(F.col("target").isNotNull(), None).when(F.col("_project").isNotNull() & F.col("_known").isNull(), "repo-unknown").otherwise(F.col("_reason"))
    return out.select(*links.columns, "target", final.alias("reason"))


def id_from_url(url: Column) -> Column:
    """The lookup key that a page's own address gives, or null."""
    page = F.regexp_extract(url, r"/(?:pages|view|docs)/(\d+)", 1)
    blob = F.regexp_extract(url, r"^https?://[^/]+/(.+?)/-/(?:blob|raw)/[^/]+/", 1)
    file = F.regexp_extract(url, r"/-/(?:blob|raw)/[^/]+/([^?#]*)", 1)
    return F.when(blob != "", F.lower(F.concat(F.lit("file:"), blob, F.lit(":"), file))).when(page != "", F.concat(F.lit("page:"), page))


def canonical_url(url: Column) -> Column:
    """Host in lower case; no port, query, fragment or closing slash."""
    host = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://[^/:?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(host != "", F.concat(host, path))


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") == 1).drop("_rn")
