"""The property graph of documents and hubs: edges, neighbours, components, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import shared_folder
from . import links


def team_key(owner: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(owner, "(?i)^(group|user):", ""), "^(?i)default/", "")))


def ancestor_prefixes(path: Column) -> Column:
    """Every prefix of a ``/``-separated chain, the shortest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def meta(name: str) -> Column:
    """A value of the frontmatter, null when blank."""
    return F.nullif(F.trim(F.col("frontmatter")[name]), F.lit(""))


def meta_list(name: str) -> Column:
    """The values of a list in the frontmatter: a JSON array, or values between commas or semicolons."""
    value = meta(name)
    parts = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.split(value, "[,;]"))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def hub_edges(docs: DataFrame, key: str = "source_id", places: DataFrame | None = None) -> DataFrame:
    """``src, dst, relation, label`` from documents' metadata (``frontmatter``, ``rel_path``) to hubs.

    Spaces, repositories, owners, entities, tags (lower case), every prefix of the ancestor chain in a space and every folder on
    the path; one projection, one explode.  ``places`` (``key``, area, subarea, module) adds the hierarchy's levels.
    """
    edge = lambda ok, dst, rel, label: F.when(ok.isNotNull(), F.struct(dst.alias("dst"), F.lit(rel).alias("relation"), label.alias("label")))
    hub = lambda kind, name, rel, label: edge(name, F.concat(F.lit(f"{kind}:"), name), rel, label)
    folders = F.transform(ancestor_prefixes(F.regexp_replace(F.coalesce("rel_path", F.lit("")), r"/?[^/]*$", "")), lambda p: hub("tree", p, "under", p))
    tags = F.transform(F.array_distinct(F.transform(meta_list("tags"), F.lower)), lambda t: hub("tag", t, "tagged", t))
    chain = F.when(meta("space").isNotNull(), meta_list("ancestors")).otherwise(F.array().cast("array<string>"))
    above = F.transform(chain, lambda _, i: F.slice(chain, F.lit(1), i + 1))
    above = F.transform(above, lambda c: edge(F.lit(1), F.concat(F.lit("tree:"), meta("space"), F.lit("/"), F.array_join(c, "/")), "under", F.array_join(c, " › ")))
    fixed = F.array(
        hub("space", meta("space"), "in_space", F.coalesce(meta("space_name"), meta("space"))),
        hub("repo", meta("project"), "in_repo", F.coalesce(meta("project_name"), meta("project"))),
        edge(meta("owner"), F.concat(F.lit("team:"), team_key(meta("owner"))), "owned_by", meta("owner")),
        hub("entity", meta("entity"), "about_entity", F.coalesce(meta("entity_title"), meta("entity_name"), meta("entity"))),
    )
    rows = docs.select(F.col(key).alias("src"), F.explode(F.concat(F.filter(fixed, lambda x: x.isNotNull()), tags, above, folders)).alias("e"))
    out = rows.select("src", "e.dst", "e.relation", "e.label")
    if places is None:
        return out
    levels = F.filter(F.array(*[hub(n, F.col(n), f"in_{n}", F.col(n)) for n in ("area", "subarea", "module")]), lambda x: x.isNotNull())
    return out.unionByName(places.select(F.col(key).alias("src"), F.explode(levels).alias("e")).select("src", "e.dst", "e.relation", "e.label"))


def document_references(docs: DataFrame, hosts: links.Hosts, key: str = "source_id") -> DataFrame:
    """Every reference of documents to documents: ``key, pos, href, text, relation, place, target, reason``.

    ``docs`` has ``key, kind, frontmatter, body``.  From the body (``place`` body): ``links_to``.  From the frontmatter:
    ``child_of`` (parent_id of a page in a space), ``described_by`` (the card of a project), ``documents`` (a card's
    techdocs_ref), ``related_wiki`` (confluence_pages).  ``target`` is null where it is not in the collection, with the reason.
    """
    text = F.lit(None).cast("string")
    ref = lambda pos, href, rel: F.struct(pos.alias("pos"), href.alias("href"), F.lit(rel).alias("relation"))
    card = F.when((F.lower("kind") == "project") & meta("techdocs_ref").isNotNull(), ref(F.lit(-1), meta("techdocs_ref"), "documents"))
    wiki = F.transform(meta_list("confluence_pages"), lambda u, i: ref(-2 - i, u, "related_wiki"))
    urls = docs.select(key, F.explode(F.concat(F.filter(F.array(card), lambda x: x.isNotNull()), wiki)).alias("r"))
    urls = urls.select(key, "r.pos", "r.href", text.alias("text"), "r.relation", F.lit("frontmatter").alias("place"))
    body = links.extract_links(docs, key).withColumns({"relation": F.lit("links_to"), "place": F.lit("body")})
    found = links.resolve_links(body.unionByName(urls), docs.select(key), hosts, key)
    parent = F.when(meta("space").isNotNull() & meta("parent_id").isNotNull(), F.struct(F.concat(F.lit("page:"), meta("parent_id")).alias("lookup"), F.concat(F.lit("parent_id:"), meta("parent_id")).alias("href"), F.lit("child_of").alias("relation"), F.lit("wiki-page").alias("reason")))
    project = F.when(meta("project").isNotNull(), F.struct(F.lower(F.concat(F.lit("file:"), meta("project"), F.lit(":__project"))).alias("lookup"), F.concat(F.lit("project:"), meta("project")).alias("href"), F.lit("described_by").alias("relation"), F.lit(None).cast("string").alias("reason")))
    keyed = docs.select(key, F.explode(F.filter(F.array(parent, project), lambda x: x.isNotNull())).alias("r")).select(key, "r.*")
    known = links.lookup_keys(docs, key).withColumnRenamed("id", "target")
    keyed = keyed.join(known, "lookup", "left").where(F.col("target").isNotNull() | F.col("reason").isNotNull())  # a project without a card is no gap
    return found.unionByName(keyed.select(key, F.lit(None).cast("int").alias("pos"), "href", text.alias("text"), "relation", F.lit("frontmatter").alias("place"), "target", F.when(F.col("target").isNull(), F.col("reason")).alias("reason")))


def document_edges(references: DataFrame, key: str = "source_id") -> DataFrame:
    """``src, dst, relation``: each resolved reference once, without loops."""
    return references.where(F.col("target").isNotNull() & (F.col("target") != F.col(key))).select(F.col(key).alias("src"), F.col("target").alias("dst"), "relation").distinct()


def reference_gaps(references: DataFrame) -> DataFrame:
    """``place, reason, n``: references without a target.  Those of the frontmatter are decisions about scope, those of bodies dangle."""
    return references.where(F.col("target").isNull() & (F.col("reason") != "unparsable")).groupBy("place", "reason").agg(F.count("*").alias("n"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each (src, dst, relation) once, without loops."""
    return edges.where(F.col("src") != F.col("dst")).groupBy("src", "dst", "relation").agg(F.min("label").alias("label")) if "label" in edges.columns else edges.where(F.col("src") != F.col("dst")).select("src", "dst", "relation").distinct()


def nodes(docs: DataFrame, edges: DataFrame, key: str = "source_id", title: str = "title") -> DataFrame:
    """``id, type, label``: documents, then hubs; a hub that is itself a document is a document."""
    own = docs.select(F.col(key).alias("id"), F.lit("doc").alias("type"), F.coalesce(F.col(title), F.col(key)).alias("label"), F.lit(0).alias("_p"))
    hubs = edges.select(F.col("dst").alias("id"), F.regexp_extract("dst", "^([a-z]+):", 1).alias("type"), "label", F.lit(1).alias("_p"))
    return own.unionByName(hubs).groupBy("id").agg(F.min(F.struct("_p", "label", "type")).alias("n")).select("id", "n.type", "n.label")


def hub_sizes(edges: DataFrame) -> DataFrame:
    """``hub, relation, size``: members of each hub, pre-aggregated in the map, so a hub with a third of all documents is no hot task."""
    return edges.select("src", F.col("dst").alias("hub"), "relation").distinct().groupBy("hub", "relation").agg(F.count("*").alias("size"))


def neighbours(doc_edges: DataFrame, hub_edges_: DataFrame, of: DataFrame, max_hub: int = V.MAX_HUB, limit: int | None = V.RELATED_LIMIT) -> DataFrame:
    """``src, dst, relation, direction, via, weight, rank`` for the documents of ``of`` (``id``).

    Direct edges by relation (incoming a little less), and documents that share a hub of at most ``max_hub``
    members.  A target keeps its greatest weight; ties: outgoing, incoming, sibling, then the smaller hub.
    Hubs are cut by size before the self-join, so it is bounded by ``max_hub`` rows a member.
    """
    w = F.lit(V.OTHER_RELATION_WEIGHT)
    for name, x in V.RELATION_WEIGHTS.items():
        w = F.when(F.col("relation") == name, x).otherwise(w)
    ids = of.select(F.col("id").alias("src"))
    null = F.lit(None).cast("string")
    out = doc_edges.join(ids, "src", "left_semi").select("src", "dst", "relation", F.lit("out").alias("direction"), null.alias("via"), w.alias("weight"), F.lit(0).alias("_b"), F.lit(0).cast("long").alias("_s"))
    back = doc_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation").join(ids, "src", "left_semi")
    inc = back.select("src", "dst", "relation", F.lit("in").alias("direction"), null.alias("via"), (w - V.INCOMING_PENALTY).alias("weight"), F.lit(1).alias("_b"), F.lit(0).cast("long").alias("_s"))
    small = hub_sizes(hub_edges_).where((F.col("size") <= max_hub) & (F.col("size") > 1))
    member = hub_edges_.select("src", F.col("dst").alias("hub"), "relation").distinct().join(small, ["hub", "relation"])
    sib = member.join(ids, "src", "left_semi").join(member.select(F.col("src").alias("dst"), "hub", "relation"), ["hub", "relation"]).where(F.col("src") != F.col("dst"))
    share = 0.6 / F.log2(F.greatest(F.col("size"), F.lit(2)) + 2)
    sib = sib.select("src", "dst", "relation", F.lit("sibling").alias("direction"), F.col("hub").alias("via"), share.alias("weight"), F.lit(2).alias("_b"), F.col("size").alias("_s"))
    every = reduce(DataFrame.unionByName, [out, inc, sib]).withColumn("weight", F.round("weight", 6))
    best = F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc("weight"), "_b", "_s", "relation", "via"))
    kept = every.withColumn("_r", best).where(F.col("_r") == 1)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst")))
    ranked = ranked.select("src", "dst", "relation", "direction", "via", "weight", "rank")
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``id, component``: the smallest id that undirected edges (``a, b``) lead to.

    Stars, large and small in turn: every vertex ties its larger neighbours to the smallest id it sees, then its
    smaller ones, until each component is one star about its smallest id.  That takes a number of rounds in the
    order of the squared logarithm of its size, whatever its shape: a long chain is no worse than a clique.
    A hub's edges meet one row, so its join splits as any skewed join.  Lineage is cut by checkpoints in the shared
    folder; one row of sums tells whether a round changed anything.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = _checkpointed(e)
    before = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        seen = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(seen, "a")
        tied = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = _checkpointed(tied.unionAll(seen.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components still change after {rounds} rounds")


def _checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def component_stats(edges: DataFrame) -> DataFrame:
    """``connected, components, largest`` of document edges (``src, dst``)."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("connected"), F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def ancestor_chain(parents: DataFrame, most: int = 100) -> DataFrame:
    """``id, depth, ancestor``: the walk from each ``id`` over ``parent``, nearest first, at most ``most`` steps.

    A parent that is no row of its own ends the walk after it; so does a page that the walk has been to.
    """
    p = parents.where(F.col("id").isNotNull() & F.col("parent").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    step = p.select(F.col("id").alias("_i"), F.col("parent").alias("_p"))
    front = p.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array("id").alias("seen")).where(F.col("id") != F.col("parent"))
    rows = front.select("id", "depth", "ancestor")
    for d in range(2, most + 1):
        front = _checkpointed(front.join(step, front["ancestor"] == step["_i"]).select("id", F.col("_p").alias("next"), F.lit(d).alias("depth"), F.concat("seen", F.array("ancestor")).alias("seen")).where(~F.array_contains("seen", F.col("next"))))
        front = front.withColumnRenamed("next", "ancestor")
        if front.isEmpty():
            break
        rows = rows.unionByName(front.select("id", "depth", "ancestor"))
    return rows


def broken_links(resolved: DataFrame, reasons: list[str]) -> DataFrame:
    """``href, reason, n, example``: links whose target is missing through a fault of the documents."""
    return resolved.where(F.col("reason").isin(reasons)).groupBy("href", "reason").agg(F.count("*").alias("n"), F.min("source_id").alias("example"))
