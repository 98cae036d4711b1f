"""Whole runs and small scalars on hand-made rows."""

from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import graph, links, retrieval, runs

EVENT = "event_id long, event_type string, source string, source_id string, rel_path string, title string, last_modified string, fingerprint string, reason string, emitted_at timestamp, received_at timestamp"


def events(spark, rows):
    t = lambda k: f"2025-01-01 00:00:{k:02d}"
    df = spark.createDataFrame([(k, kind, s, i, None, None, None, f, None, t(k), t(k)) for k, kind, s, i, f in rows], EVENT.replace("timestamp", "string"))
    return df.withColumns({c: F.to_timestamp(c) for c in ("emitted_at", "received_at")})


def test_sync_run(spark):
    previous = spark.createDataFrame([("a", n, f"f-{n}") for n in ("same", "other", "gone", "skipped", "failed", "told")] + [("b", "old", "f"), ("c", "quiet", "f"), ("a", "null", None)], "source string, source_id string, fingerprint string")
    rows = [(1, "doc", "a", "same", "f-same"), (2, "doc", "a", "other", "x"), (3, "doc", "a", "new", "n"), (4, "skip", "a", "skipped", None), (6, "unchanged", "a", "told", None), (7, "doc", "a", "same", "f-same"), (7, "doc", "a", "same", "f-same"), (8, "error", "b", None, None), (9, "meta", "a", "unknown", None), (10, "doc", "a", "null", None), (11, "doc", "a", "failed", "f-failed"), (12, "doc", None, "no source", "x"), (13, "doc", "b", "fresh", "y")]
    out = {(r["source"], r["source_id"]): r["action"] for r in runs.sync_run(previous, events(spark, rows)).collect()}
    assert out == {
        ("a", "same"): "unchanged", ("a", "other"): "changed", ("a", "new"): "added", ("a", "skipped"): "skipped", ("a", "told"): "unchanged", ("a", "gone"): "removed",
        ("a", "failed"): "unchanged", ("a", "unknown"): "ignored", ("a", "null"): "unchanged", ("b", "old"): "kept", ("b", "fresh"): "added", ("c", "quiet"): "kept",
    }
    state = {r["source_id"]: r["fingerprint"] for r in runs.next_items(runs.sync_run(previous, events(spark, rows))).collect()}
    assert "gone" not in state and "skipped" not in state and state["other"] == "x" and state["told"] == "f-told" and state["old"] == "f"
    assert runs.sync_run(previous.where("false"), events(spark, [])).count() == 0


def test_ingest_run(spark):
    docs = spark.createDataFrame([("u", "1", "1"), ("r", "2x", "2"), ("c", "3x", "3x"), ("n", "4", "4")], "source_id string, content_hash string, embed_hash string")
    manifest = spark.createDataFrame([("u", "1", "1"), ("r", "2", "2"), ("c", "3", "3"), ("g", "5", "5")], "source_id string, content_hash string, embed_hash string")
    chunks = spark.createDataFrame([(s, k, f"{s}{k}") for s in "urcn" for k in range(2)], "source_id string, ordinal int, text string")
    stored = chunks.where("source_id in ('u', 'r')").withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)))
    run = runs.ingest_run(docs, manifest, chunks, stored, 2)
    assert {r["source_id"]: (r["status"], r["reuse"], r["chunks"]) for r in run.collect()} == {"u": ("unchanged", True, 2), "r": ("refresh", True, 2), "c": ("changed", False, 2), "n": ("added", False, 2), "g": ("removed", False, 0)}
    report = {r["status"]: (r["documents"], r["embedded"], r["batches"]) for r in runs.ingest_report(run).collect()}
    assert report["refresh"] == (1, 0, 0) and report["added"] == (1, 2, 1)
    table = runs.apply_ingest(run, stored.unionByName(stored.limit(1).withColumn("source_id", F.lit("g"))), chunks.where("source_id in ('c', 'n')").withColumn("vector", F.array(F.lit(0.0), F.lit(1.0))))
    assert {r["source_id"] for r in table.collect()} == set("urcn")
    wider = runs.ingest_run(docs, manifest, chunks, stored, 3)  # other dims: nothing can be kept
    assert not any(r["reuse"] for r in wider.collect())


def test_rebuild():
    state = {"version": 2, "model": "m", "dims": 8, "target_tokens": 10, "max_tokens": 20, "overlap_tokens": 2}
    assert runs.needs_rebuild(state, state | {"code_target_tokens": 10}) is None
    assert runs.needs_rebuild(state, state | {"code_max_tokens": 30}) == "code_max_tokens"
    assert runs.needs_rebuild(state, state | {"dims": 9}) == "dims" and runs.needs_rebuild(None, state) == "no state"


def test_order_codes_and_payload(spark):
    docs = spark.createDataFrame([("1", "code", "b"), ("2", "doc", "z"), ("3", None, "a"), ("4", "Project", "q"), ("5", "api", None), ("6", "doc", "c")], "source_id string, kind string, rel_path string")
    assert [r["source_id"] for r in runs.ingest_order(docs).orderBy("place").collect()] == ["4", "6", "2", "5", "1", "3"]
    coded = runs.encoded(docs, ["kind"])
    assert {r["source_id"]: r["kind"] for r in coded.collect()}["6"] == 0
    back = runs.decoded(coded, {"kind": runs.dictionary(docs, "kind")})
    assert back.exceptAll(docs).count() == 0 and docs.exceptAll(back).count() == 0
    edges = spark.createDataFrame([("y", "x", "links_to"), ("x", "q", "child_of")], "src string, dst string, relation string")
    assert {tuple(r) for r in runs.doc_payload(edges).collect()} == {(2, 1, "links_to"), (1, 0, "child_of")}


def test_references_edges_and_gaps(spark):
    fm = "map<string,string>"
    rows = [
        ("confluence:S:1", "doc", {"space": "S", "parent_id": "2", "tags": "Alpha, beta;alpha", "ancestors": '["Top","Mid"]'}, "See [two](https://wiki.x.example/pages/2/t) and [gone](https://wiki.x.example/pages/9) and [me](https://wiki.x.example/pages/1)."),
        ("confluence:S:2", "doc", {"space": "S", "parent_id": "77"}, None),
        ("gitlab:g/p:docs/a.md", "doc", {"project": "g/p", "space": " "}, "[b](b.md) ![img](c.png)"),
        ("gitlab:g/p:docs/b.md", "doc", {"project": "g/p"}, ""),
        ("gitlab:g/p:__project", "project", {"project": "g/p", "techdocs_ref": "https://h.atlassian.net/wiki/pages/1", "confluence_pages": "https://wiki.x.example/pages/2, https://wiki.x.example/pages/8"}, None),
        ("gitlab:g/q:docs/c.md", "doc", None, "plain"),
    ]
    docs = spark.createDataFrame([(*r, "f/x.md") for r in rows], f"source_id string, kind string, frontmatter {fm}, body string, rel_path string")
    refs = graph.document_references(docs, links.Hosts(portal=[], wiki=["wiki.x.example"], repository=[]))
    edges = {tuple(r) for r in graph.document_edges(refs).collect()}
    card = "gitlab:g/p:__project"
    assert edges == {
        ("confluence:S:1", "confluence:S:2", "links_to"), ("confluence:S:1", "confluence:S:2", "child_of"), ("gitlab:g/p:docs/a.md", "gitlab:g/p:docs/b.md", "links_to"),
        ("gitlab:g/p:docs/a.md", card, "described_by"), ("gitlab:g/p:docs/b.md", card, "described_by"), (card, "confluence:S:1", "documents"), (card, "confluence:S:2", "related_wiki"),
    }
    assert {tuple(r) for r in graph.reference_gaps(refs).collect()} == {("body", "wiki-page", 1), ("frontmatter", "wiki-page", 2)}
    places = spark.createDataFrame([("gitlab:g/p:docs/a.md", "A", None, "M")], "source_id string, area string, subarea string, module string")
    hubs = {(r["src"], r["dst"]) for r in graph.hub_edges(docs, places=places).collect()}
    assert {("confluence:S:1", x) for x in ("space:S", "tag:alpha", "tag:beta", "tree:S/Top", "tree:S/Top/Mid", "tree:f")} <= hubs
    assert ("gitlab:g/p:docs/a.md", "area:A") in hubs and ("gitlab:g/p:docs/a.md", "module:M") in hubs and not any(d.startswith(("space: ", "subarea:")) for _, d in hubs)
    assert graph.document_edges(graph.document_references(docs.where("false"), links.Hosts([], [], []))).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(1, "7.9", 3.5, "# Head ##\n\ntext\n###### deep", "The LEDGER of the ledgers"), (2, "x", None, "no head\n## Second", "nothing"), (3, None, -1.0, None, None)], "i int, t string, d double, body string, title string")
    out = df.select(
        "i", scalars.as_int(F.col("t"), 5, 0, 6).alias("n"), scalars.clamp(F.col("d"), 0.0, 2.0).alias("c"), scalars.first_heading(F.col("body")).alias("h"), scalars.demote_headings(F.col("body")).alias("deep"),
        scalars.with_title(F.col("body"), F.lit("T")).alias("w"), scalars.highlighted(F.col("title"), F.lit("ledger ledgers a")).alias("m"), scalars.percent(F.lit(1), F.col("i") - 1).alias("p"),
    ).orderBy("i").collect()
    assert [r["n"] for r in out] == [6, 5, 5] and [r["c"] for r in out] == [2.0, 0.0, 0.0]
    assert [r["h"] for r in out] == ["Head", None, None] and out[0]["deep"] == "## Head ##\n\ntext\n###### deep" and out[1]["w"].startswith("# T\n\nno head") and out[0]["w"].startswith("# Head")
    assert out[0]["m"] == "The **LEDGER** of the **ledgers**" and [r["p"] for r in out] == ["–", "100.0%", "50.0%"]
    assert scalars.search_clause("title", ['a"b', "c"]) == 'title in ("a\\"b","c")' and scalars.search_clause("title", []) == ""


def test_rerank(spark):
    hits = spark.createDataFrame([(1, f"h{k}", 1.0 - k / 10, k) for k in range(1, 8)], "qid int, id string, score double, rank int")
    judged = spark.createDataFrame([(1, "h3", 9.0), (1, "h6", 12.0), (1, "h7", 10.0)], "qid int, id string, judged double")
    assert [(r["id"], r["score"]) for r in retrieval.rerank(hits, judged, 2).orderBy("rank").collect()] == [("h6", 1.4), ("h3", 1.6)]
