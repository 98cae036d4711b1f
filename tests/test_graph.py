from pyspark.sql import functions as F

from quarrymill.operators import graph, hierarchy, links


def test_normal_path(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",), ("/a//b/",), ("",)], "p string")
    assert [r["n"] for r in df.select(links.normal_path(F.col("p")).alias("n")).collect()] == ["a/c", "../x", "../x", "a/b", ""]


def test_links(spark):
    body = 'See [Set *up*](./setup.md "t"), ![no](x.png) and <https://else.example/x>, [out](../../../y.md), [far](https://git.tarnfield.example/g/p/-/blob/main/docs/b.md#L3), [gone](https://git.tarnfield.example/q/r/-/blob/main/z.md), [top](#a), [mail](mailto:a@b.c)'
    docs = spark.createDataFrame([("gitlab:g/p:docs/a.md", body), ("gitlab:g/p:docs/setup.md", None), ("gitlab:g/p:docs/b.md", "")], "source_id string, body string")
    found = links.extract_links(docs)
    assert [r["text"] for r in found.orderBy("pos").collect()][0] == "Set up"
    out = links.resolve_links(found, docs, links.Hosts([], [], ["git.tarnfield.example"]))
    got = {r["href"]: (r["target"], r["reason"]) for r in out.collect()}
    assert got == {
        "./setup.md": ("gitlab:g/p:docs/setup.md", None),
        "../../../y.md": (None, "relative-outside"),
        "https://git.tarnfield.example/g/p/-/blob/main/docs/b.md#L3": ("gitlab:g/p:docs/b.md", None),
        "https://git.tarnfield.example/q/r/-/blob/main/z.md": (None, "repo-unknown"),
        "#a": (None, "unparsable"),
        "mailto:a@b.c": (None, "unparsable"),
        "https://else.example/x": (None, "external"),
    }
    assert {g for g, _, _ in links.REASONS} >= {v[1] for v in got.values() if v[1]}


def test_components_of_chain_and_cycle(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)]
    e = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")], "a string, b string")
    out = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert {v for k, v in out.items() if k.startswith("n")} == {"n000"} and out["z"] == "x" and "s" not in out and len(out) == 74


def test_components_of_a_shuffled_chain_and_a_hub(spark):
    """Labels in no order along a chain, where passing them on by hops would take as many rounds as vertices."""
    import random

    names = list(range(600))
    random.Random(2).shuffle(names)
    chain = list(zip(names, names[1:]))
    hub = [(5000, 6000 + i) for i in range(300)]
    out = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(chain + hub + [(9, 9)], "a long, b long")).collect()}
    assert out == {**{n: 0 for n in names}, **{n: 5000 for n in [5000, *range(6000, 6300)]}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ancestors_stop_at_cycles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", "f"), (None, "x"), ("g", None)], "id string, parent string")
    out = sorted((r["id"], r["depth"], r["ancestor"]) for r in graph.ancestor_chain(p).collect())
    assert out == [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "c"), ("b", 2, "a"), ("c", 1, "a"), ("c", 2, "b"), ("d", 1, "e")]


def test_neighbours_prefer_direct(spark):
    direct = spark.createDataFrame([("a", "b", "links_to"), ("c", "a", "child_of")], "src string, dst string, relation string")
    hubs = spark.createDataFrame([("a", "h", "in_repo"), ("b", "h", "in_repo"), ("d", "h", "in_repo"), *[(f"m{i}", "big", "in_space") for i in range(70)], ("a", "big", "in_space")], "src string, dst string, relation string")
    of = spark.createDataFrame([("a",)], "id string")
    out = [(r["dst"], r["direction"], r["weight"]) for r in graph.neighbours(direct, hubs, of).orderBy("rank").collect()]
    assert out == [("b", "out", 1.0), ("c", "in", 0.9), ("d", "sibling", round(0.6 / 2.321928094887362, 6))]


def test_first_match(spark):
    docs = spark.createDataFrame([("1", "a/x"), ("2", "b/x"), ("3", None)], "source_id string, p string")
    rules = [{"match": {"p": "a/*"}, "set": {"t": "one"}}, {"match": {"p": ["*/x"]}, "set": {"t": "two"}}, {"match": {}, "set": {"t": "no"}}]
    assert [r["t"] for r in hierarchy.first_match(docs, "source_id", rules, {"p": F.col("p")}).orderBy("source_id").collect()] == ["one", "two", None]


def test_labels(spark):
    df = spark.createDataFrame([("A", "S", "M"), ("A", None, None), (None, None, None)], "a string, s string, m string")
    a, s, m = hierarchy.place_labels(F.col("a"), F.col("s"), F.col("m"))
    assert [tuple(r) for r in df.select(a, s, m).collect()] == [("A", "S", "M"), ("A", "A · other", "A · other"), ("Not in the map",) * 3]


def test_resolved_links_reach_the_graph(spark, monkeypatch):
    from quarrymill.plans import graphs

    wiki = "https://wiki.tarnfield.example/pages/{0}"
    rows = [(f"confluence:OPS:{n}", f"See [next]({wiki.format(n + 1)}) and [self]({wiki.format(n)}).", wiki.format(n), None, f"ops/{n}.md") for n in (11, 12, 13, 14)] + [("confluence:OPS:90", "No link.", None, None, "other/90.md")]
    kb = spark.createDataFrame(rows, "source_id string, body string, source_url string, frontmatter map<string,string>, rel_path string")
    monkeypatch.setattr(graphs.data, "pages", lambda s, d, *cols: kb.select("source_id", *cols))
    page = "confluence:OPS:{0}".format
    targets = {(r["source_id"], r["pos"], r["target"]) for r in graphs.link_targets(spark, "").collect()}
    assert {(page(n), 0, page(n + 1)) for n in (11, 12, 13)} | {(page(n), -1, page(n)) for n in (11, 12, 13, 14)} <= targets
    assert {tuple(r) for r in graphs.graph_link_components(spark, "").collect()} == {(page(n), page(11)) for n in (11, 12, 13, 14)}
    got = {(r["src"], r["dst"], r["direction"]) for r in graphs.graph_link_neighbors(spark, "").where("relation = 'links_to'").collect()}
    assert (page(11), page(12), "out") in got and (page(13), page(12), "in") in got
