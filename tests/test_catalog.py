import pytest
from pyspark.sql import functions as F

from quarrymill.functions import scalars as S
from quarrymill.operators import catalog as C


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [("2024", "2024"), ("2024-05", "2024-05"), ("2024-05-06T10:00", "2024-05-06"), ("2024-05-06 x", None), ("May", None), (None, None)])
def test_date_prefix(spark, raw, want):
    assert one(spark, S.date_prefix, raw) == want


@pytest.mark.parametrize("ms, want", [(45_000, "45s"), (200_000, "3m 20s"), (3_840_000, "1h 04m"), (-1, "?"), (None, "?"), (0, "0s")])
def test_duration(spark, ms, want):
    assert one(spark, S.duration, ms, "long") == want


def test_scalars(spark):
    assert one(spark, S.search_terms, ['Ledger "Gate', "ledger  gate", "api", "abc", "Tools"], "array<string>") == ["Ledger Gate"]
    assert one(spark, S.guess_language, "Come funziona?") == "it" and one(spark, S.guess_language, "How does it work?") == "en"
    assert one(spark, S.path_group, "gitlab/a/b/c/d.md") == "gitlab/a/b" and one(spark, S.path_group, "confluence/s/x.md") == "confluence/s" and one(spark, S.path_group, "x.md") == "x.md"
    assert one(spark, S.repository_of, "url:https://h.example/Grp/proj/-/tree/main/docs") == "grp/proj" and one(spark, S.repository_of, "https://h.example/grp/proj.git") == "grp/proj"
    assert one(spark, S.repository_of, "ftp://h/a/b") is None and one(spark, S.repository_of, "https://h.example/alone") is None
    assert one(spark, lambda c: S.repository_of(c, "other.example"), "https://h.example/a/b") is None
    assert one(spark, S.build_day, 1_700_000_000.0, "double") == one(spark, S.build_day, 1_700_000_000_000.0, "double") == "2023-11-14"
    assert one(spark, S.page_path, "a/b/index.html") == one(spark, S.page_path, "a/b.html") == "a/b/" and one(spark, S.page_path, "index.html") == ""
    assert one(spark, S.definition_kind, '{"openapi": "3.0.1"}') == "openapi" and one(spark, S.definition_kind, "swagger: '2.0'") == "swagger" and one(spark, S.definition_kind, "x: 1") is None
    assert one(spark, lambda c: S.cut_definition(c, 4), "abcdefg") == "abcd\n[truncated: 7 characters]" and one(spark, lambda c: S.cut_definition(c, 9), "abc") == "abc"
    assert one(spark, S.token_usage, ["abcde", None, "f"], "array<string>") == 2
    assert one(spark, S.round3, -0.0005, "double") == 0.0
    df = spark.createDataFrame([("2024-01-01", "2024-01-31T05:00")], "a string, b string")
    assert df.select(S.days_between(F.col("a"), F.col("b"))).first()[0] == 30


def test_discovery(spark):
    a = spark.createDataFrame([("G/One", 1), ("g/two", 2)], "path string, n int")
    b = spark.createDataFrame([("g/one", 9), ("g/three", 3)], "path string, n int")
    assert sorted((r["path"], r["n"]) for r in C.discover([a, b]).collect()) == [("G/One", 1), ("g/three", 3), ("g/two", 2)]


def test_parts(spark):
    m = spark.createDataFrame([("m1", ["component:default/a", "api:b", "group:x"]), ("m2", ["component:a"])], "module string, targets array<string>")
    c = spark.createDataFrame([("a", "m9"), ("c", "m2"), ("d", None)], "name string, module string")
    assert {r["part"]: r["module"] for r in C.catalog_parts(m, c).collect()} == {"a": "m1", "b": "m1", "c": "m2"}
    e = spark.createDataFrame([("R/x", "n1", False, 1), ("r/X", "n2", True, 2), ("r/x", "n3", True, 3), ("r/y", "n4", False, 4), (None, "n5", True, 5)], "repo string, name string, documents boolean, pos int")
    assert {r["repo"]: r["name"] for r in C.repository_entities(e).collect()} == {"r/x": "n3", "r/y": "n4"}


def test_pages(spark):
    t = spark.createDataFrame([("k", "u1", 1), ("k", "u2", 2)], "key string, url string, pos int")
    x = spark.createDataFrame([("k", "u1", 1), ("k", "u3", 2), ("k", "u4", 3)], "key string, url string, pos int")
    assert [r["url"] for r in C.lookup_pages(t, x, 3).orderBy("place").collect()] == ["u1", "u2", "u3"]
    pages = spark.createDataFrame([("1", "Root"), ("2", "Old stuff"), ("3", "leaf"), ("4", None)], "id string, title string")
    chains = spark.createDataFrame([("3", "2"), ("3", "1"), ("2", "1"), ("4", "1")], "id string, ancestor string")
    assert sorted(r["id"] for r in C.excluded_by_tree(pages, chains, [], ["old*"]).collect()) == ["2", "3"]
    assert sorted(r["id"] for r in C.excluded_by_tree(pages, chains, ["4"], []).collect()) == ["4"]


def test_free_paths(spark):
    import base64

    d = spark.createDataFrame([("a", "p.md", 2), ("b", "p.md", 1), ("c", "q.md", 3)], "source_id string, rel_path string, seq int")
    got = {r["source_id"]: r["rel_path"] for r in C.free_paths(d).collect()}
    assert got == {"b": "p.md", "c": "q.md", "a": f"p-{base64.urlsafe_b64encode(b'a').decode().rstrip('=')[-6:]}.md"}


def test_shares_specs_reports(spark):
    f = spark.createDataFrame([("p", "go", 75), ("p", "py", 25), ("q", "go", 1)], "p string, l string, n int")
    assert sorted((r["p"], r["language"], r["percent"]) for r in C.language_shares(f, "p", "l", "n").collect()) == [("p", "go", 75.0), ("p", "py", 25.0), ("q", "go", 100.0)]
    cases = spark.createDataFrame([("adr-1", "it", True), ("adr-2", "en", False), ("x", "it", True)], "id string, lang string, abstain boolean")
    pick = lambda s: sorted(r["id"] for r in cases.where(C.filter_spec(s)).collect())
    assert pick("lang=it|de,id=adr-") == ["adr-1"] and pick("abstain=true") == ["adr-1", "x"] and len(pick("")) == 3
    pages = spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    reports = spark.createDataFrame([("r1", "new", "s1", ["s2"], 1), ("r2", "new", None, ["s1", "s2"], 2), ("r3", "done", "s1", None, 3)], "id string, status string, target string, sources array<string>, ts int")
    assert [(r["source_id"], r["report_id"]) for r in C.reports_of(pages, reports).orderBy("source_id", "rank").collect()] == [("s1", "r2"), ("s1", "r1"), ("s2", "r2")]
    man = spark.createDataFrame([("s2", "c", "e")], "source_id string, content_hash string, embed_hash string")
    assert sorted((r["report_id"], r["source_id"], r["content_hash"]) for r in C.pinned_reports(reports.where("sources is not null"), man).collect()) == [("r1", "s2", "c"), ("r2", "s1", None), ("r2", "s2", "c")]


def test_tool_calls():
    text = 'x <tool_call>{"name": "search", "arguments": {"query": "a"}}</tool_call> <function=fetch><parameter=id> s </parameter></function> <tool_call>{bad}</tool_call>'
    assert C.tool_calls(text) == [("search", {"query": "a"}), ("fetch", {"id": "s"})] and C.tool_calls("none") == []
