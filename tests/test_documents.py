import random
import json

import pytest

from hypothesis import given
from hypothesis import strategies as st

from quarrymill.operators import chunking, html, quality, specs
from quarrymill.sources import connector, markdown, tables


def test_blocks_and_paths():
    md = "# Title\n\nintro\n\n## One\n```py\n# not a heading\n```\n| a | b |\n| - | - |\n| 1 | 2 |\n### Deep\ntext\n## Two\nend"
    got = [(b.kind, b.path) for b in chunking.parse_blocks(md)]
    assert got == [("heading", ["Title"]), ("text", ["Title"]), ("heading", ["Title", "One"]), ("code", ["Title", "One"]), ("table", ["Title", "One"]), ("heading", ["Title", "One", "Deep"]), ("text", ["Title", "One", "Deep"]), ("heading", ["Title", "Two"]), ("text", ["Title", "Two"])]
    assert chunking.parse_blocks("```\nopen to the end")[0].text == "```\nopen to the end"
    assert chunking.parse_blocks("") == []


def test_prose_chunks_keep_sizes():
    sizes = chunking.Sizes(120, 200, 20)
    body = "\n\n".join(f"## H{i}\n\n" + " ".join(f"Sentence {i} {k} is here." for k in range(25)) for i in range(5))
    out = chunking.chunk_prose("Doc", body, sizes)
    assert out and all(n <= 200 for _, _, n in out) and out[0][0] == "Doc > H0"
    text = " ".join(c for _, c, _ in out)
    assert all(f"Sentence {i} {k} is here." in text for i in range(5) for k in range(25))


def test_table_pieces_repeat_the_header():
    table = "| h1 | h2 |\n| --- | --- |\n" + "\n".join(f"| row {i} | {'x' * 30} |" for i in range(40))
    pieces = chunking.split_block(chunking.Block("table", table), 100)
    assert len(pieces) > 1 and all(p.text.startswith("| h1 | h2 |\n| --- | --- |\n") for p in pieces)


def test_code_chunks():
    code = "\n".join(f"def f{i}(x):\n    y = x + {i}\n    return y * {i}\n" for i in range(120))
    out = chunking.chunk_code("a.py", f"```python\n{code}\n```", chunking.Sizes(code_target=200, code_most=300))
    assert len(out) > 2 and out[0][0].startswith("a.py > f0") and out[0][3] == 1
    assert all(a[4] < b[3] for a, b in zip(out, out[1:])) and all(c.startswith("```python\ndef") for _, c, *_ in out)
    assert chunking.chunk_code("a.py", "no fence") == []


def test_chunk_documents_with_nulls(spark):
    docs = spark.createDataFrame([("s", "doc", None, "# T\n\n" + "word " * 60, {"breadcrumb": "Home"}), ("n", None, "t", None, None), (None, "doc", "t", "x", None), ("e", "code", "t", "", None)], "source_id string, kind string, title string, body string, frontmatter map<string,string>")
    out = chunking.chunk_documents(docs).collect()
    assert [(r["id"], r["line_start"]) for r in out] == [("s::0", -1)] and out[0]["heading_path"] == "Home > s > T"


def counted_line_by_line(text):
    """The five counts by reading one line after another."""
    import regex

    from quarrymill.functions import values as V

    words = cells = blocks = heads = links = 0
    fence = ""
    for line in (x.strip() for x in (text or "").split("\n")):
        mark = regex.match(r"`{3,}|~{3,}", line)
        if fence:
            fence = "" if line.startswith(fence) else fence
        elif mark:
            fence, blocks = mark[0], blocks + 1
        elif regex.match(r"#{1,6}\s", line):
            heads += 1
        elif line.startswith("|"):
            cells += 0 if regex.match(r"\|{1,2}\s*:?-{2,}", line) else sum(bool(c.strip()) for c in line.split("|")[1:-1])
        elif regex.match(V.LINK_ONLY, line):
            links += 1
        else:
            words += len(regex.findall(r"\p{L}[\p{L}\p{M}'’-]+", regex.sub(r"`[^`]*`|<[^>]+>", " ", regex.sub(r"(!?)\[([^\]]*)\]\([^)]*\)", lambda m: " " if m[1] else m[2], line))))
    return words, cells, blocks, heads, links


def test_prose_stats(spark):
    md = "# H\n\nSome words [link](u) `code` here.\n\n- [only](u)\n\n```\nx\n```\n\n| a | |\n|---|---|\n| b | c |"
    assert counted_line_by_line(md) == (4, 3, 1, 1, 1)
    r = random.Random(3)
    parts = ["# A\n", "```py\n", "```\n", "~~~~\n", "| a | b |\n", "|---|---|\n", "words here [link](x) ![i](y) `c d` <b>z</b>\n", "- [a](b)\n", "https://x.y z\n", "https://x.y\n", "  ```js inline\n", "l'été naïve\n", "\n", "  # Set off\n", "   | x | y |\n", "\t9 words 9\n"]
    texts = [md, None, "", "```", *["".join(r.choices(parts, k=r.randrange(25))) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, body string")
    got = {x["i"]: tuple(x)[1:] for x in quality.prose_stats(df, "i", "body").collect()}
    assert all(got[i] == counted_line_by_line(t) for i, t in enumerate(texts))


def packed_one_by_one(sizes, heading, s):
    """The ranges by taking one block after another."""
    out, held, total = [], [], 0
    for i, n in enumerate(sizes):
        if held and heading[i] and total >= s.least:
            out.append(held)
            held, total = [], 0
        elif held and total + n > s.target and total >= s.least:
            out.append(held)
            held = [i - 1] if not heading[i - 1] and sizes[i - 1] <= s.overlap * 1.5 else []
            total = sum(sizes[k] for k in held)
        held, total = held + [i], total + n
        if total > s.most and len(held) > 1:
            out.append(held[:-1])
            held, total = [i], n
    return [(h[0], h[-1] + 1) for h in out + ([held] if held else [])]


@given(st.lists(st.tuples(st.integers(1, 90), st.booleans()), max_size=60))
def test_passages(blocks):
    s = chunking.Sizes(60, 90, 20)
    sizes, heading = [n for n, _ in blocks], [h and n < 10 for n, h in blocks]
    assert chunking.passages(sizes, heading, s) == packed_one_by_one(sizes, heading, s)


@given(st.lists(st.integers(0, 30), max_size=40), st.integers(5, 60))
def test_runs(lengths, room):
    got = chunking.runs(lengths, room)
    assert [k for a, b in got for k in range(a, b)] == list(range(len(lengths)))
    size = lambda a, b: sum(lengths[a:b]) + b - a - 1
    assert all(size(a, b) <= room or b == a + 1 for a, b in got) and all(size(a, z) > room for (a, _), (z0, z) in zip(got, [(b0, b0 + 1) for b0, _ in got[1:]]))


def test_cut_json():
    whole = {"paths": {"/a": {"get": {"summary": 'quote " here'}}, "/b": {"post": {"tags": ["x", "y"]}}}}
    text = json.dumps(whole)
    assert specs.parse_cut_json(text) == whole
    for n in range(20, len(text)):
        got = specs.parse_cut_json(text[:n])
        assert got is None or isinstance(got, dict)
    assert specs.parse_cut_json(text[: text.index("/b")])["paths"]["/a"] == whole["paths"]["/a"]
    assert specs.parse_cut_json("nonsense") is None


def test_definition_sections(spark):
    spec = {"openapi": "3.0", "info": {"title": "T"}, "paths": {"/a": {"parameters": [], "get": {"operationId": "getA", "summary": "Get  a"}, "post": {"deprecated": True}}, "/b": {"x": 1}}, "components": {"schemas": {"S": {}}}}
    got = specs.definition_sections(f"text\n```json\n{json.dumps(spec)}\n```")
    assert [(k, h) for k, h, _ in got] == [("overview", "Overview"), ("operation", "GET /a — Get a"), ("operation", "POST /a"), ("path", "/b"), ("component", "schemas: S")]
    assert specs.definition_sections("no fence") == [] and specs.definition_sections("```\n{}\n```") == []
    sdl = "type A {\n  x: Int\n}\ntype Query {\n  a: A\n}"
    assert [h for _, h, _ in specs.definition_sections(f"```graphql\n{sdl}\n```")] == ["type Query", "type A"]
    docs = spark.createDataFrame([("d", f"```json\n{json.dumps(spec)}\n```"), ("n", None)], "source_id string, body string")
    assert specs.explode_definitions(docs).count() == 5


def test_html():
    page = """<html><head><title>T - Site</title><script>x</script></head><body><nav>menu</nav><article><h1>Head¶</h1><p>One <b>two</b> <a href="../x">link</a> <code>c</code></p>
    <ul><li>a</li><li>b<ol><li>n</li></ol></li></ul><pre><code class="language-py">def f():
    pass</code></pre><table><tr><th>h</th><th>i|j</th></tr><tr><td>1</td></tr></table><blockquote><p>q</p></blockquote><img src=x alt=pic></article><footer>f</footer></body></html>"""
    md = html.html_to_markdown(page, "https://h.example/a/b/")
    for part in ("# Head", "One **two** [link](https://h.example/a/x) `c`", "- a\n- b\n  1. n", "```py\ndef f():\n    pass\n```", "| h | i\\|j |\n| --- | --- |\n| 1 |  |", "> q", "[image: pic]"):
        assert part in md, (part, md)
    assert "menu" not in md and "Site" not in md and html.html_to_markdown(None) is None and html.html_to_markdown("") == ""


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "gitlab").mkdir()
    (tmp_path / "gitlab" / "a.md").write_text("---\nsource_id: s1\ntitle: 'A: b'\ntags: [x, y]\n---\nbody\n")
    (tmp_path / "gitlab" / "bad.md").write_text("---\ntags: [unclosed\nkind: api\n---\n# Heading\n")
    (tmp_path / "gitlab" / "z.markdown").write_text("---\nsource_id: s1\n---\nlater")
    (tmp_path / "notes-here.md").write_text("plain")
    (tmp_path / "skip.txt").write_text("no")
    docs = {r["source_id"]: r for r in markdown.documents(markdown.read_folder(spark, str(tmp_path))).collect()}
    assert set(docs) == {"s1", "gitlab/bad.md", "notes-here.md"}
    assert docs["s1"]["title"] == "A: b" and docs["s1"]["frontmatter"]["tags"] == "x/y" and docs["s1"]["rel_path"] == "gitlab/a.md"
    assert docs["gitlab/bad.md"]["kind"] == "api" and docs["gitlab/bad.md"]["title"] == "Heading"
    assert docs["notes-here.md"]["title"] == "notes here" and docs["notes-here.md"]["source_type"] == "manually-curated"
    text = markdown.render(markdown.documents(markdown.read_folder(spark, str(tmp_path)))).where("rel_path = 'gitlab/a.md'").first()["text"]
    assert markdown.parse_frontmatter(text)[0]["title"] == "A: b" and "# A: b" in text


def test_stored_tables(spark):
    ch = spark.createDataFrame([("a::0", "a", 0, "h", "c", "t", None, None)], "id string, source_id string, ordinal int, heading_path string, content string, text string, line_start int, line_end int")
    docs = spark.createDataFrame([("a", "x", "doc", "t", None, "unknown", "en", None, "p")], "source_id string, source_type string, kind string, title string, source_url string, authority string, lang string, last_modified string, rel_path string")
    good = spark.createDataFrame([("a::0", [1.0, 2.0])], "id string, vector array<float>")
    row = tables.to_stored(ch, docs, good, 2).first()
    assert (row["source_url"], row["line_start"]) == ("", -1)
    back = tables.from_stored(tables.to_stored(ch, docs, good, 2)).first()
    assert (back["source_url"], back["line_start"]) == (None, None)
    with pytest.raises(Exception, match="not 3 numbers"):
        tables.to_stored(ch, docs, good, 3).collect()


def test_cases(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('# note\n\n{"id": "1", "question": "q", "expected_source_ids": [" a ", ""]}\n// x\n')
    row = tables.read_cases(spark, str(f)).first()
    assert row["expected_source_ids"] == ["a"] and row["lang"] == "en" and row["should_abstain"] is False
    f.write_text('{"id": "1"}\nbroken\n')
    with pytest.raises(Exception, match="not JSON: broken"):
        tables.read_cases(spark, str(f)).collect()


CALLS = {"n": 0}


def listing(root, cursor, options):
    at = int(cursor or 0)
    return [{"source": root, "source_id": f"{root}:{at + k}", "title": options["prefix"]} for k in range(2)], str(at + 2) if at < 2 else None


def test_connector(spark):
    connector.register(spark)
    reader = connector.ListingReader({"transport": "tests.test_documents:listing", "roots": "a,b", "prefix": "p"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in rows] == ["a:0", "a:1", "a:2", "a:3", "b:0", "b:1", "b:2", "b:3"]
    df = spark.read.format("listing").options(transport="tests.test_documents:listing", roots="a,b", prefix="p").load()
    assert df.count() == 8 and {r["title"] for r in df.collect()} == {"p"}
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert connector.with_retries(flaky, wait=lambda s: None) == "ok" and len(tries) == 3


def test_sections():
    from quarrymill.operators import documents as D

    body = "# T\n\nintro\n\n## Alpha\na\n### Query Parameters\nq1\n## Beta\n```\n## Alpha\n```\n### Query Parameters\nq2\n"
    assert D.section(body, "query parameters")[0] == "### Query Parameters\nq1"
    assert D.section(body, "Beta > Query Parameters")[0].endswith("q2")
    assert D.section(body, "Alpha")[0] == "## Alpha\na\n### Query Parameters\nq1" and D.section(body, "nothing") is None
    got = D.fetch("line one\nline two\nline three\n", offset=12, most=10)
    assert got["offset"] == 9 and got["text"] == "line two" and got["next"] == 18
    assert D.fetch("abc")["next"] is None


def test_status(spark):
    from pyspark.sql import functions as F

    from quarrymill.operators import documents as D

    rows = [("## Status\n\nAccepted on 1 May", None), ("Status: superseded by 12", None), ("| Stato | Deprecato |", None), ("text", "Proposed, Accepted"), ("## Context\nx", None), ("plain", None), (None, None)]
    df = spark.createDataFrame(rows, "b string, s string")
    out = df.select(D.decision_status(F.col("b"), F.col("s")).alias("st"), D.effective_authority(F.lit("binding"), F.col("b"), F.col("s")).alias("a")).collect()
    assert [tuple(r) for r in out] == [("accepted", "binding"), ("superseded", "descriptive"), ("deprecated", "descriptive"), ("template", "descriptive"), (None, "binding"), (None, "descriptive"), (None, "descriptive")]


def test_ids_bundles_verdicts(spark):
    import io
    import zipfile

    from quarrymill.operators import documents as D

    docs = spark.createDataFrame([("gitlab:a/b:docs/x.md", "gitlab/a/b/docs/x.md"), ("s2", None)], "source_id string, rel_path string")
    asked = spark.createDataFrame([("GITLAB/a/b/docs/X",), ("zzz docs/x.md",), ("S-2",)], "q string")
    assert sorted((r["q"], r["source_id"]) for r in D.resolve_ids(asked, docs).collect()) == [("GITLAB/a/b/docs/X", "gitlab:a/b:docs/x.md"), ("S-2", "s2")]
    assert [r["q"] for r in D.suggest_ids(spark.createDataFrame([("docs/x",)], "q string"), docs).collect()] == ["docs/x"]
    cites = spark.createDataFrame([("b", 2), ("a", 3), ("b", 5), ("a", 1)], "source_id string, n int")
    assert [(r["source_id"], list(r["numbers"])) for r in D.bundle_documents(cites).orderBy("place").collect()] == [("a", [1, 3]), ("b", [2, 5])]
    z = zipfile.ZipFile(io.BytesIO(D.zip_bundle("q", "a", [("a/b:c.md", "text")], {"n": 1})))
    assert z.testzip() is None and "sources/a-b-c.md" in z.namelist()
    assert D.judge_verdict('so: {"correctness": "3", "grounded": 1, "abstained": "true", "x": {"y": 1}} end') == {"correctness": 2, "grounded": 1, "abstained": True, "rationale": ""}
    assert D.judge_verdict("no json") is None and D.judge_verdict("{bad}") is None
    index = spark.createDataFrame([("a/#x",), ("a/",), ("",), ("assets/x.html",), ("b/c.html#t",)], "location string")
    assert sorted(r["path"] for r in D.search_index_pages(index).collect()) == ["a/index.html", "b/c.html", "index.html"]
