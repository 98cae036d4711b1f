import random

import numpy as np
import pytest

from quarrymill.llm import main_content as M

VERBS = ["stores", "rejects", "merges", "compares", "forwards", "reports"]
THINGS = ["the report", "a broken link", "the order of steps", "every request", "the signed copy", "an empty answer"]


def sentence(r):
    return f"The {r.choice(['gateway', 'portal', 'engine', 'worker'])} {r.choice(VERBS)} {r.choice(THINGS)} after the {r.choice(['first', 'second', 'last'])} failure."


def page(r, site, n):
    """(url, title, body, line numbers outside the main body) of an invented site page."""
    title = f"{r.choice(['Sizing', 'Tracing', 'Sharing'])} {r.choice(['tokens', 'queues', 'exports'])} {n}"
    head = ["Skip to content", *[f"- [{x}](/{x.lower()})" for x in ("Home", "Guides", "Status", "Blog")][: r.randrange(2, 5)], f"{site} > docs > {title}", f"Updated {r.randrange(1, 28)}/0{r.randrange(1, 9)}/2025"]
    body = [f"# {title}", "", sentence(r), "", "## Limits", "", *[f"- {sentence(r)[:-1]}" for _ in range(r.randrange(2, 5))], "", "```", "key: 1", "- [not](/a) link", "```", "", " ".join(sentence(r) for _ in range(3))]
    tail = ["", "Related pages", *[f"- [Sizing {x}](/p/{r.randrange(999)})" for x in ("tokens", "queues", "exports")], f"© 2025 {site}. All rights reserved.", "Edit this page", "Was this page helpful? Yes No"]
    lines = head + body + tail
    outside = [i for i, l in enumerate(lines, 1) if l.strip() and (i <= len(head) or i > len(head) + len(body))]
    return f"https://{site.lower()}.example/docs/{n}", title, "\n".join(lines), outside


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    pages = [page(r, s, i) for s in ("Alpha", "Beta", "Gamma") for i in range(40)]
    files = [(f"https://git.example/a/b/-/blob/main/{i}.md", f"T{i}", f"# T{i}\n\n{sentence(r)}\n\n## Limits\n\n- {sentence(r)[:-1]}\n\n```\nx: 1\n```") for i in range(40)]
    return M.fit([(u, t, b) for u, t, b, _ in pages] + files)


def test_held_out_accuracy(model):
    r = random.Random(2)
    pages = [page(r, s, i + 900) for s in ("Alpha", "Beta", "Delta") for i in range(20)]
    got = M.outside_lines([b for _, _, b, _ in pages], [t for _, t, _, _ in pages], model)
    want = [set(o) for *_, o in pages]
    hit = sum(len(set(g) & w) for g, w in zip(got, want))
    assert hit / sum(map(len, want)) > 0.97 and hit / sum(map(len, got)) > 0.97


def test_marginals_are_those_of_the_tree(model):
    """Sum-product against the sum over all labellings of a small tree."""
    lines = M.parse("a\n\n- [b](/b)\n- [c](/c)\n\nThe long sentence is here.")
    evidence = np.array([0.4, -1.0, 2.0, -0.3])
    runs, blocks = [l.run for l in lines], [l.block for l in lines]
    n_r, n_b = max(runs) + 1, max(blocks) + 1
    of = {l.run: l.block for l in lines}
    p = np.zeros((len(lines), 2))
    for code in range(2 ** (1 + n_b + n_r + len(lines))):
        bit = lambda k: code >> k & 1  # noqa: B023, E731
        root = bit(0)
        w = model.root[root]
        w += sum(model.page_block[root, bit(1 + b)] for b in range(n_b))
        w += sum(model.block_run[bit(1 + of[r]), bit(1 + n_b + r)] for r in range(n_r))
        for i in range(len(lines)):
            y = bit(1 + n_b + n_r + i)
            w += model.run_line[bit(1 + n_b + runs[i]), y] + evidence[i] * y
        for i in range(len(lines)):
            p[i, bit(1 + n_b + n_r + i)] += np.exp(w)
    assert np.allclose(model.marginals(lines, evidence), p[:, 1] / p.sum(axis=1))


def test_dirty_rows(spark, model):
    rows = [("a", None, "# T\n\nThe body is here and it is long enough."), ("a", "t", "# T\n\nThe body is here and it is long enough."), ("b", None, None), ("c", "x", ""), ("d", "x", " \n\t\n"), (None, "x", "Skip to content"), ("e", "long", "word " * 200_000)]
    df = spark.createDataFrame(rows, "source_id string, title string, body string").selectExpr("*", "1 as lines", "2 as line_no")
    out = M.find_outside(df, model)
    assert out.columns == ["source_id", "line_no"] and out.where("source_id in ('a', 'b', 'c', 'd')").count() == 0
    assert {r["source_id"]: r["main_body"] for r in M.main_bodies(df.where("source_id in ('a', 'b')"), model).collect()} == {"a": rows[0][2], "b": None}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "source_id string, source_url string, title string, body string")
    assert M.p1_found(empty).count() == 0


def test_furniture_is_counted_over_all_documents(spark, monkeypatch):
    """Sites of which the sample holds one page: their menus are known all the same."""
    menu = "Menu of {0}\n\n# Page {1}\n\nThe page number {1} of {0} tells its own story here.\n\nLegal notes of {0}"
    pages = [(f"{s}-{n}", f"https://{s}.example/{n}", f"Page {n}", menu.format(s, "abcde"[n])) for s in (a + b for a in "abcdefghij" for b in "klmno") for n in range(5)]
    pages += [("twice", "https://once.example/1", "Only", "# Only\n\nOnly here\n\nThis page was fetched three times over.")] * 3
    df = spark.createDataFrame(pages, "source_id string, source_url string, title string, body string").repartition(3)
    seen = []
    monkeypatch.setattr(M, "MAX_LABELLED_PAGES", 4)
    monkeypatch.setattr(M, "fit", lambda *a: seen.append(list(M.label_pages(*a))))
    M.fit_model(df)
    labels = {l.text: y for lines, _, ys in seen[0] for l, y in zip(lines, ys)}
    legal = {t: y for t, y in labels.items() if t.startswith("Legal")}
    assert legal and set(legal.values()) == {1} and labels.get("Only here") is None
    all_lines = set().union(*(M.body_lines(b) for *_, b in pages))
    assert M.count_lines(df, all_lines) == M.counts_of([p[1:] for p in dict((p[0], p) for p in pages).values()])
