import random

import pytest

from quarrymill.llm import sentences as S

NAMES = ["The gateway", "Our portal", "A worker", "Each tenant", "ledgerline", "This call"]
DOES = ["stores the report", "rejects a link as Dr. Vell asked", "merges all rows e.g. in eu-west", "keeps 3.5 GB", "uses v2.0.1 (see sec. 4.2) daily", 'says "no. Stop it" to us', "works for Kestrel Inc.", "opens the Pronto! module"]


def make(n, seed):
    """Texts of paragraphs and their sentences' offsets."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for p in range(r.randrange(2, 6)):
            if text:
                text += "\n\n"
            for k in range(r.randrange(1, 5)):
                if k:
                    text += " "
                s = f"{r.choice(NAMES)} {r.choice(DOES)}"
                s = s if s.endswith(".") else s + r.choice([".", ".", "!", "?"])
                spans.append((len(text), len(text) + len(s)))
                text += s
        out.append((text, spans))
    return out


@pytest.fixture(scope="module")
def model():
    import numpy as np

    texts = [t for t, _ in make(400, 1)]
    arrays = [np.zeros(S.STAT_SLOTS, np.int32) for _ in range(3)]
    for a, c in zip(arrays, S.count_tokens(texts)):
        for k, v in c.items():
            a[k] = v
    st = S.Statistics(*arrays)
    return S.SentenceModel(st, S.fit_weights(texts, st))


def test_held_out(model):
    held = make(100, 2)
    want = {(i, s) for i, (_, spans) in enumerate(held) for s in spans}
    got = {(i, s) for i, spans in enumerate(S.split_all([t for t, _ in held], model)) for s in spans}
    assert len(want & got) / len(want) > 0.97 and len(want & got) / len(got) > 0.97


def pieces(text, model):
    return [text[a:b] for a, b in S.split(text, model)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("# Head\nThe gateway stores the report. Our portal keeps 3.5 GB.", ["# Head", "The gateway stores the report.", "Our portal keeps 3.5 GB."]),
        ("- one. two\n- three\n\nTitle only\n\n1) four\n2) five", ["- one. two", "- three", "Title only", "1) four", "2) five"]),
        ("台帳を保存します。「止めます。待ちます。」と書きます！次です", ["台帳を保存します。", "「止めます。待ちます。」と書きます！", "次です"]),
        ("งานรอผล ระบบเก็บขนาด 9.72 GB ทุกวัน\nจบ", ["งานรอผล", "ระบบเก็บขนาด 9.72 GB ทุกวัน", "จบ"]),
        ("पोर्टल रोकता है। सेवा रखती है।", ["पोर्टल रोकता है।", "सेवा रखती है।"]),
        ("The gateway stores\nthe report.", ["The gateway stores\nthe report."]),
        ("\n \n", []),
        ("", []),
        (None, []),
    ],
)
def test_layout_and_scripts(model, text, want):
    assert pieces(text, model) == want


def test_nesting():
    spans = lambda t: [t[a : b + 1] for a, b in S.nested(t)]
    assert spans('a (b "c" d) e') == ['(b "c" d)'] and spans("„x“ “y” «z»") == ["„x“", "“y”", "«z»"]
    assert spans("1) open ( only") == [] and spans('"a" and "b"') == ['"a"', '"b"']


def test_offsets_cover_everything(model):
    r = random.Random(9)
    for _ in range(200):
        text = "".join(r.choice(["word", " ", ".", "\n", "\n\n", "A", "»", "(", ")", "。", "ก", "😀", "- ", "3", "!"]) for _ in range(80))
        last = 0
        for a, b in S.split(text, model):
            assert a >= last and not text[last:a].strip() and text[a:b] == text[a:b].strip() != ""
            last = b
        assert not text[last:].strip()


def test_dirty_rows(spark, model):
    t = "The gateway stores the report. Our portal keeps 3.5 GB."
    rows = [(1, t), (2, t), (1, t), (3, None), (4, ""), (5, " \n"), (None, t), (6, t * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start_char", "2 as kind")
    out = S.split_documents(df, model)
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n[1] == 4 and n[2] == 2 and set(n) == {1, 2, 6} and n[6] > 20_000
    assert S.p8_found(df.where("false")).count() == 0


def test_whole_operator(spark):
    data = make(150, 4)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    got = {(r["doc_id"], r["start_char"], r["end_char"]) for r in S.p8_found(df).collect()}
    want = {(i, a, b) for i, (_, spans) in enumerate(data) for a, b in spans}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_stray_paragraphs_and_collisions_leave_the_negatives():
    """One paragraph that ends in an abbreviation, or a slot that other tokens fill, is no evidence that it ends sentences."""
    import numpy as np

    texts = [t for t, _ in make(2000, 1)] + ["The gateway waits for a Dr.", "Vell opens the report."]
    arrays = [np.zeros(S.STAT_SLOTS, np.int32) for _ in range(4)]
    for a, c in zip(arrays, S.count_tokens(texts)):
        for k, v in c.items():
            a[k] = v
    st = S.Statistics(*arrays)
    c = S.Candidate(3, "Dr", "Vell", ".", " ")
    assert S.silver(c, None, st) == (0, c)
    for a in arrays:  # every other slot holds a stranger's counts
        a[S._slots("Dr.")[0]] += 500
        a[S._slots("Vell")[0]] += 500
    assert S.silver(c, None, st) == (0, c)
    assert S.silver(S.Candidate(3, "report", "The", ".", " "), None, st) is None


def test_statistics_reach_the_driver_packed(spark, monkeypatch):
    """Every counter arrives, in far fewer rows than there are counters."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    letters = "abcdefghij"
    word = lambda i: "".join(letters[int(d)] for d in f"{i:05d}")
    texts = [f"The {word(i)}. {word(i + 1).title()} waits for a {word(i + 2)}.\n\nEach {word(i + 3)} ends." for i in range(3000)]
    rows = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: rows.append(len(found := collect(self))) or found)
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("counters came one by one"))
    st = S.token_statistics(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    for got, want in zip((st.seen, st.ends, st.starts, st.follows), S.count_tokens(texts)):
        assert got.dtype == np.int32 and len(got) == S.STAT_SLOTS and np.count_nonzero(got) == len(want)
        assert all(got[k] == v for k, v in want.items())
    assert sum(rows) <= 4 * S.STAT_SLOTS // S.PACKED_SLOTS
