import os

import numpy as np
import pytest

from quarrymill.llm import mixing as X
from quarrymill.llm import packing as P
from quarrymill.llm import tokens as T

needs_vocabulary = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary here")


@pytest.mark.parametrize("seed", range(6))
def test_packing_keeps_all_limits(seed):
    r = np.random.default_rng(seed)
    n = 600
    tokens = r.integers(1, 500, n).astype(float)
    sizes = np.stack([tokens, np.ones(n), np.floor(tokens * r.uniform(0, 1, n))], axis=1)
    limits = np.array([512.0, 6.0, 300.0])
    sizes[:, 2] = np.minimum(sizes[:, 2], 300)
    bins = P.pack(sizes, limits)
    used = np.stack([np.bincount(bins, weights=sizes[:, k]) for k in range(3)], axis=1)
    assert (used <= limits + 1e-6).all() and (used[:, 1] > 0).all()
    # No worse than first fit decreasing on the dimension that is short.
    least = max(np.ceil(sizes.sum(axis=0) / limits))
    assert bins.max() + 1 <= 1.15 * least + 1


def test_packing_edges():
    assert list(P.pack(np.array([[512.0, 1, 0]]), np.array([512.0, 1, 1]))) == [0]
    assert P.pack(np.zeros((0, 3)), np.ones(3)).tolist() == []
    same = P.pack(np.array([[1.0, 1, 1]] * 1000), np.array([100.0, 100, 100]))
    assert same.max() == 9 and (np.bincount(same) == 100).all()


@needs_vocabulary
@pytest.mark.parametrize("text", ["one two  three\n\n four!! 12345 ", "日本語の文です。改行\n", "ภาษาไทยไม่มีช่องว่าง", "x" * 37 + " ", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODkw/+=="])
def test_long_texts_have_the_tokenizers_own_tokens(monkeypatch, text):
    whole = text * 60
    want = T.tokenizer().encode_ordinary(whole)
    longest = max(m.end() - m.start() for m in T._words().finditer(whole))
    monkeypatch.setattr(T, "LONGEST", max(longest, 100))
    spans = list(T.parts(whole, T.LONGEST))
    assert list(T.encode(whole)) == want
    assert spans[0][0] == 0 and spans[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and max(b - a for a, b in spans) <= T.LONGEST


def test_a_word_above_the_longest_part_is_cut():
    assert list(T.parts("ab " + "x" * 25 + " cd", 10)) == [(0, 2), (2, 12), (12, 22), (22, 31)]
    assert list(T.parts("", 10)) == []


@needs_vocabulary
def test_three_limits_that_bind(spark):
    long = [(i, ("# only a heading here\n" * (i % 5)) + "words that bear loss " * (i % 40)) for i in range(300)]
    df = spark.createDataFrame(long + [(900 + i, "all of it bears loss " * 45) for i in range(3)], "doc_id long, text string")
    caps = spark.createDataFrame([("s", 192)], "container string, capacity_tokens int")
    r = P.p6_limits(df, caps).collect()[0]
    assert r["alone"] == 3 and r["most_alone"] == 1 and r["by_loss"] + r["by_segments"] > 0 and max(r["fill_tokens"], r["fill_loss"], r["fill_segments"]) <= 1
    assert P.p6_limits(df.where("false"), caps).count() == 0


@needs_vocabulary
def test_parts_and_loss():
    parts = P.text_parts("# Heading words\nbody text that bears loss\n" * 40, [64, 100_000])
    small, large = [p for p in parts if p[0] == 64], [p for p in parts if p[0] == 100_000]
    assert len(large) == 1 and sum(p[3] for p in small) == large[0][3] and sum(p[4] for p in small) == large[0][4] < large[0][3]
    assert [p[2] for p in small] == [64 * k for k in range(len(small))] and all(p[3] == 64 for p in small[:-1])
    assert P.text_parts(None, [64]) == P.text_parts("", [64]) == []


@needs_vocabulary
def test_every_text_once(spark):
    texts = ["one two three " * k for k in range(1, 120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (None, "lost"), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bin", "2 as grp", "3 as tokens")
    caps = spark.createDataFrame([("s", 100), ("l", 400)], "container string, capacity_tokens int")
    out = P.p6_packing(df, caps).toPandas()
    for kind, cap in (("s", 100), ("l", 400)):
        own = out[out.kind == kind]
        assert own.groupby("container").tokens.sum().max() <= cap
        assert own.tokens.sum() == sum(T.count(t) for _, t in rows if t and t != "lost")
        split = own.groupby("doc_id").part.nunique()
        assert {d for d, n in split.items() if n > 1} == {d for d, t in enumerate(texts) if T.count(t) > cap}
    assert P.p6_packing(df.where("false"), caps).count() == 0


@needs_vocabulary
def test_segments_and_loss_are_limits_too(spark):
    df = spark.createDataFrame([(i, ("# head of it\n" * (i % 4)) + f"short text {i} " * (1 + i % 9)) for i in range(400)], "doc_id long, text string")
    out = P.pack_documents(df, [256], tokens_a_segment=64, loss_share=0.5).toPandas()
    g = out.groupby("container").agg(tokens=("tokens", "sum"), loss=("loss_tokens", "sum"), n=("doc_id", "count"))
    assert g.tokens.max() <= 256 and g.n.max() <= 4 and g.loss.max() <= 128 and len(out) == 400


def test_poisson_inverse():
    u = (np.arange(100_000) + 0.5) / 100_000
    for mean in (0.0, 0.3, 1.7, 4.0):
        c = X.poisson_counts(u, mean, 50)
        assert abs(c.mean() - mean) < 0.01 and (abs(c.var() - mean) < 0.05)
    assert X.poisson_counts(u, 5.0, 2).max() == 2 and (X.poisson_counts(u, float("inf"), 3) == 3).all()


@needs_vocabulary
def test_shares(spark):
    rows = [(i, f"text number {i} " * (1 + i % 7), ["Big", "mid ", "small", None, "other"][0 if i % 10 < 6 else 1 if i % 10 < 8 else 2 if i % 10 == 8 else 3 + i // 10 % 2]) for i in range(4000)] + [(9000, None, "big"), (9001, "", "mid"), (None, "x", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n", "2 as u", "3 as copy")
    aims = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.35, 3), ("none there", 0.05, 2)], "source string, target_share double, max_repeats int")
    out = {r["source"]: r for r in X.p7_shares(df, aims).collect()}
    for s, share in (("big", 0.3), ("mid", 0.3), ("small", 0.35)):
        assert abs(out[s]["actual_share"] - share / 0.95) < 0.01
    assert out["none there"]["actual_share"] == 0 and 2 <= out["small"]["most_copies"] <= 3 and out["small"]["mean"] < 100 and out["big"]["most_copies"] == 1
    mixture, _ = X.mix(df, aims)
    again, _ = X.mix(df, aims)
    assert mixture.exceptAll(again).count() == 0 and {r["source"] for r in mixture.select("source").distinct().collect()} == {"big", "mid", "small"}
    places = [r["place"] for r in X.p7_mixture(df, aims).collect()]
    assert places == sorted(places) and len(places) == mixture.count()
    assert X.p7_mixture(df.where("false"), aims).count() == 0
