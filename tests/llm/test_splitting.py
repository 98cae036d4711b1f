import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import splitting as S


def checked(text, pieces, limit):
    """The pieces hold all but white space, in order, within the limit, overlapping no more than stated."""
    last = 0
    for k, p in enumerate(pieces):
        assert S.utf16_length(text[p.start : p.end]) <= limit.most
        assert p.fresh >= last and not text[last : p.fresh].strip() and p.start <= p.fresh < p.end
        assert S.utf16_length(text[p.start : p.fresh]) <= limit.overlap and (k or p.start == p.fresh)
        last = p.end
    assert not text[last:].strip()
    assert any(p.forced for p in pieces) == S.has_stretch(text, limit)


def whole(text, limit):
    n = max(1, math.ceil(len(text) / limit.range))
    out = []
    for k in range(n):
        at = 0 if k == 0 else k * limit.range - limit.most
        part = text if n == 1 else text[at : at + limit.range + 3 * limit.most]
        out += S.cut_range(part, at, k, k == n - 1, limit)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#。！é😀-;", max_size=400), st.integers(8, 60), st.integers(0, 8), st.booleans())
def test_any_text(text, most, overlap, code):
    limit = S.Limit(most * 2 // 3, most, min(overlap, most // 2), code)
    if text.strip():
        checked(text, S.cut_section(text, 0, len(text), limit), limit)


def test_ranges_stitch(monkeypatch):
    monkeypatch.setattr(S, "RANGE_LIMITS", 4)
    r = random.Random(5)
    text = "".join(r.choice(["word ", "longer-word ", "end. ", "\n\n", "\n## Head\n", "一二三。", "😀 "]) for _ in range(6000))
    limit = S.Limit(150, 220, 30)
    checked(text, whole(text, limit), limit)
    assert len(text) / limit.range > 20


def test_natural_places():
    text = "# A\n\n" + "One sentence is here. " * 12 + "\n\n# B\n\n" + "Two sentences are here. " * 12
    pieces = S.cut_section(text, 0, len(text), S.Limit(200, 300, 0))
    assert text[pieces[1].fresh :].startswith("# B") and all(text[p.end - 1] in ".A" for p in pieces)


def test_code_is_cut_before_declarations():
    text = "\n".join(f"def f{i}(x):\n    y = x\n\n    return y * {i}\n" for i in range(30))
    pieces = S.cut_section(text, 0, len(text), S.Limit(150, 260, 0, True))
    assert all(text[p.fresh :].startswith("def ") for p in pieces)


def test_dirty_rows(spark):
    s = "id string, item string, text string, target_tokens int, max_tokens int, overlap_tokens int, chars_per_token double"
    lim = (20, 30, 5, 2.0)
    rows = [("a", "prose", "word " * 60, *lim), ("a", "prose", "word " * 60, *lim), ("b", "prose", None, *lim), ("c", "prose", "", *lim), (None, "prose", "word " * 60, *lim), ("d", "prose", "x" * 200, *lim), ("e", "prose", "short", *lim), ("f", "prose", " " * 300, *lim), ("g", "code", "y " * 40_000, *lim)]
    df = spark.createDataFrame(rows, s).withColumnRenamed("id", "item_id").selectExpr("*", "1 as range_no", "2 as pieces", "3 as _n")
    out = S.split_items(df).orderBy("item_id", "piece_no").collect()
    by = {}
    for r in out:
        by.setdefault(r["item_id"], []).append(r)
    assert set(by) == {"a", "d", "g"} and all([r["piece_no"] for r in v] == list(range(1, len(v) + 1)) for v in by.values())
    assert all(r["size_tokens"] <= 30 for r in out) and any(r["forced"] for r in by["d"]) and not any(r["forced"] for r in by["a"])
    assert sum(len(r["text"][r["fresh_char"] - r["start_char"] :].replace(" ", "")) for r in by["g"]) == 40_000
    assert S.split_items(df.where("false")).count() == 0


def test_found(spark):
    drafts = spark.createDataFrame([("p", "word " * 80, None), ("c", "z" * 150, 3), ("c", "z" * 150, 3), ("s", "short", None), (None, "word " * 80, None)], "id string, content string, line_start int")
    docs = spark.createDataFrame([("d", " " * 900), ("n", None)], "source_id string, body string")
    limits = spark.createDataFrame([("prose", 20, 30, 5, 2.0), ("code", 20, 30, 0, 2.0), ("document", 50, 100, 5, 2.0)], "item string, target_tokens int, max_tokens int, overlap_tokens int, chars_per_token double")
    assert sorted((r["item_id"], r["cut"]) for r in S.p5_found(drafts, docs, limits).collect()) == [("c", "forced"), ("d", "natural"), ("p", "natural")]


@pytest.mark.parametrize("unit", ["plain words and more. ", "日本語の文です。", "émigré 😀 words\n\n"])
def test_files_by_byte_ranges(spark, tmp_path, unit):
    text = unit * 3000
    f = tmp_path / "giant.txt"
    f.write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    raw = text.encode()
    files = spark.createDataFrame([(str(f), len(raw)), (str(tmp_path / "empty.txt"), 0)], "path string, size long")
    out = S.split_files(files, S.Limit.of(100, 150, 10, 2.0), range_bytes=7001).orderBy("fresh_byte").collect()
    assert [r["piece_no"] for r in out] == list(range(1, len(out) + 1))
    last = 0
    for r in out:
        piece = raw[r["start_byte"] : r["end_byte"]].decode("utf-8")
        assert S.utf16_length(piece) <= 300 and not r["forced"]
        assert r["fresh_byte"] >= last and not raw[last : r["fresh_byte"]].decode().strip()
        last = r["end_byte"]
    assert not raw[last:].decode().strip()
    assert re.sub(r"\s", "", "".join(raw[r["fresh_byte"] : r["end_byte"]].decode() for r in out)) == re.sub(r"\s", "", text)


@pytest.mark.parametrize("size", [0.6, 0.9, 1.5, 1.9, 2.1, 3.4])
def test_stretches_over_a_range_start(monkeypatch, size):
    """A stretch within the limit is never cut, one above it is reported forced, wherever it lies."""
    monkeypatch.setattr(S, "RANGE_LIMITS", 4)
    limit = S.Limit(150, 220, 30)
    long = "x" * int(limit.most * size)
    for before in range(limit.range - len(long) - 20, limit.range + 20, 17):
        text = ("word " * before)[: before - 1] + " " + long + " " + "word " * 300
        pieces = whole(text, limit)
        checked(text, pieces, limit)
        assert size > 1 or sum(text[p.fresh : p.end].count("x") == len(long) for p in pieces) == 1


def test_found_by_ranges_as_by_the_whole(spark, tmp_path):
    most = 30
    text = ("w " * most * S.RANGE_LIMITS)[: most * S.RANGE_LIMITS - 22] + "y" * 43 + " w" * 80
    drafts = spark.createDataFrame([("p", text, None), ("q", text.replace("y" * 43, "y" * 20 + " " + "y" * 22), None)], "id string, content string, line_start int")
    docs = spark.createDataFrame([], "source_id string, body string")
    limits = spark.createDataFrame([("prose", 20, most, 5, 1.0)], "item string, target_tokens int, max_tokens int, overlap_tokens int, chars_per_token double")
    assert sorted((r["item_id"], r["cut"]) for r in S.p5_found(drafts, docs, limits).collect()) == [("p", "forced"), ("q", "natural")]
    f = tmp_path / "file.txt"
    f.write_text(text)
    files = spark.createDataFrame([(str(f), len(text))], "path string, size long")
    assert any(r["forced"] for r in S.split_files(files, S.Limit.of(20, most, 5, 1.0), range_bytes=most * S.RANGE_LIMITS).collect())


@pytest.mark.parametrize("limits", [57, 63, 65, 130, 400])
@pytest.mark.parametrize("length", [10, 30, 45, 55, 80, 99])
def test_no_word_is_cut_at_any_size(limits, length):
    limit = S.Limit(60, 100, 10)
    text = ("w" * length + " ") * (100 * limits // (length + 1))
    pieces = whole(text, limit)
    checked(text, pieces, limit)
    assert all(text[p.end : p.end + 1] in ("", " ") and not p.forced for p in pieces)


def test_files_and_rows_have_the_same_pieces(spark, tmp_path):
    r = random.Random(6)
    text = "".join(r.choice(["word ", "longer-word ", "end. ", "\n\n", "\n## Head\n", "x" * 50 + " "]) for _ in range(4000))
    most = 60
    rows = spark.createDataFrame([("a", "prose", text, 40, most, 8, 1.0)], "item_id string, item string, text string, target_tokens int, max_tokens int, overlap_tokens int, chars_per_token double")
    by_row = [tuple(x) for x in S.split_items(rows).orderBy("piece_no").select("piece_no", "start_char", "fresh_char", "end_char", "forced").collect()]
    f = tmp_path / "same.txt"
    f.write_text(text)
    files = spark.createDataFrame([(str(f), len(text))], "path string, size long")
    by_file = [tuple(x) for x in S.split_files(files, S.Limit.of(40, most, 8, 1.0), most * S.RANGE_LIMITS).orderBy("piece_no").select("piece_no", "start_byte", "fresh_byte", "end_byte", "forced").collect()]
    assert len(text) > 5 * most * S.RANGE_LIMITS and by_row == by_file


def test_bodies_written_to_files(spark):
    docs = spark.createDataFrame([("a", "One sentence is here. " * 80), ("b", None), ("c", "日本語の文です。" * 90), ("d", "")], "source_id string, body string")
    limits = spark.createDataFrame([("document", 50, 100, 5, 2.0)], "item string, target_tokens int, max_tokens int, overlap_tokens int, chars_per_token double")
    out = S.p5_files(docs, limits, range_bytes=500).collect()
    assert out and not any(r["forced"] for r in out)
    for file in {r["file"] for r in out}:
        assert sorted(r["piece_no"] for r in out if r["file"] == file) == list(range(1, 1 + sum(r["file"] == file for r in out)))
    assert S.p5_files(docs, limits.where("false")).count() == 0
