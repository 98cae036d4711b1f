import pytest
from pyspark.sql import functions as F

from quarrymill.functions import patterns
from quarrymill.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, terms",
    [
        ("Perché il Policy Manager", ["perche", "policy", "manager"]),
        ("ADR0010", ["adr0010", "adr", "0010"]),
        ("the of a", []),
        ("", []),
        (None, []),
        ("x y2k", ["y2k"]),
    ],
)
def test_tokens(spark, text, terms):
    assert one(spark, T.tokenize, text) == terms


@pytest.mark.parametrize("text, slug", [("Ciao, Mondo!", "ciao-mondo"), ("---", "untitled"), (None, "untitled"), ("Über È", "uber-e")])
def test_slug(spark, text, slug):
    assert one(spark, T.slugify, text) == slug


def test_redaction(spark):
    secret = "gl" + "pat-" + "a1B2c3D4e5F6g7H8i9J0"
    assert one(spark, T.redact, f"token {secret} end") == "token [REDACTED:forge-token] end"
    assert one(spark, T.redact, "nothing here") == "nothing here"


def test_language(spark):
    assert one(spark, T.detect_language, "il gatto e la casa di Mario che non è in un posto con le finestre") == "it"
    assert one(spark, T.detect_language, "the cat and the house of Mario that is not in a place with the windows") == "en"
    assert one(spark, T.detect_language, "short") == "und"
    assert one(spark, T.detect_language, None) == "und"


def test_tidy(spark):
    assert one(spark, T.tidy_markdown, "a\r\n\r\n\r\n\r\nb  \nc\\_d¶") == "a\n\nb\nc_d"


def test_heading(spark):
    assert one(spark, T.heading_text, "**Bold** `code` snake\\_case _it_") == "Bold code snake_case it"


def test_truncate(spark):
    cut = lambda c: T.truncate_at_line(c, 10)
    assert one(spark, cut, "short") == "short"
    assert one(spark, cut, "12345678\nabc") == "12345678"
    assert one(spark, cut, "1\n3456789012") == "1\n34567890"


def test_fence(spark):
    assert one(spark, T.fence_for, "no ticks") == "```"
    assert one(spark, T.fence_for, "has ```` four") == "`````"


@pytest.mark.parametrize("glob, path, ok", [("**/docs/**", "a/docs/b.md", True), ("**/docs/**", "docs/b.md", True), ("*.md", "a/b.md", False), ("a?c", "ABC", True), ("src/**/x.ts", "src/x.ts", True)])
def test_globs(spark, glob, path, ok):
    assert one(spark, lambda c: c.rlike(patterns.glob_regex(glob)), path) is ok


def test_code_language(spark):
    assert one(spark, T.code_language, "a/b/Main.KT") == "kotlin"
    assert one(spark, T.code_language, "Dockerfile") == "dockerfile"
    assert one(spark, T.code_language, "x.unknown") == ""
