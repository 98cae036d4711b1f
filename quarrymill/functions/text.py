"""Text expressions, all inside the JVM: they fuse into whole-stage code and push no row to Python."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


@lru_cache(1)
def folding() -> tuple[str, str]:
    """(from, to): the characters whose compatibility decomposition, without U+0300 to U+036F, is one character.

    Characters that decompose into several (ligatures, voiced kana) stay as they are.
    """
    a, b = [], []
    for i in range(0xA0, min(sys.maxunicode, 0xFFFF) + 1):
        if 0xAC00 <= i < 0xD7A4 or 0xD800 <= i < 0xE000:
            continue
        ch = chr(i)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(c) < 0x370)
        if len(base) == 1 and base != ch and base not in "\\'" and base.isalnum():
            a.append(ch)
            b.append(base)
    return "".join(a), "".join(b)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    a, b = folding()
    return F.lower(F.translate(F.regexp_replace(text, "[\\u0300-\\u036f]", ""), a, b))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _kept(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.isin(V.STOP_WORDS)  # becomes a hash set


def tokenize(text: Column) -> Column:
    """Terms of a text: folded words of two characters or more that are no stop words.

    A word of letters and digits gives its runs besides itself: ``adr0010, adr, 0010``.
    """
    kept = F.filter(words(fold(F.coalesce(text, F.lit("")))), _kept)

    def parts(word: Column) -> Column:
        runs = F.filter(F.regexp_extract_all(word, F.lit(r"\p{L}+|\p{N}+"), F.lit(0)), _kept)
        mixed = word.rlike(r"\p{L}") & word.rlike(r"\p{N}")
        return F.when(mixed, F.concat(F.array(word), runs)).otherwise(F.array(word))

    return F.flatten(F.transform(kept, parts))


def slugify(text: Column, most: int = 80) -> Column:
    s = F.regexp_replace(fold(text), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def duplicate_key(text: Column) -> Column:
    """Key of bodies that are equal but for case, comments and punctuation."""
    s = F.regexp_replace(F.lower(text), r"(?s)<!--.*?-->", "")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def tidy_markdown(text: Column) -> Column:
    s = F.regexp_replace(text, "\r\n?", "\n")
    s = F.regexp_replace(s, " ", " ")
    s = F.regexp_replace(s, "[​-‍﻿]", "")
    s = F.regexp_replace(s, "(?m)[ \t]*¶[ \t]*$", "")
    s = F.regexp_replace(s, r"\\_", "_")
    s = F.regexp_replace(s, "(?m)[ \t]+$", "")
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def clean_prose(text: Column) -> Column:
    """Body of a page as it is indexed: no comments, no escaped underscores, no runs of blank lines."""
    s = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    s = F.regexp_replace(s, r"\\_", "_")
    s = F.regexp_replace(s, "(?m)[ \t]+$", "")
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def language_counts(text: Column) -> tuple[Column, Column]:
    """(Italian, English) function words outside code and urls."""
    s = F.regexp_replace(text, r"(?s)```.*?```", " ")
    s = F.regexp_replace(s, r"`[^`]*`", " ")
    s = F.lower(F.regexp_replace(s, r"https?://\S+", " "))
    found = F.split(s, r"[^a-zàèéìòù']+")
    count = lambda known: F.size(F.filter(found, lambda w: w.isin(known)))
    return count(V.ITALIAN_WORDS), count([w for w in V.ENGLISH_WORDS if w not in V.ITALIAN_WORDS])


def detect_language(text: Column, least: int = 8, ratio: float = 1.5) -> Column:
    it, en = language_counts(F.coalesce(text, F.lit("")))
    return F.when(it + en < least, "und").when(it >= en * F.lit(ratio), "it").when(en >= it * F.lit(ratio), "en").otherwise("und")


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)


def estimate_tokens(text: Column, code: Column | None = None) -> Column:
    """Tokens by the length in UTF-16 units."""
    n = utf16_length(text)
    prose = F.ceil(n / F.lit(V.CHARS_PER_TOKEN))
    return prose if code is None else F.when(code, F.ceil(n / F.lit(V.CODE_CHARS_PER_TOKEN))).otherwise(prose)


def heading_text(text: Column) -> Column:
    s = F.regexp_replace(text, r"\\_", "_")
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}_])__?([^_]+?)__?(?![\p{L}\p{N}_])", "$1")
    return F.trim(F.regexp_replace(s, r"[*`]", ""))


def excerpt(text: Column, most: int) -> Column:
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def truncate_at_line(text: Column, most: int) -> Column:
    """Cut to ``most`` characters, at the last line end when that keeps more than half."""
    head = F.substring(text, 1, most)
    last = F.length(head) - F.locate("\n", F.reverse(head))
    return F.when(F.length(text) <= most, text).when((F.locate("\n", head) > 0) & (last > most * 0.5), F.substring(head, F.lit(1), last)).otherwise(head)


def normalised_id(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def redact(text: Column) -> Column:
    """Secrets replaced by ``[REDACTED:rule]``, rule after rule."""
    for name, pattern in V.SECRET_RULES:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{name}]")
    return text


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def looks_generated(title: Column, body: Column) -> Column:
    head, tail = F.substring(body, 1, 3000), F.substring(body, -1500, 1500)
    return any_match(F.trim(title), V.GENERATED_TITLES) | any_match(head, V.GENERATED_BODIES) | any_match(tail, V.GENERATED_BODIES)


def boilerplate_readme(body: Column) -> Column:
    return any_match(F.substring(body, 1, 4000), V.BOILERPLATE_READMES)


def looks_like_abstention(text: Column) -> Column:
    return any_match(F.lower(F.substring(text, 1, 600)), V.ABSTENTIONS)


def code_language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in V.CODE_LANGUAGES.items() for x in kv])
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    special = F.when(name == "dockerfile", "dockerfile").when(name == "makefile", "makefile").when(name == "jenkinsfile", "groovy")
    return F.coalesce(special, known[F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)], F.lit(""))


def fence_for(code: Column) -> Column:
    """A fence longer than any run of backticks in ``code``."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
