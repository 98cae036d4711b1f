"""HTML pages as markdown, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that hold no text of the page.
_DROPPED = frozenset({"script", "style", "noscript", "svg", "iframe", "template", "link", "meta", "head"})
_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr", "area", "base", "embed", "source", "track"}
_BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "dl", "dt", "dd", "details", "summary", "form"}


class _Writer(HTMLParser):
    def __init__(self, base: str, root: str | None, dropped: frozenset[str] = _DROPPED):
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        self.base, self.root = base, root
        self.out: list[str] = []
        self.skip = 0
        self.depth = 0  # inside the root element
        self.lists: list[list] = []
        self.pre = ""
        self.href: list[str | None] = []
        self.rows: list[list[str]] | None = None
        self.quote: list[int] = []

    @property
    def live(self) -> bool:
        return not self.skip and (self.root is None or self.depth > 0)

    def put(self, text: str):
        if self.live:
            if self.rows is not None and self.rows and self.rows[-1]:
                self.rows[-1][-1] += text
            else:
                self.out.append(text)

    def gap(self):
        if self.rows is None:
            self.put("\n\n")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.dropped:
            if tag not in _VOID:
                self.skip += 1
            return
        if self.root and (self.depth or tag == self.root) and tag not in _VOID:
            self.depth += 1
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.gap()
            self.put("#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.gap()
            self.pre = "open"
            self.put("```")
        elif tag == "code":
            if self.pre == "open":
                language = re.search(r"(?:language|lang|brush)-(\w+)", a.get("class") or "")
                self.put((language[1] if language else "") + "\n")
                self.pre = "in"
            elif not self.pre:
                self.put("`")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag == "a":
            self.href.append(urljoin(self.base, a["href"]) if a.get("href") and not a["href"].startswith("#") else None)
            if self.href[-1]:
                self.put("[")
        elif tag == "img":
            if a.get("alt"):
                self.put(f"[image: {a['alt']}]")
        elif tag == "br":
            self.put("\n" if self.rows is None else " ")
        elif tag == "hr":
            self.gap()
            self.put("---")
            self.gap()
        elif tag in ("ul", "ol"):
            if not self.lists:
                self.gap()
            self.lists.append([tag, 0])
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "-"
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}."
            self.put("\n" + "  " * depth + mark + " ")
        elif tag == "input" and a.get("type") == "checkbox":
            self.put("[x] " if "checked" in a else "[ ] ")
        elif tag == "blockquote" or (tag == "div" and re.search(r"admonition|panel|note|warning", a.get("class") or "")):
            self.gap()
            self.quote.append(len(self.out))
        elif tag == "table":
            self.gap()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
        elif tag in _BLOCKS and not (self.lists and tag == "p"):
            self.gap()

    def handle_endtag(self, tag):
        if tag in self.dropped:
            self.skip = max(0, self.skip - 1)
            return
        if tag == "pre":
            self.put(("\n" if self.pre == "in" and not "".join(self.out[-1:]).endswith("\n") else "" if self.pre == "in" else "\n") + "```")
            self.pre = ""
            self.gap()
        elif tag == "code":
            if not self.pre:
                self.put("`")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag == "a" and self.href:
            href = self.href.pop()
            if href:
                self.put(f"]({href})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            if not self.lists:
                self.gap()
        elif (tag == "blockquote" or tag == "div") and self.quote and self.live:
            at = self.quote.pop()
            inner = "".join(self.out[at:]).strip()
            self.out[at:] = ["\n".join(("> " + l).rstrip() for l in re.sub(r"\n{3,}", "\n\n", inner).split("\n")), "\n\n"]
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] for r in self.rows if r], None
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                self.put("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
            self.gap()
        elif tag in _BLOCKS and not (self.lists and tag == "p"):
            self.gap()
        if self.root and self.depth and tag not in _VOID:
            self.depth -= 1

    def handle_data(self, data):
        if self.pre == "open":
            self.put("\n")
            self.pre = "in"
        self.put(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(page: str | None, base: str = "", roots: tuple[str, ...] = ("article", "main"), drop: tuple[str, ...] = ()) -> str | None:
    """Markdown of a page's ``article``, else ``main``, else body; scripts and styles dropped, and the elements named by ``drop``.

    Null stays null.  Links become absolute against ``base``.
    """
    if page is None:
        return None
    root = next((r for r in roots if re.search(rf"<{r}[\s>]", page, re.I)), None)
    w = _Writer(base, root, _DROPPED | frozenset(drop))
    w.feed(page)
    w.close()
    text = "".join(w.out)
    fences = re.split(r"(```.*?```)", text, flags=re.S)
    tidy = [p if p.startswith("```") else re.sub(r"\n[ \t]+(?=\S)(?![-\d])", "\n", re.sub(r"[ \t]+\n", "\n", p)) for p in fences]
    return re.sub(r"\n{3,}", "\n\n", "".join(tidy)).replace("¶", "").strip()


def pages_to_markdown(pages: DataFrame, html: str, base: str) -> DataFrame:
    """``pages`` with ``body``: the markdown of column ``html``, links absolute against column ``base``."""

    @F.pandas_udf("string")
    def convert(h, b):
        import pandas as pd

        return pd.Series([html_to_markdown(x if isinstance(x, str) else None, y if isinstance(y, str) else "") for x, y in zip(h, b)])

    return pages.withColumn("body", convert(F.col(html), F.col(base)))


def title_of(html: Column, fallback: Column) -> Column:
    """A page's title: its first ``h1``, else ``<title>`` up to the site's name, else ``fallback``."""
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), "[¶]", "")), F.lit(""))
    h1 = plain(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    title = plain(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+[-–|]\s+.*$", ""))
    return F.coalesce(h1, title, fallback)

