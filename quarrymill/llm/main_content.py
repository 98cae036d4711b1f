"""Problem 1: the lines of a fetched page that do not belong to its main body.

Method: a tree-structured graphical model.  A page is the root, the blocks
between its blank lines are its children, runs of lines of one form (with the
line that leads them in) are theirs, and the lines are the leaves; each node is
main body or not.  A leaf's evidence is a maximum-entropy classifier over the
line; parent-child potentials connect the nodes; one sum-product pass up and
one down give each line's marginal.

Both are trained from labelled pages: a bounded sample (``MAX_LABELLED_PAGES``)
in which repository files are main body throughout, what stands before a site
page's own title is not, and short lines that several pages of one site share,
while no repository file has them, are not.  Which of the sample's lines those
are is counted over all documents.

Pages are independent once the model is fitted: no shuffle but those that
count a page once, however often it was fetched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import maxent
from .common import hash_sample

#: Bound of the pages that the model is fitted on (smallest hashes of the source id first).
MAX_LABELLED_PAGES = 4_000
#: Longer pages do not serve to fit it.
MAX_LABELLED_CHARS = 40_000
SLOTS = 1 << 16
#: Pages of one site that must share a short line before it counts as the site's.
SHARED_BY = 3
#: No edge is surer than this that parent and child agree.
LEAST_POTENTIAL = 0.02

_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_LINK_ONLY = re.compile(r"^\s*(?:[-*+•]\s+)?\[[^\]]*\]\([^)]*\)\s*$")
_LINKS = re.compile(r"\[[^\]]*\]\([^)]*\)")
_COUNTED = re.compile(r"^\s*(?:[-*+•]\s+)?.{1,80}\(\d+\)\s*$")
_SEPARATED = re.compile(r"\s(?:\||•|·)\s")
_TRAIL = re.compile(r"\s(?:›|>|/|»|→)\s")
_ENDS = ".!?:;…。！？"
_WORD = re.compile(r"[^\W\d_]+")
_DATE = re.compile(r"\b\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\b")


@dataclass(slots=True)
class Line:
    no: int  # from 1
    text: str
    form: str
    block: int
    run: int
    words: list[str]
    closed: bool  # by a mark


def parse(body: str) -> list[Line]:
    """The non-blank lines of a body with their place in the tree."""
    out: list[Line] = []
    fence = ""
    block, run = 0, 0
    blank = True
    for no, raw in enumerate(body.split("\n"), 1):
        text = raw.strip()
        if not text:
            blank = blank or not fence
            continue
        mark = re.match(r"(`{3,}|~{3,})", text)
        if fence:
            form = "code"
            if mark and text.startswith(fence):
                fence = ""
        elif mark:
            form, fence = "code", mark[1]
        else:
            form = ""
        words, closed = _WORD.findall(text.lower()), _closed(text)
        form = form or _form(text, len(words), closed)
        last = out[-1] if out else None
        if blank and last and not (form == "code" and last.form == "code"):
            block += 1
        if last and (block != last.block or not _same_run(last, form, out)):
            run += 1
        blank = False
        out.append(Line(no, text, form, block, run, words, closed))
    return out


def _closed(text: str) -> bool:
    return text.rstrip("\"'»”)]")[-1:] in _ENDS and text.rstrip("\"'»”)]") != ""


def _form(text: str, words: int, closed: bool) -> str:
    first = text[0]
    if first == "#":
        return "heading"
    if first == "|":
        return "table"
    if first == ">":
        return "quote"
    if first in "©←→↑↓⇧" or text.startswith(("(c) ", "(C) ")):
        return "signed"
    if "](" in text:
        if _LINK_ONLY.match(text):
            return "link"
        links = _LINKS.findall(text)
        if len(links) > 1 and words - len(_WORD.findall(" ".join(links))) < 3:
            return "links"
    item = _ITEM.match(text)
    if item and text[-1] == ")" and _COUNTED.match(text):
        return "counted"
    if item:
        return "item" if words > 4 or closed else "short-item"
    if words < 40:
        if _SEPARATED.search(text):
            return "separated"
        if not closed and _TRAIL.search(text):
            return "trail"
    return "prose" if closed and words >= 4 or words > 12 else "short"


def _same_run(last: Line, form: str, out: list[Line]) -> bool:
    if form == last.form:
        return form != "heading"
    leads = last.form == "short" and (len(out) < 2 or out[-2].run != last.run)
    return leads and form in ("link", "links", "counted", "short-item", "item")


def title_at(lines: list[Line], title: str | None) -> int | None:
    """Index of the page's own title: its first level-1 heading, the line equal to ``title``, or to the end of a trail above."""
    wanted = title.strip().casefold() if title else None
    trails = set()
    for i, l in enumerate(lines):
        bare = l.text.lstrip("#").strip().casefold()
        if l.form != "code" and (re.match(r"#\s", l.text) or (wanted and bare == wanted and l.form in ("short", "heading", "prose"))):
            return i
        if l.form == "short" and bare in trails:
            return i
        if l.form == "trail":
            trails.add(re.split(r"\s(?:›|>|/|»|→)\s", l.text)[-1].strip().casefold())
    return None


def masked(text: str) -> str:
    return re.sub(r"\d+", "0", text.casefold())


#: Slots of a page's lines: (slots, the line that each belongs to).
Slots = tuple[np.ndarray, np.ndarray]


@lru_cache(1 << 18)
def _slot(feature: str) -> int:
    return maxent.slot(feature, SLOTS)


@lru_cache(1 << 18)
def _word(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _word_slots(lines: list[Line]) -> Slots:
    """Slots of the words of each line, each once, and of its pairs of neighbouring words; code has none."""
    own = [(i, l.words) for i, l in enumerate(lines) if l.form != "code" and l.words]
    words = np.array([_word(w) for _, ws in own for w in ws], np.uint64)
    owner = np.repeat(np.array([i for i, _ in own], np.int64), [len(ws) for _, ws in own])
    single = _spread(words) + (owner << 32)
    pairs = (owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
    double = (_spread(words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:]) + (owner[1:] << 32))[pairs]
    both = np.sort(np.concatenate([single, double]))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return (both & 0xFFFFFFFF).astype(np.int32), both >> 32


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)


def line_slots(lines: list[Line]) -> Slots:
    """Features of each line by itself and its neighbours: its words, its form, what leads its run in."""
    rows: list[list[int]] = []
    n = len(lines)
    leads = lead_lines(lines)
    texts = [masked(l.text) if l.form != "code" else "" for l in lines]
    for i, l in enumerate(lines):
        prev = lines[i - 1].form if i else "start"
        nxt = lines[i + 1].form if i + 1 < n else "stop"
        size = min(len(l.words), 14)
        alone = (i == 0 or lines[i - 1].block != l.block) and (i + 1 == n or lines[i + 1].block != l.block)
        f = ["bias", f"form={l.form}", f"size={size}", f"form+size={l.form}+{size}", f"prev+form+next={prev}+{l.form}+{nxt}", f"alone={alone}+{l.form}", f"closed={l.closed}+{l.form}"]
        if l.form != "code":
            f += [f"sign={sign}" for sign in "©←→|•·›" if sign in l.text]
            if _DATE.search(l.text):
                f.append(f"date+short={size < 8}")
            lead = leads[i]
            if lead < i:
                few = len(lines[lead].words) < 6
                f.append(f"lead={texts[lead]}" if few else "lead=long")
                f += [f"leadw={w}" for w in lines[lead].words] if few else []
                f.append(f"lead+form={lines[lead].form}+{l.form}")
        own = [_slot(x) for x in f]
        if l.form != "code":
            own.append(maxent.slot(f"line={texts[i]}", SLOTS))
        rows.append(own)
    return _joined(_flat(rows), _word_slots(lines))


def _flat(rows: list[list[int]]) -> Slots:
    return np.array([x for r in rows for x in r], np.int32), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _joined(a: Slots, b: Slots) -> Slots:
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])


def _odds(slots: Slots, weights: np.ndarray, n: int) -> np.ndarray:
    """Log odds of each of ``n`` lines."""
    return np.bincount(slots[1], weights=weights[slots[0]], minlength=n)


def _by_line(slots: Slots, n: int) -> list[np.ndarray]:
    order = np.argsort(slots[1], kind="stable")
    return np.split(slots[0][order], np.cumsum(np.bincount(slots[1], minlength=n))[:-1])


def lead_lines(lines: list[Line]) -> list[int]:
    """Index of the first line of each line's run."""
    out: list[int] = []
    for i, l in enumerate(lines):
        out.append(out[-1] if i and lines[i - 1].run == l.run else i)
    return out


def zones(lines: list[Line], title: int | None, first_odds: np.ndarray) -> list[list[str]]:
    """Features of each line's place between the first and the last line that are surely main body.

    ``first_odds`` are the odds by the line alone; with them, a page needs no title for its body to be found.
    """
    sure = [i for i, (l, o) in enumerate(zip(lines, first_odds)) if o < -1.5 and l.form not in ("link", "links", "counted", "separated", "trail", "signed", "short", "short-item")]
    begin, end = (sure[0], sure[-1]) if sure else (len(lines), -1)
    if title is not None and title < begin:
        begin = title
    out = []
    for i, l in enumerate(lines):
        zone = "title" if i == title else "none" if not sure and title is None else "head" if i < begin - 1 else "brink" if i < begin else "tail" if i > end else "body"
        after = "-" if i + 1 >= len(lines) else "out" if first_odds[i + 1] > 1.5 else "in" if first_odds[i + 1] < -1.5 else "?"
        before = "-" if i == 0 else "out" if first_odds[i - 1] > 1.5 else "in" if first_odds[i - 1] < -1.5 else "?"
        own = "out" if first_odds[i] > 3 else "in" if first_odds[i] < -3 else "?"
        out.append([f"zone={zone}", f"zone+form={zone}+{l.form}", f"zone+around={zone}+{before}+{after}", f"around+form={before}+{l.form}+{after}", f"own+around={before}+{own}+{after}", f"own={own}"])
    return out


@dataclass(frozen=True)
class ContentModel:
    first: np.ndarray  # weights by the line and its neighbours
    weights: np.ndarray  # weights with its zone
    #: log potentials [parent label][child label]; label 1 is "not main body"
    root: np.ndarray
    page_block: np.ndarray
    block_run: np.ndarray
    run_line: np.ndarray

    def marginals(self, lines: list[Line], evidence: np.ndarray) -> np.ndarray:
        """P(not main body) of each line, by one sum-product pass up the tree and one down.

        ``evidence`` holds each line's log odds.
        """
        leaf = np.stack([np.zeros(len(lines)), np.clip(evidence, -12, 12)], axis=1)
        runs, blocks = np.array([l.run for l in lines]), np.array([l.block for l in lines])
        n_runs, n_blocks = runs[-1] + 1, blocks[-1] + 1
        of_run = np.zeros(n_runs, int)
        of_run[runs] = blocks
        up_line = _through(leaf, self.run_line)
        run = _sums(up_line, runs, n_runs)
        up_run = _through(run, self.block_run)
        block = _sums(up_run, of_run, n_blocks)
        up_block = _through(block, self.page_block)
        page = self.root + up_block.sum(axis=0)
        # Down: what a node hears from its parent is all the parent knows but the node's own message.
        to_block = _through(page - up_block, self.page_block.T)
        belief_block = block + to_block
        to_run = _through(belief_block[of_run] - up_run, self.block_run.T)
        belief_run = run + to_run
        to_line = _through(belief_run[runs] - up_line, self.run_line.T)
        belief = leaf + to_line
        return 1 / (1 + np.exp(belief[:, 0] - belief[:, 1]))


def _through(message: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """A message of child labels, seen through the edge's potential: by parent label."""
    x = message[:, None, :] + potential[None]
    top = x.max(axis=2)
    return top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))


def _sums(message: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights=message[:, k], minlength=n) for k in (0, 1)], axis=1)


def is_repository_file(url: str | None) -> bool:
    return bool(url and re.search(r"/(?:blob|raw|tree)/", url))


def site_of(url: str | None) -> str:
    m = re.match(r"(?i)^[a-z]+://([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


@dataclass(frozen=True)
class LineCounts:
    """What the collection says of a sample's lines, by their hashes."""

    in_files: set[int]  # lines of some repository file
    shared: set[int]  # lines of SHARED_BY pages of some one site


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)  # as a signed long


def body_lines(body: str) -> set[int]:
    """Hashes of the non-blank lines of a body, as they are compared between pages."""
    return {line_hash(_bare(t)) for raw in body.split("\n") if (t := raw.strip())}


def site_lines(url: str | None, body: str, wanted: set[int] | None = None) -> tuple[str, set[int]]:
    """(site, line hashes) of a page; a repository file's site is ``_FILES``, and "" says that the page has none."""
    site = _FILES if is_repository_file(url) else site_of(url)
    lines = body_lines(body) if site else set()
    return site, lines if wanted is None else lines & wanted


_FILES = "/"  # no host


def counts_of(pages: list[tuple[str | None, str | None, str]]) -> LineCounts:
    """The counts when ``pages`` are the whole collection."""
    shared: Counter = Counter()
    for url, _, body in pages:
        site, lines = site_lines(url, body)
        shared.update((site, h) for h in lines)
    return LineCounts({h for site, h in shared if site == _FILES}, {h for (site, h), n in shared.items() if site not in ("", _FILES) and n >= SHARED_BY})


def count_lines(documents: DataFrame, wanted: set[int]) -> LineCounts:
    """The counts of the lines ``wanted`` over all documents.

    A task sends on at most ``SHARED_BY`` pages of a site and line, which is all that the threshold asks,
    and only lines of the sample, so neither shuffle nor result grows with the texts.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(wanted)  # lines of the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: dict[tuple[str, int], set] = {}
        for b in batches:
            rows = []
            for key, url, body in zip(b["source_id"], b["source_url"], b["body"]):
                site, lines = site_lines(url, body, shipped.value)
                for h in lines:
                    pages = sent.setdefault((site, h), set())
                    if key not in pages and len(pages) < (1 if site == _FILES else SHARED_BY):
                        pages.add(key)
                        rows.append((site, h, key))
            if len(sent) > _MOST_SENT:
                sent.clear()
            yield pd.DataFrame(rows, columns=["site", "line", "source_id"])

    pages = documents.where(F.col("source_id").isNotNull() & (F.length("body") > 0)).select("source_id", "source_url", "body")
    counted = pages.mapInPandas(run, "site string, line long, source_id string").groupBy("site", "line").agg(F.count_distinct("source_id").alias("n"))
    kept = counted.where((F.col("site") == _FILES) | (F.col("n") >= SHARED_BY)).select((F.col("site") == _FILES).alias("file"), "line").distinct().collect()
    return LineCounts({r["line"] for r in kept if r["file"]}, {r["line"] for r in kept if not r["file"]})


#: Sites and lines that a task remembers at once; it forgets them all above that and sends some pages again.
_MOST_SENT = 500_000


def label_pages(pages: list[tuple[str | None, str | None, str]], counts: LineCounts | None = None) -> Iterator[tuple[list[Line], int | None, list[int | None]]]:
    """Lines, title and labels (0 main body, 1 not, None unknown) of (url, title, body) pages.

    Without ``counts`` the pages are the whole collection.
    """
    counts = counts or counts_of(pages)
    in_files = lambda text: line_hash(text) in counts.in_files
    furniture = lambda text: line_hash(text) in counts.shared and not in_files(text)
    for url, wanted, body in pages:
        lines = parse(body)
        if not lines:
            continue
        title = title_at(lines, wanted)
        if is_repository_file(url):
            yield lines, title, [0] * len(lines)
            continue
        labels: list[int | None] = []
        leads = lead_lines(lines)
        for i, l in enumerate(lines):
            text = _bare(l.text)
            lead = leads[i]
            boxed = lead < i and lines[lead].form == "short" and l.form in ("link", "links", "counted", "short", "short-item") and furniture(_bare(lines[lead].text))
            if (title is not None and i < title) or boxed:
                labels.append(1)
            elif i == title or l.form in ("code", "table", "heading", "quote"):
                labels.append(0)
            elif furniture(text) and l.form != "item" and len(l.words) <= 16:
                labels.append(1)
            elif l.form in ("prose", "item") and len(l.words) >= 5 and "©" not in l.text:
                labels.append(0)
            elif l.form == "short" and in_files(text) and lead == i and (i + 1 == len(lines) or lines[i + 1].run != l.run or lines[i + 1].form == "item"):
                labels.append(0)  # a heading without its mark
            else:
                labels.append(None)
        yield lines, title, labels


def _bare(text: str) -> str:
    return masked(text.lstrip("#").strip())


def _second(lines: list[Line], title: int | None, plain: Slots, first_odds: np.ndarray) -> Slots:
    return _joined(plain, _flat([[_slot(x) for x in f] for f in zones(lines, title, first_odds)]))


def fit(pages: list[tuple[str | None, str | None, str]], counts: LineCounts | None = None) -> ContentModel:
    labelled, plain = [], []
    for lines, title, labels in label_pages(pages, counts):
        plain.append(line_slots(lines))
        for l in lines:  # from here on only their forms and places are asked for
            l.text, l.words = "", []
        labelled.append((lines, title, labels))
    known = [(k, i, label) for k, (_, _, labels) in enumerate(labelled) for i, label in enumerate(labels) if label is not None]
    rows = lambda slots: [own[i] for (_, _, labels), x in zip(labelled, slots) for own in [_by_line(x, len(labels))] for i, label in enumerate(labels) if label is not None]
    first = maxent.fit(rows(plain), [label for _, _, label in known], SLOTS, epochs=4)
    full = plain
    for k, (lines, title, _) in enumerate(labelled):  # in place: one copy of the features at a time
        full[k] = _second(lines, title, plain[k], _odds(plain[k], first, len(lines)))
    weights = maxent.fit(rows(full), [label for _, _, label in known], SLOTS, epochs=4)
    # The potentials are counted where labels are known; unknown lines take the classifier's label.
    root, page_block, block_run, run_line = np.ones(2), np.ones((2, 2)), np.ones((2, 2)), np.ones((2, 2))
    for (lines, title, labels), x in zip(labelled, full):
        guess = _odds(x, weights, len(lines)) > 0
        final = [int(g) if l is None else l for l, g in zip(labels, guess)]
        runs, blocks = defaultdict(list), defaultdict(list)
        for l, v in zip(lines, final):
            runs[l.run].append(v)
            blocks[l.block].append(v)
        major = lambda vs: int(sum(vs) * 2 > len(vs))
        page = major(final)
        root[page] += 1
        for b in blocks.values():
            page_block[page, major(b)] += 1
        seen = set()
        for l, v in zip(lines, final):
            run_line[major(runs[l.run]), v] += 1
            if l.run not in seen:
                seen.add(l.run)
                block_run[major(blocks[l.block]), major(runs[l.run])] += 1
    norm = lambda t: np.log(np.clip(t / t.sum(axis=-1, keepdims=True), LEAST_POTENTIAL, 1))
    return ContentModel(first, weights, norm(root), norm(page_block), norm(block_run), norm(run_line))


def fit_model(documents: DataFrame) -> ContentModel:
    """The model from a bounded sample of ``source_id, source_url, title, body`` rows, its lines counted over all of them."""
    rows = hash_sample(documents.where(F.length("body").between(1, MAX_LABELLED_CHARS)).select("source_id", "source_url", "title", "body"), "source_id", MAX_LABELLED_PAGES, documents.count()).collect()
    once = {r["source_id"]: (r["source_url"], r["title"], r["body"]) for r in rows}  # a page fetched again is no second page of its site
    pages = list(once.values())
    return fit(pages, count_lines(documents, set().union(*(body_lines(body) for _, _, body in pages))))


def outside_lines(bodies: list[str | None], titles: list[str | None], model: ContentModel) -> list[list[int]]:
    """The numbers of the non-blank lines of each body that are not main body; null and blank bodies have none."""
    out: list[list[int]] = []
    for body, title in zip(bodies, titles):
        lines = parse(body) if isinstance(body, str) else []
        if not lines:
            out.append([])
            continue
        plain = line_slots(lines)
        full = _second(lines, title_at(lines, title if isinstance(title, str) else None), plain, _odds(plain, model.first, len(lines)))
        p = model.marginals(lines, _odds(full, model.weights, len(lines)))
        out.append([l.no for l, x in zip(lines, p) if x > 0.5])
    return out


def find_outside(documents: DataFrame, model: ContentModel) -> DataFrame:
    """``source_id, line_no`` for each non-blank line outside the main body, each source_id once.

    A source_id that was fetched again has the same body; should bodies differ, the lines of the smallest
    list count.  Rows without source_id are left out; null, empty and blank bodies have no lines.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: SLOTS weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64]
                yield pd.DataFrame({"source_id": part["source_id"], "lines": outside_lines(list(part["body"]), list(part["title"]), shipped.value)})

    found = documents.where(F.col("source_id").isNotNull()).select("source_id", "title", "body").mapInPandas(run, "source_id string, lines array<int>")
    return found.groupBy("source_id").agg(F.min("lines").alias("lines")).select("source_id", F.explode("lines").alias("line_no"))


def main_bodies(documents: DataFrame, model: ContentModel) -> DataFrame:
    """``source_id, main_body``: every page with only its main body's lines, blank lines inside it kept."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            outside = map(set, outside_lines(list(b["body"]), list(b["title"]), shipped.value))
            kept = [None if not isinstance(t, str) else "\n".join(l for i, l in enumerate(t.split("\n"), 1) if i not in o).strip("\n") for t, o in zip(b["body"], outside)]
            yield pd.DataFrame({"source_id": b["source_id"], "main_body": kept})

    found = documents.where(F.col("source_id").isNotNull()).select("source_id", "title", "body").mapInPandas(run, "source_id string, main_body string")
    return found.groupBy("source_id").agg(F.min("main_body").alias("main_body"))


def p1_found(documents: DataFrame) -> DataFrame:
    return find_outside(documents, fit_model(documents))


def p1_bodies(documents: DataFrame) -> DataFrame:
    """``source_id, main_body``: every page's main body."""
    return main_bodies(documents, fit_model(documents))
