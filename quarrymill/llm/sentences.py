"""Problem 8: the sentences of every document, as code-point offsets.

Method: every closing mark is a candidate boundary; a maximum-entropy model
over the neighbouring tokens, their case, length, digits and script decides
each.  It is trained on boundaries that need no judgement: a mark before a
blank line ends a sentence and the next paragraph starts one; a mark whose
token never ends a paragraph, before a token that never starts one, does not.
"Never" is a rate (``NEVER``): one stray paragraph does not undo it.

How often each token ends and starts paragraphs is counted over all documents,
in ``STAT_ROWS`` of ``STAT_SLOTS`` hashed counters each, of which the smallest
counts, so what is broadcast has a fixed size.
The weights are fitted on the candidates of a bounded sample of documents
(``MAX_FIT_DOCUMENTS``, smallest hashes of the id first) and applied to all.

What layout and script decide needs no model: blank lines, headings, list
items, quotation and bracket nesting, and Thai, which ends a sentence at a
space between Thai letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import maxent
from .common import MAX_FIT_CHARS, hash_sample

STAT_SLOTS = 1 << 21
#: Counters of a token; all lie in the same slots.
STAT_ROWS = 3
#: Counters that reach the driver as one value.
PACKED_SLOTS = 1 << 15
WEIGHT_SLOTS = 1 << 15
#: Bound of the documents whose candidates fit the weights.
MAX_FIT_DOCUMENTS = 3_000
#: Occurrences from which a token's never ending (or starting) a paragraph is reliable.
RELIABLE = 4
#: Share of its occurrences up to which a token never ends (or starts) a paragraph, by an upper bound of the rate.
NEVER = 0.01

_MARKS = ".!?…。！？｡।॥؟۔"
_CLOSERS = "\"'»”’“)]}」』）】›"
_CANDIDATE = re.compile(rf"[{_MARKS}]+[{re.escape(_CLOSERS)}]*(?:[   ][»”])?")
_FULL = "。！？｡।॥؟۔"
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\A\s*\n|\n[^\S\n]*\Z")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:\s|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣·]|\d{1,3}[.)]|[a-zA-Z][)])[ \t]+\S")
_TOKEN_BEFORE = re.compile(r"\S*$")
_TOKEN_AFTER = re.compile(r"[\s\"'«»„“”‘(\[¿¡「『（]*([^\s]+)")
_OPENERS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "«": "»", "„": "“", "‹": "›"}
_CLOSES = {c: o for o, c in _OPENERS.items()}
_DIGITS = re.compile(r"\d")
_SPACE = re.compile(r"\s*")


def _thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def nested(block: str) -> list[tuple[int, int]]:
    """Spans inside quotation marks and brackets that open and close within the block, outermost only.

    A mark that has no partner opens nothing.
    """
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    open_ = Counter()  # of each mark on the stack

    def push(ch: str, at: int) -> None:
        stack.append((ch, at))
        open_[ch] += 1

    def close(ch: str, at: int) -> None:
        while True:
            o, begun = stack.pop()
            open_[o] -= 1
            if o == ch:
                spans.append((begun, at))
                return

    for m in re.finditer(r"[()\[\]（）「」『』【】«»„“”‹›\"]", block):
        ch, at = m[0], m.start()
        if ch == '"':
            close(ch, at) if open_[ch] else push(ch, at)
        elif ch == "“" and not open_["„"]:
            push(ch, at)
        elif ch in _OPENERS:
            push(ch, at)
        else:
            wanted = "“" if ch == "”" else _CLOSES[ch]
            if open_[wanted]:
                close(wanted, at)
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


@dataclass(slots=True)
class Candidate:
    end: int  # of the marks and what closes with them
    before: str
    after: str
    mark: str
    gap: str  # "" none, " " space, "\n" line break, "E" end of the unit
    closed: bool = False  # whether closing marks follow the mark


def _after(text: str, at: int) -> str:
    """The next token's head: what follows an inner period (a file's suffix) does not make it another token."""
    m = _TOKEN_AFTER.match(text, at)
    token = m[1].strip("\"'«»„“”‘’()[]{}¿¡,;:「」『』（）").rstrip(_MARKS) if m else ""
    head = token.split(".", 1)[0]
    return head if len(head) > 2 and not head[0].isdigit() else token


def prose_candidates(block: str) -> list[Candidate]:
    """Candidates of a run of prose outside quotations and brackets, the last at its end if it is marked."""
    spans = nested(block)
    out, k = [], 0
    for m in _CANDIDATE.finditer(block):
        start, end = m.span()
        while k < len(spans) and spans[k][1] < start:
            k += 1
        if k < len(spans) and spans[k][0] < start and end <= spans[k][1]:
            continue
        if k < len(spans) and spans[k][0] < start and end > spans[k][1] and m[0][-1] in _CLOSERS:
            pass  # the mark closes with the quotation: «A. B.» Next
        rest = block[end:]
        marks = m[0].rstrip(_CLOSERS + "   »”")
        if not rest.strip():
            gap = "E"
        elif rest[0].isspace():
            gap = "\n" if "\n" in rest[: len(rest) - len(rest.lstrip())] else " "
        elif marks[-1:] and marks[-1] in _FULL:
            gap = ""
        else:
            was = block[start - 1 : start]
            starts = rest[0].isupper() and was.isalnum() and (rest[1:2].islower() or rest[1:2] in (" ", "'", "’"))
            if not starts and not (ord(rest[0]) > 0x0E00 and not was.isdigit()):
                continue
            gap = ""
        before = _TOKEN_BEFORE.search(block, max(0, start - 40), start)[0].lstrip("\"'«„“‘([¿¡")
        out.append(Candidate(end, before[-24:], _after(block, end)[:24], marks[-1:] if len(marks) < 3 else "…", gap, m[0] != marks))
    return out


def units(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the layout's units: heading, item or prose, each between blank lines."""
    at = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            yield from _lines(text, at, end)
        if m:
            at = m.end()


def _lines(text: str, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    kind, begun = "", at
    last = ""
    for line in text[at:end].splitlines(keepends=True):
        if _HEADING.match(line):
            if kind:
                yield kind, begun, at
            yield "heading", at, at + len(line)
            kind = ""
        else:
            item = _ITEM.match(line) and (not kind or kind == "item" or last.rstrip(_CLOSERS)[-1:] in (*_MARKS, ":"))
            if item or not kind:
                if kind:
                    yield kind, begun, at
                kind, begun = "item" if item else "prose", at
        last = line.rstrip()
        at += len(line)
    if kind:
        yield kind, begun, at


@lru_cache(1 << 16)
def _slots(token: str) -> tuple[int, ...]:
    h = xxhash.xxh3_128_intdigest(_DIGITS.sub("0", token))
    return tuple((h >> 40 * row) % STAT_SLOTS for row in range(STAT_ROWS))


def count_tokens(texts: list[str]) -> tuple[Counter, Counter, Counter, Counter]:
    """Counters by slot: before a mark, before a mark that ends a paragraph, first of a marked paragraph, after an inner mark."""
    seen, ends, starts, follows = Counter(), Counter(), Counter(), Counter()
    for text in texts:
        for kind, a, b in units(text):
            if kind != "prose":
                continue
            block = text[a:b]
            found = prose_candidates(block)
            for c in found:
                seen[c.before + c.mark] += 1
                if c.gap == "E":
                    ends[c.before + c.mark] += 1
                else:
                    follows[c.after] += 1
            if found and found[-1].gap == "E":
                starts[_after(block, 0)[:24]] += 1
    return tuple(_by_slot(c) for c in (seen, ends, starts, follows))


def _by_slot(tokens: Counter) -> Counter:
    out = Counter()
    for token, n in tokens.items():
        for s in set(_slots(token)):
            out[s] += n
    return out


@dataclass(frozen=True)
class Statistics:
    seen: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    follows: np.ndarray | None = None  # without it, a token that starts any paragraph does start them
    known: dict = field(default_factory=dict, compare=False, repr=False)

    def __reduce__(self):
        return Statistics, (self.seen, self.ends, self.starts, self.follows)  # what is remembered stays at home

    def ending(self, before: str) -> tuple[int, int]:
        """(paragraphs that the token ends, its occurrences before a mark)."""
        slots = _slots(before)
        return _least(self.ends, slots), _least(self.seen, slots)

    def starting(self, after: str) -> tuple[int, int]:
        """(paragraphs that the token starts, those and its occurrences after an inner mark)."""
        slots = _slots(after[:24])
        n = _least(self.starts, slots)
        return n, n + (_least(self.follows, slots) if self.follows is not None else 0)


def _least(counters: np.ndarray, slots: tuple[int, ...]) -> int:
    return int(min(counters[s] for s in slots))


def _never(part: int, whole: int) -> bool:
    """Whether the rate lies below ``NEVER`` by two standard deviations of its count."""
    return part == 0 or part + 2 * part**0.5 < whole * NEVER


def token_statistics(documents: DataFrame) -> Statistics:
    """Counts over all documents; four counters for each of ``STAT_SLOTS`` slots reach the driver, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, STAT_SLOTS), np.int64)
        for b in batches:
            for t, c in zip(total, count_tokens([x for x in b["text"] if x])):
                t[list(c)] += list(c.values())
        for kind, t in enumerate(total):
            slots = np.flatnonzero(t)
            for at in range(0, len(slots), 100_000):
                part = slots[at : at + 100_000]
                yield pd.DataFrame({"kind": kind, "block": part // PACKED_SLOTS, "slot": part, "n": t[part]})

    # One exchange, by block: a task's rows are sums already, and the blocks are what is packed.
    sums = documents.select("text").mapInPandas(run, "kind int, block int, slot int, n long").repartition("kind", "block")
    counted = sums.groupBy("kind", "block", "slot").agg(F.sum("n").alias("n")).groupBy("kind", "block").applyInPandas(_pack, "kind int, block int, counters binary")
    arrays = [np.zeros(STAT_SLOTS, np.int32) for _ in range(4)]
    for r in counted.collect():
        at = r["block"] * PACKED_SLOTS
        arrays[r["kind"]][at : at + PACKED_SLOTS] = np.frombuffer(zlib.decompress(r["counters"]), np.int32)
    return Statistics(*arrays)


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's counters in one value: as rows they would fill the driver once most slots are in use."""
    dense = np.zeros(PACKED_SLOTS, np.int32)
    dense[rows["slot"].to_numpy() % PACKED_SLOTS] = np.minimum(rows["n"].to_numpy(), 2**31 - 1)
    return pd.DataFrame({"kind": rows["kind"].iloc[:1], "block": rows["block"].iloc[:1], "counters": [zlib.compress(dense.tobytes(), 1)]})


def _script(ch: str) -> str:
    o = ord(ch) if ch else 0
    return "cjk" if 0x2E80 <= o else "thai" if 0x0E00 <= o < 0x0E80 else "deva" if 0x0900 <= o < 0x0980 else "arab" if 0x0590 <= o < 0x0780 else "cyrl" if 0x0400 <= o < 0x0530 else "latn" if ch.isalpha() else "none"


def _shape(token: str) -> str:
    ch = token[:1]
    return "up" if ch.isupper() else "low" if ch.islower() else "dig" if ch.isdigit() else "none" if not ch else "other"


def _level(part: int, whole: int) -> str:
    if whole < RELIABLE:
        return "few"
    return "never" if _never(part, whole) else "rare" if part < whole * 0.02 else "some" if part < whole * 0.2 else "often"


def _of_before(before: str, mark: str, st: Statistics) -> tuple[str, str, str, list[int]]:
    """(kind, how often it ends paragraphs, script, slots) of the token before a mark."""
    ending = _level(*st.ending(before + mark))
    kind = "num" if before.isdigit() else "letter" if len(before) == 1 else "dotted" if "." in before else "digits" if any(map(str.isdigit, before)) else "word"
    own = ("bias", f"mark={mark}", f"kind={kind}", f"len={min(len(before), 8)}", f"case={_shape(before)}", f"ending={ending}", f"before={before}{mark}")
    return kind, ending, _script(before[-1:]), [maxent.slot(f, WEIGHT_SLOTS) for f in own]


def _of_after(after: str, st: Statistics) -> tuple[str, str, str, list[int]]:
    """(shape, how often it starts paragraphs, script, slots) of the token after a mark."""
    starts, around = st.starting(after)
    starting = "never" if _never(starts, around) else "few" if starts < RELIABLE else "often"
    shape = _shape(after)
    own = (f"shape={shape}", f"starting={starting}", f"starting+shape={starting}+{shape}", f"after={after}")
    return shape, starting, _script(after[:1]), [maxent.slot(f, WEIGHT_SLOTS) for f in own]


@lru_cache(1 << 14)
def _of_both(mark: str, gap: str, kind: str, ending: str, script: str, shape: str, starting: str, next_script: str) -> list[int]:
    own = (
        f"gap={gap}",
        f"script={script}>{next_script}",
        f"ending+starting={ending}+{starting}",
        f"ending+starting+shape={ending}+{starting}+{shape}",
        f"mark+shape+starting={mark}+{shape}+{starting}",
        f"kind+shape+starting={kind}+{shape}+{starting}",
    )
    return [maxent.slot(f, WEIGHT_SLOTS) for f in own]


#: Tokens whose slots a task remembers; it forgets them all above that.
_REMEMBERED = 1 << 18


def features(c: Candidate, st: Statistics) -> list[int]:
    """Slots of a candidate's features.  Those of a token alone are worked out once a task."""
    key = (c.before, c.mark)
    if len(st.known) > _REMEMBERED:
        st.known.clear()
    kind, ending, script, own = st.known.get(key) or st.known.setdefault(key, _of_before(c.before, c.mark, st))
    shape, starting, next_script, other = st.known.get(c.after) or st.known.setdefault(c.after, _of_after(c.after, st))
    return own + other + _of_both(c.mark, c.gap, kind, ending, script, shape, starting, next_script)


def silver(c: Candidate, following: str | None, st: Statistics) -> tuple[int, Candidate] | None:
    """A label that needs no judgement, or None."""
    if c.gap == "E":
        return (1, Candidate(c.end, c.before, following, c.mark, " ")) if following else None
    ends, seen = st.ending(c.before + c.mark)
    never_ends = seen >= RELIABLE and _never(ends, seen)
    often_ends = _level(ends, seen) == "often"
    if _never(*st.starting(c.after)) and (never_ends or c.mark == "…" or (_shape(c.after) in ("low", "dig") and not often_ends)):
        return 0, c
    if never_ends and seen >= 5 * RELIABLE and c.mark not in _FULL:
        return 0, c
    return None


def prior(c: Candidate) -> float:
    """Odds that a script's own full stop ends a sentence, for scripts the fit has seen little of.

    It does, unless a closing quotation mark follows and the text runs on behind it.
    """
    return 0.0 if c.mark not in _FULL or c.gap == "E" else -4.0 if c.closed and not c.gap else 4.0


@dataclass(frozen=True)
class SentenceModel:
    statistics: Statistics
    weights: np.ndarray

    def boundaries(self, found: list[Candidate]) -> np.ndarray:
        if not found:
            return np.zeros(0, bool)
        x = [features(c, self.statistics) for c in found]
        return maxent.score(x, self.weights) + np.array([prior(c) for c in found]) > 0


def fit_weights(texts: list[str], st: Statistics) -> np.ndarray:
    """Weights from the reliable candidates of ``texts``."""
    x, y = [], []
    for text in texts:
        blocks = [text[a:b] for kind, a, b in units(text) if kind == "prose"]
        found = [prose_candidates(b) for b in blocks]
        for i, own in enumerate(found):
            following = _after(blocks[i + 1], 0)[:24] if i + 1 < len(found) and found[i + 1] and found[i + 1][-1].gap == "E" else None
            for c in own:
                if s := silver(c, following, st):
                    y.append(s[0])
                    x.append(features(s[1], st))
    return maxent.fit(x, y, WEIGHT_SLOTS)


def fit_model(documents: DataFrame, key: str = "doc_id") -> SentenceModel:
    """Statistics over all documents, weights from a bounded sample of them."""
    st = token_statistics(documents)
    texts = hash_sample(documents.where(F.length("text").between(1, MAX_FIT_CHARS)).select("text", key), key, MAX_FIT_DOCUMENTS, documents.count()).collect()
    return SentenceModel(st, fit_weights([r["text"] for r in texts], st))


def split(text: str | None, model: SentenceModel) -> list[tuple[int, int]]:
    """(start, end) of each sentence; null, empty and blank texts have none."""
    return split_all([text], model)[0]


def split_all(texts: list[str | None], model: SentenceModel) -> list[list[tuple[int, int]]]:
    """``split`` of many texts, with one lookup of the weights for all their candidates."""
    plan, found = [], []
    for text in texts:
        own = []
        for kind, a, b in units(text) if text else ():
            cands = prose_candidates(text[a:b]) if kind == "prose" else []
            own.append((kind, a, b, len(found), len(cands)))
            found += cands
        plan.append(own)
    ends = model.boundaries(found)
    out = []
    for text, own in zip(texts, plan):
        spans: list[tuple[int, int]] = []
        for kind, a, b, at, n in own:
            cuts = {b}
            if kind == "prose":
                cuts |= {a + c.end for c, yes in zip(found[at : at + n], ends[at : at + n]) if yes}
                cuts |= {a + x for x in thai_ends(text[a:b])}
            start = a
            for cut in sorted(cuts):
                piece = text[start:cut]
                lead, tail = len(piece) - len(piece.lstrip()), len(piece.rstrip())
                if tail:
                    spans.append((start + lead, start + tail))
                start = cut
        out.append(spans)
    return out


def thai_ends(block: str) -> list[int]:
    """Where a Thai sentence ends: a space between Thai letters, or a line break beside one."""
    out = []
    spans, k = None, 0
    for m in re.finditer(r"(?<=[฀-๿])\s+(?=[฀-๿])|(?<=[฀-๿])[^\S\n]*\n\s*(?=\S)|(?<=\S)[^\S\n]*\n\s*(?=[฀-๿])", block):
        spans = nested(block) if spans is None else spans
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k == len(spans) or spans[k][0] >= m.start():
            out.append(m.start())
    return out


def split_documents(documents: DataFrame, model: SentenceModel, key: str = "doc_id") -> DataFrame:
    """One row for each sentence: ``key, start_char, end_char``.

    Offsets count code points from 0, the end exclusive.  Equal texts give equal rows; a key that occurs
    twice keeps both.  Texts without a visible character give none; rows without a key are left out.
    """
    kind = documents.schema[key].dataType.simpleString()
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: STAT_SLOTS and WEIGHT_SLOTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                spans = split_all([x if isinstance(x, str) else None for x in part["text"]], shipped.value)
                n = [len(s) for s in spans]
                flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
                yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), n), "start_char": flat[:, 0].astype(np.int32), "end_char": flat[:, 1].astype(np.int32)})

    return documents.where(F.col(key).isNotNull()).select(key, "text").mapInPandas(run, f"{key} {kind}, start_char int, end_char int")


def p8_found(documents: DataFrame) -> DataFrame:
    return split_documents(documents, fit_model(documents))
