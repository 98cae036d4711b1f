"""Problem 3: a language, with a confidence, for every text and every segment in another language.

Method: language-bitmask n-gram filters.  All languages share one array of
slots and one pair of hash functions; a slot holds one bit per language (the
Bloom filters of all languages, sliced by bit).  Looking an n-gram up is one
AND of two slots and returns every language that contains it.  A sentence's
count for a language is the popcount of that language's bit over its n-grams,
corrected for the filter's false positives; the largest count decides.  An
n-gram that fewer languages contain weighs more (log of how many it leaves out).

The filters are fitted on a bounded sample of labelled rows (``MAX_SAMPLES`` of
each label), then widened by a bounded sample of corpus rows
(``MAX_CORPUS_ROWS``) whose label the first filters confirm; they are a
fixed-size table (``SLOTS`` x 4 bytes, 8 above 32 languages and so on) whatever
the corpus holds.

Whole sentences are decided one by one; what lies between them without a closing
mark (headings, lists, Thai, which has none) is decided run by run, so every text
with words of a known language gets one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MAX_FIT_CHARS, hash_sample

#: Bounds of the labelled rows of each label that the filters are fitted on (smallest hashes of the id first), and of their characters.
MAX_SAMPLES = 2_000
MAX_LABEL_CHARS = 2_000_000
#: Bound of the corpus rows that widen the filters' vocabulary (smallest hashes of the id first).
MAX_CORPUS_ROWS = 4_000
#: A corpus sentence teaches when it is this sure, and its whole row and its label agree with it.
SURE = 0.99
SLOTS = 1 << 20
ORDERS = (1, 2, 4, 6)
#: From this character on (Chinese, Japanese, Korean) one and two characters are n-grams, for they say as much as a word's letters elsewhere.
WIDE = 0x2E80
#: Share of a sentence's n-grams that its language must contain, else the sentence is ``und``; half of it will do
#: where no other language contains a quarter as much.
LEAST_SHARE = 0.4
#: n-grams of lead that count as one step of the logistic confidence.
LEAD = 4.0
MIN_WORDS = 2
#: How sure a run of words that is no sentence must be to count.
RUN_SURE = 0.8

#: Spellings of the languages' labels (ISO 639-1, -2/B, -2/T, English and own names).
LABELS = {
    "it": ("it", "ita", "italian", "italiano"),
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "ru": ("ru", "rus", "russian", "русский"),
    "zh": ("zh", "zho", "chi", "chinese", "cmn", "中文"),
    "ja": ("ja", "jpn", "japanese", "日本語"),
    "hi": ("hi", "hin", "hindi", "हिन्दी"),
    "ar": ("ar", "ara", "arabic", "العربية"),
    "th": ("th", "tha", "thai", "ไทย"),
}
_LABEL = {name: code for code, names in LABELS.items() for name in names}
#: Placeholders that are no label.
NO_LABEL = ("", "und", "unknown", "n/a", "na", "--", "-", "none", "null", "mul", "zxx", "?")

_FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+)[^\n]*$.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)")
_BLANKED = re.compile(r"`[^`\n]*`|\bhttps?://[^\s)>\]]+[^\s)>\].,;:!?]|\"[^\"\n]{1,80}\"|«[^»\n]{1,80}»|“[^”\n]{1,80}”|\([^()\n]{1,60}\)")
_NO_PROSE = re.compile(r"#{1,6}(?:\s|$)|\||[-*+]$|(?:[-*+]\s*)?`[^`]*`$")  # of a stripped line
_ENDING = re.compile(r"[.!?…](?=[\s\"'»”)\]]|$)[\"'»”)\]]*|[。！？｡।؟]+[」』”]*")
_LETTERS = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎ً-ٟ]+[^\W\d_]*)*")


def label_code(label: str | None) -> str:
    """The two-letter code a label stands for, ``und`` when it is missing, a placeholder or unknown."""
    if label is None:
        return "und"
    x = label.strip().lower()
    if x in NO_LABEL:
        return "und"
    return _LABEL.get(x) or _LABEL.get(re.split(r"[-_ (]", x, maxsplit=1)[0]) or x


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    slots: np.ndarray  # masks: SLOTS x as many numbers as the languages' bits need
    false_positive: np.ndarray

    @staticmethod
    def fit(texts: list[str], labels: list[str]) -> LanguageFilters:
        languages = tuple(sorted(set(labels)))
        kind = np.uint32 if len(languages) <= 32 else np.uint64
        slots = np.zeros((SLOTS, max(1, -(-len(languages) // _bits(kind)))), kind)
        for k, language in enumerate(languages):
            own = [normalised(t) for t, l in zip(texts, labels) if l == language]
            a, b, keep, _ = _grams(own)
            for h in (a, b):
                slots[h[keep], k // _bits(kind)] |= kind(1 << k % _bits(kind))
        fill = np.array([np.count_nonzero(_bit(slots, k)) / SLOTS for k in range(len(languages))])
        return LanguageFilters(languages, slots, fill**2)

    def shares(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(share of n-grams by sentence and language, corrected; number of n-grams by sentence)."""
        a, b, keep, owner = _grams(sentences)
        masks, owner = (self.slots[a] & self.slots[b])[keep], owner[keep]
        weight = self.weights()[np.bitwise_count(masks).sum(axis=1)]
        n = np.bincount(owner, weights=weight, minlength=len(sentences))
        out = np.zeros((len(sentences), len(self.languages)))
        for k, f in enumerate(self.false_positive):
            hit = np.bincount(owner, weights=_bit(masks, k) * weight, minlength=len(sentences))
            out[:, k] = np.clip((hit / np.maximum(n, 1e-9) - f) / (1 - f), 0, 1)
        return out, n

    def weights(self) -> np.ndarray:
        """Weight of an n-gram by the number of languages that contain it; one of no language weighs as the mean."""
        many = len(self.languages)
        w = np.log2((many + 1) / np.maximum(np.arange(many + 1), 1))
        w[0] = w[1:].mean()
        return w

    def decide(self, sentences: list[str]) -> list[tuple[str, float]]:
        if not sentences:
            return []
        share, n = self.shares(sentences)
        order = np.argsort(-share, axis=1, kind="stable")
        rows = np.arange(len(sentences))
        best = share[rows, order[:, 0]]
        second = share[rows, order[:, 1]] if share.shape[1] > 1 else np.zeros(len(sentences))
        confidence = 1 / (1 + np.exp(-(best - second) * n / LEAD))
        clear = (n >= 3) & ((best >= LEAST_SHARE) | ((best >= LEAST_SHARE / 2) & (second <= best / 4)))
        return [(self.languages[order[i, 0]], float(confidence[i])) if clear[i] else ("und", 0.0) for i in rows]


def _bits(kind: type) -> int:
    return 8 * np.dtype(kind).itemsize


def _bit(masks: np.ndarray, k: int) -> np.ndarray:
    kind = masks.dtype.type
    return (masks[:, k // _bits(kind)] >> kind(k % _bits(kind))) & kind(1)


def normalised(text: str) -> str:
    return " ".join(_LETTERS.findall(text.lower()))


def _grams(sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two slot numbers, whether it counts, and the owning sentence, of every n-gram of every order."""
    joined = "".join(f" {s} \n" for s in sentences)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = points == 10
    owner = np.cumsum(ends) - ends
    firsts, seconds, keeps, owners = [], [], [], []
    for order in ORDERS:
        if len(points) < order:
            continue
        m = len(points) - order + 1
        h = np.full(m, 0x9E3779B97F4A7C15 * order & (2**64 - 1), np.uint64)
        crosses = np.zeros(m, bool)
        for i in range(order):
            h = (h ^ points[i : i + m]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            crosses |= ends[i : i + m]
        if order != 2:
            crosses |= (points[:m] < WIDE) == (order == 1)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        firsts.append(((h >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64))
        seconds.append(((h >> np.uint64(8)) % np.uint64(SLOTS)).astype(np.int64))
        keeps.append(~crosses)
        owners.append(owner[:m])
    if not firsts:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(bool), z
    return np.concatenate(firsts), np.concatenate(seconds), np.concatenate(keeps), np.concatenate(owners)


def sentence_spans(content: str) -> list[tuple[int, int, str]]:
    """(start, end, words) of each whole sentence: code, urls and short quoted or bracketed terms blanked.

    A sentence ends with a closing mark; headings, tables and unclosed lines are none.
    """
    return _closed(_prose(content))


def _prose(content: str) -> str:
    """The text with what is no prose blanked, at the same places."""
    return _BLANKED.sub(lambda m: " " * (m.end() - m.start()), _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content))


def _closed(text: str) -> list[tuple[int, int, str]]:
    out = []
    at = 0
    for paragraph in re.split(r"(\n[ \t]*\n)", text):
        start = at
        at += len(paragraph)
        for block in _blocks(paragraph):
            b0, piece = block
            last = 0
            for m in _ENDING.finditer(piece):
                words = normalised(piece[last : m.end()])
                if words.count(" ") + 1 >= MIN_WORDS or (words and ord(words[0]) > 0x0E00):
                    lead = len(piece[last : m.end()]) - len(piece[last : m.end()].lstrip())
                    out.append((start + b0 + last + lead, start + b0 + m.end(), words))
                last = m.end()
    return out


def text_spans(content: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, words, whether it is a whole sentence): the sentences, and each run of words between them."""
    text = _prose(content)
    out: list[tuple[int, int, str, bool]] = []
    at = 0
    for start, end, words in [*_closed(text), (len(text), len(text), "")]:
        rest = normalised(text[at:start])
        if rest.count(" ") + 1 >= MIN_WORDS or (rest and ord(rest[0]) > 0x0E00):
            lead = len(text[at:start]) - len(text[at:start].lstrip())
            out.append((at + lead, at + len(text[at:start].rstrip()), rest, False))
        if words:
            out.append((start, end, words, True))
        at = end
    return out


def _blocks(paragraph: str) -> list[tuple[int, str]]:
    """Runs of prose lines of a paragraph, with their offsets."""
    out, at, run, begun = [], 0, [], 0
    for line in paragraph.split("\n"):
        if _NO_PROSE.match(line.strip()):
            if run:
                out.append((begun, "\n".join(run)))
            run = []
        else:
            if not run:
                begun = at
            run.append(line)
        at += len(line) + 1
    if run:
        out.append((begun, "\n".join(run)))
    return out


def fit_filters(samples: DataFrame, corpus: DataFrame | None = None) -> LanguageFilters:
    """Filters from ``sample_id, lang, text``, widened by ``id, lang, content`` of a corpus.

    Rows with a null, empty or giant text or a null label teach nothing.  Of each label the rows with the smallest
    hashes of the id count, so no order of the table leaves a language out.  Of the corpus, the rows with the smallest hashes of the
    id are tried, ``MAX_CORPUS_ROWS`` at most; a row teaches when all its sentences are surely in the
    language of its label.
    """
    own = W.partitionBy("lang").orderBy(F.xxhash64(F.col("sample_id").cast("string")), "sample_id")
    known = samples.where(F.col("lang").isNotNull() & F.length("text").between(1, MAX_FIT_CHARS)).select("sample_id", "lang", "text")
    few = known.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= MAX_SAMPLES)  # cut before the shuffle, too
    rows = few.withColumn("_c", F.sum(F.length("text")).over(own)).where(F.col("_c") <= MAX_LABEL_CHARS).orderBy("lang", "_n").select("lang", "text").collect()
    texts, labels = [r["text"] for r in rows], [label_code(r["lang"]) for r in rows]
    first = LanguageFilters.fit(texts, labels)
    if corpus is None or not rows:
        return first
    tried = hash_sample(corpus.where(F.col("lang").isNotNull() & F.length("content").between(1, MAX_FIT_CHARS)).select("id", "lang", "content"), "id", MAX_CORPUS_ROWS, corpus.count(), "content").collect()
    tried = [(label_code(r["lang"]), [w for _, _, w in sentence_spans(r["content"])]) for r in tried]
    tried = [(label, words) for label, words in tried if words and label in first.languages]
    flat = first.decide([w for _, words in tried for w in words])
    at = 0
    for label, words in tried:
        found = flat[at : at + len(words)]
        at += len(words)
        if all(lang == label and sure >= SURE for lang, sure in found):
            texts.append(" \n".join(words))
            labels.append(label)
    return LanguageFilters.fit(texts, labels)


_SCHEMA = "id string, label string, lang string, confidence double, segments array<struct<start:int,end:int,lang:string,confidence:double,sentences:int,spans:int>>"


def _labeller(filters: LanguageFilters):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [text_spans(c) if c else [] for c in b["content"]]
            flat = filters.decide([s[2] for own in spans for s in own])
            at, rows = 0, []
            for s in spans:
                found = flat[at : at + len(s)]
                at += len(s)
                rows.append(_summary(s, found))
            yield pd.DataFrame({"id": b["id"], "label": [label_code(x) for x in b["lang"]], "lang": [r[0] for r in rows], "confidence": [r[1] for r in rows], "segments": [r[2] for r in rows]})

    return run


def _summary(spans: list[tuple[int, int, str, bool]], found: list[tuple[str, float]]) -> tuple[str, float, list[dict]]:
    """(language, confidence, segments).  Runs that are no sentences and of no clear language go with what is about them."""
    segments: list[dict] = []
    weight: dict[str, float] = {}
    for (start, end, words, whole), (lang, conf) in zip(spans, found):
        if not whole and (lang == "und" or conf < RUN_SURE):
            continue
        weight[lang] = weight.get(lang, 0) + len(words)
        if segments and segments[-1]["lang"] == lang:
            last = segments[-1]
            last["confidence"] = (last["confidence"] * last["spans"] + conf) / (last["spans"] + 1)
            last |= {"end": end, "sentences": last["sentences"] + whole, "spans": last["spans"] + 1}
        else:
            segments.append({"start": start, "end": end, "lang": lang, "confidence": conf, "sentences": int(whole), "spans": 1})
    known = {k: v for k, v in weight.items() if k != "und"}
    if not known:
        return "und", 0.0, segments
    best = min(known, key=lambda k: (-known[k], k))
    own = [s for s in segments if s["lang"] == best]
    sure = sum(s["confidence"] * s["spans"] for s in own) / sum(s["spans"] for s in own)
    return best, sure * known[best] / sum(weight.values()), segments


def label_languages(texts: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``id, label, lang, confidence, segments`` for every distinct ``id`` of ``texts`` (id, lang, content).

    ``label`` is the given label's code.  ``lang`` is the language of most of the text, ``und`` with
    confidence 0 where there are no words of a known language (null, empty, code only).  ``segments`` are the
    runs of text in one language, with how many whole sentences each holds.  An id that occurs again counts once; rows without id are left out.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(filters)  # fixed size: SLOTS x 4 bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _labeller(shipped.value)(batches)

    labelled = texts.where(F.col("id").isNotNull()).select("id", "lang", "content").mapInPandas(run, _SCHEMA)
    cols = ["label", "lang", "confidence", "segments"]
    return labelled.groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols])


def prose_rows(chunks: DataFrame) -> DataFrame:
    """Chunks that lie outside ``code/`` folders."""
    return chunks.where(F.col("rel_path").isNull() | ~F.col("rel_path").rlike("^[^/]+/.+/code/.+"))


def p3_found(chunks: DataFrame, samples: DataFrame, languages: tuple[str, ...] = ("it", "en", "de", "fr", "es")) -> DataFrame:
    """``id, found_lang``: the languages of each chunk whose label is missing, wrong or not the only one."""
    labelled = label_languages(prose_rows(chunks), fit_filters(samples, prose_rows(chunks)))
    closed = F.filter("segments", lambda s: (s["sentences"] > 0) & (s["lang"] != "und"))
    found = F.array_distinct(F.transform(closed, lambda s: s["lang"]))
    cases = labelled.select("id", "label", found.alias("found")).where((F.size("found") > 1) | ((F.size("found") == 1) & (F.col("found")[0] != F.col("label"))))
    return cases.select("id", F.explode("found").alias("found_lang")).where(F.col("found_lang").isin(*languages))


def p3_languages(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Every chunk with its language and confidence, and each of its segments with its own, in order.

    A chunk without any segment has one row, whose ``segment`` is null.
    """
    labelled = label_languages(chunks, fit_filters(samples, prose_rows(chunks)))
    rows = labelled.select("id", "label", "lang", F.round("confidence", 4).alias("confidence"), F.posexplode_outer("segments").alias("segment", "s"))
    return rows.select("id", "label", "lang", "confidence", "segment", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.lang").alias("segment_lang"), F.round("s.confidence", 4).alias("segment_confidence"))
