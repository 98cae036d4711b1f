"""Problem 5: items above their size limit, cut into overlapping pieces at natural places.

Method: range processing.  An item is read in ranges of ``RANGE_LIMITS`` times
its limit, each with halos on both sides.  A worker finds the boundaries of its
range and cuts it; the cut between two ranges is the best boundary of a window
about the range's start, which both neighbours see in their halo and choose alike,
so their boundary tables stitch without a word between them.  Piece numbers are
prefix sums of the ranges' piece counts.  No worker holds a whole giant item:
rows are cut by ``split_items`` and files, by byte ranges, by ``split_files``.

Sizes are UTF-16 lengths divided by ``chars_per_token``, rounded up.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint_dir, checkpointed

#: Length of a range, in limits of its item.
RANGE_LIMITS = 64
#: Bytes of a range of a file.
RANGE_BYTES = 64 << 20

#: Boundaries from strong to weak: before a heading, blank line, line break, sentence, clause, white space.
#: Each matches what lies between two pieces; a cut leaves its white space out.
_PROSE = (
    re.compile(r"\n\s*(?=#{1,6}\s)"),
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"(?<=[.!?…。！？])\n\s*"),
    re.compile(r"(?<=[.!?…])[\"'»”)\]]{0,3}\s+(?=\S)|[。！？]+[」』”）]*\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"(?<=[,;:])\s+"),
    re.compile(r"\s+"),
)
_CODE = (
    re.compile(r"\n(?:[^\S\n]*\n)+(?=\S)"),
    re.compile(r"\n(?=(?:export |public |private |async |static |pub |suspend )*(?:def|class|func|fun|function|interface|type|struct|enum|impl|create|alter|insert)\b)"),
    re.compile(r"\n(?=\S)"),
    re.compile(r"\n"),
    re.compile(r"[;{}]\s+|[。！？]+"),
    re.compile(r"\s+"),
)
_STRETCH = re.compile(r"[^\s。！？]+")
_DIVIDES = re.compile(r"[\s。！？]")


@dataclass(frozen=True)
class Limit:
    target: int  # in UTF-16 units
    most: int
    overlap: int
    code: bool = False

    @staticmethod
    def of(target_tokens: int, max_tokens: int, overlap_tokens: int, chars_per_token: float, code: bool = False) -> Limit:
        most = max(1, math.floor(max_tokens * chars_per_token + 1e-9))
        return Limit(min(most, math.floor(target_tokens * chars_per_token)), most, min(most // 2, math.floor(overlap_tokens * chars_per_token)), code)

    @property
    def range(self) -> int:
        return RANGE_LIMITS * self.most


@dataclass(slots=True)
class Piece:
    start: int  # code points from the item's begin, with the overlap
    fresh: int  # where what the piece before did not hold begins
    end: int
    forced: bool  # its end lies within a stretch that has no boundary


def utf16_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


class _Ruler:
    """Distances in UTF-16 units between code points of one text."""

    def __init__(self, text: str):
        self.astral = [m.start() for m in re.finditer(r"[\U00010000-\U0010ffff]", text)] if not text.isascii() else []

    def length(self, a: int, b: int) -> int:
        if not self.astral:
            return b - a
        from bisect import bisect_left

        return b - a + bisect_left(self.astral, b) - bisect_left(self.astral, a)

    def reach(self, a: int, units: int, end: int) -> int:
        """The largest position up to ``end`` that lies within ``units`` of ``a``."""
        b = min(end, a + units)
        while self.astral and self.length(a, b) > units:
            b -= max(1, (self.length(a, b) - units) // 2)
        return b


def _best(text: str, levels: tuple[re.Pattern, ...], low: int, high: int, wanted: int) -> tuple[int, int] | None:
    """(end of the piece, begin of the next) of the strongest boundary whose piece ends in [low, high].

    Among equals, the one nearest to ``wanted``.
    """
    for level in levels:
        best = None
        for m in level.finditer(text, max(0, low - 1), min(len(text), high + 1)):
            stop = m.start() + len(m[0].rstrip())
            if low <= stop <= high and m.end() >= low:
                begin = m.end()
                while begin < len(text) and text[begin].isspace():
                    begin += 1
                if best is None or abs(stop - wanted) < abs(best[0] - wanted):
                    best = (stop, begin)
        if best:
            return best
    return None


def section_cut(text: str, at: int, limit: Limit) -> tuple[int, bool]:
    """(where a range that starts at ``at`` really begins, whether that divides a stretch).

    The best boundary of the half limit after ``at``, else the nearest within a limit on either side.  Where
    there is none, a stretch above the limit lies over ``at``, which then divides it.  Both the range and the
    one before it call this on the same characters, so they agree.
    """
    levels = _CODE if limit.code else _PROSE
    low = max(0, at - limit.most)
    seam, own = text[low : at + 2 * limit.most], at - low  # what both neighbours see
    high = own + _Ruler(seam[own : own + limit.most]).reach(0, limit.most // 2, len(seam) - own)
    if found := _best(seam[: high + 1], levels, own + 1, high - 1, own):
        return low + min(found[1], high), False
    if not own or own >= len(seam) or _DIVIDES.match(seam, own - 1) or _DIVIDES.match(seam, own):
        return at, False
    far = min(len(seam), own + limit.most)
    ends = [m.end() for m in _DIVIDES.finditer(seam, 0, own)][-1:] + [m.start() for m in _DIVIDES.finditer(seam, own, far)][:1]
    return (low + min(ends, key=lambda x: abs(x - own)), False) if ends else (at, True)


def cut_section(text: str, begin: int, stop: int, limit: Limit) -> list[Piece]:
    """Pieces of ``text[begin:stop]``; the first overlaps what lies before ``begin``, if anything does."""
    levels = _CODE if limit.code else _PROSE
    ruler = _Ruler(text)
    out: list[Piece] = []
    while stop > begin and text[stop - 1].isspace():
        stop -= 1
    fresh = begin
    while fresh < stop and text[fresh].isspace():
        fresh += 1
    first_word = len(text) - len(text.lstrip())  # what the slice begins with is no overlap worth repeating
    while fresh < stop:
        start = max(first_word, _overlap(text, levels, ruler, fresh, limit))
        if ruler.length(start, stop) <= limit.most:
            out.append(Piece(start, fresh, stop, False))
            break
        for first in (start, fresh):  # without the overlap when no boundary comes soon enough with it
            if ruler.length(first, stop) <= limit.most:
                found = (stop, stop)
                break
            high = ruler.reach(first, limit.most, stop)
            wanted = ruler.reach(first, limit.target, stop)
            low = max(fresh + 1, ruler.reach(first, limit.target // 2, stop))
            found = _best(text, levels, low, high, wanted) or (_last(text, levels, fresh + 1, high) if first == fresh or start == fresh else None)
            if found:
                break
        if found:
            end, nxt = found
            while end > fresh + 1 and text[end - 1].isspace():
                end -= 1
            out.append(Piece(first, fresh, end, False))
        else:
            high = ruler.reach(start, limit.most, stop)
            if high <= fresh:
                start, high = fresh, ruler.reach(fresh, limit.most, stop)
            high = max(high, fresh + 1)
            out.append(Piece(start, fresh, high, True))
            nxt = high
        fresh = nxt
        while fresh < stop and text[fresh].isspace():
            fresh += 1
    return out


def _last(text: str, levels: tuple[re.Pattern, ...], low: int, high: int) -> tuple[int, int] | None:
    """The last boundary of any strength whose piece ends in [low, high]."""
    return _best(text, (re.compile(r"\s+|[。！？]+[」』”）]*"), re.compile(r"(?=[。！？])")), low, high, high)


def _overlap(text: str, levels: tuple[re.Pattern, ...], ruler: _Ruler, fresh: int, limit: Limit) -> int:
    """Where a piece begins so that it repeats up to the stated overlap, at a boundary; a stretch is cut when it has none."""
    if not limit.overlap:
        return fresh
    low = max(0, fresh - limit.overlap)
    while low < fresh and ruler.length(low, fresh) > limit.overlap:
        low += 1
    if low == 0:
        return 0
    if text[low - 1].isspace() or text[low - 1] in "。！？":
        return low + (len(text[low:fresh]) - len(text[low:fresh].lstrip()))
    for m in re.compile(r"\s+|[。！？]+").finditer(text, low, fresh):
        return m.end()
    return low


def has_stretch(text: str, limit: Limit) -> bool:
    """Whether some stretch without white space and without 。！？ is by itself above the limit."""
    return any(m.end() - m.start() > limit.most // 2 and utf16_length(m[0]) > limit.most for m in _STRETCH.finditer(text))


def cut_range(text: str, at: int, range_no: int, is_last: bool, limit: Limit) -> list[Piece]:
    """Pieces of one range.  ``text`` is its slice with halos, which begins at code point ``at`` of the item.

    The slice reaches ``2 * limit.most`` beyond either end of the range (to the left, ``limit.most`` will do, with
    less overlap).
    """
    begin = 0 if range_no == 0 else section_cut(text, range_no * limit.range - at, limit)[0]
    stop, divides = (len(text), False) if is_last else section_cut(text, (range_no + 1) * limit.range - at, limit)
    pieces = cut_section(text, begin, stop, limit)
    if divides and pieces:
        pieces[-1].forced = True
    for p in pieces:
        p.start += at
        p.fresh += at
        p.end += at
    return pieces


_PIECES = "item_id string, item string, range_no int, pieces array<struct<start_char:long,fresh_char:long,end_char:long,forced:boolean,size_tokens:int,text:string>>, stretch boolean"


def oversized(items: DataFrame) -> DataFrame:
    """Rows of ``item_id, text, target_tokens, max_tokens, overlap_tokens, chars_per_token`` above their limit."""
    units = F.octet_length(F.encode("text", "UTF-16BE")) / F.lit(2)
    return items.where(F.ceil(units / F.col("chars_per_token")) > F.col("max_tokens"))


def ranges_of(items: DataFrame) -> DataFrame:
    """One row for each range of an item, with the slice of its text that a worker needs.

    A longer item is cut into its ranges in one pass over its text; each then takes its halos from the ranges beside it.
    """
    most = F.greatest(F.lit(1), F.floor(F.col("max_tokens") * F.col("chars_per_token") + 1e-9)).cast("int")
    step = F.col("_most") * RANGE_LIMITS
    keep = [c for c in items.columns if c != "text"]
    sized = items.withColumn("_most", most).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.length("text") / step)).cast("int"))
    alone = sized.where(F.col("_n") == 1).select(*keep, F.lit(0).alias("range_no"), F.lit(0).cast("long").alias("_at"), F.lit(True).alias("is_last"), "text")
    parts = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), F.lit(0))
    halo = F.col("_most") * 2

    def slice_of(part: F.Column, i: F.Column) -> F.Column:
        beside = lambda k: F.coalesce(F.get("_parts", i + k), F.lit(""))
        before = F.when(i > 0, F.substr(beside(-1), -halo, halo)).otherwise("")
        return F.struct(i.alias("range_no"), F.concat(before, part, F.substr(beside(1), F.lit(1), halo)).alias("text"))

    several = sized.where(F.col("_n") > 1).withColumn("_parts", parts).select(*keep, "_most", "_n", F.explode(F.transform("_parts", slice_of)).alias("_r"))
    at = F.when(F.col("_r.range_no") == 0, 0).otherwise(F.col("_r.range_no").cast("long") * step - halo)
    ranges = several.select(*keep, F.col("_r.range_no").alias("range_no"), at.cast("long").alias("_at"), (F.col("_r.range_no") == F.col("_n") - 1).alias("is_last"), F.col("_r.text").alias("text"))
    return alone.unionByName(ranges.repartition("item_id", "range_no"))  # a giant item's ranges are tasks of their own


def _cut_rows(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, stretches = [], []
            for r in b.itertuples():
                limit = Limit.of(r.target_tokens, r.max_tokens, r.overlap_tokens, r.chars_per_token, r.item == "code")
                pieces = cut_range(r.text, r.slice_at, r.range_no, r.is_last, limit)
                stretches.append(has_stretch(r.text, limit))  # the slice shows more than a limit of any that is above it
                rows.append(
                    [
                        {
                            "start_char": p.start,
                            "fresh_char": p.fresh,
                            "end_char": p.end,
                            "forced": p.forced,
                            "size_tokens": math.ceil(utf16_length(piece := r.text[p.start - r.slice_at : p.end - r.slice_at]) / r.chars_per_token),
                            "text": piece if with_text else None,
                        }
                        for p in pieces
                    ]
                )
            yield pd.DataFrame({"item_id": b["item_id"], "item": b["item"], "range_no": b["range_no"], "pieces": rows, "stretch": stretches})

    return run


def cut_ranges(items: DataFrame, *, with_text: bool = True) -> DataFrame:
    """The pieces of every range of the oversized rows of ``items``."""
    cols = ["item_id", "item", "text", "target_tokens", "max_tokens", "overlap_tokens", "chars_per_token", "range_no", F.col("_at").alias("slice_at"), "is_last"]
    own = items.select("item_id", "item", "text", "target_tokens", "max_tokens", "overlap_tokens", "chars_per_token")
    return ranges_of(oversized(own)).select(*cols).mapInPandas(_cut_rows(with_text), _PIECES)


def split_items(items: DataFrame) -> DataFrame:
    """Pieces of the items above their limit: ``item_id, item, piece_no, start_char, fresh_char, end_char, size_tokens, forced, text``.

    ``items`` has ``item_id, item, text`` and the four limits; an ``item`` named ``code`` is cut as code.
    ``start_char`` to ``end_char`` (code points) is the piece; up to ``fresh_char`` it repeats the piece before.
    Pieces leave out the white space at cuts and hold everything else.  Items within their limit, and null
    texts, give no rows.  Each item_id counts once: of differing texts, the smallest.
    """
    keep = ["text", "item", "target_tokens", "max_tokens", "overlap_tokens", "chars_per_token"]
    once = oversized(items).where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min(F.struct(*keep)).alias("r")).select("item_id", *[F.col(f"r.{c}").alias(c) for c in keep])
    cols = ("start_char", "fresh_char", "end_char", "size_tokens", "forced", "text")
    out = lambda cut, before: cut.select("item_id", "item", before.alias("_before"), F.posexplode("pieces").alias("k", "p")).select("item_id", "item", (F.col("_before") + F.col("k") + 1).cast("int").alias("piece_no"), *[F.col(f"p.{c}").alias(c) for c in cols])
    several = F.length("text") > F.greatest(F.lit(1), F.floor(F.col("max_tokens") * F.col("chars_per_token") + 1e-9)) * RANGE_LIMITS
    # The few items of several ranges: cut once, kept, and numbered by a prefix sum over their ranges' counts alone.
    long = checkpointed(cut_ranges(once.where(several)))
    placed = numbered(long, "item_id", F.size("pieces"))
    return out(cut_ranges(once.where(~several)), F.lit(0)).unionByName(out(placed, F.col("_before")))


def numbered(cut: DataFrame, key: str, pieces: F.Column) -> DataFrame:
    """``cut`` (one row for each ``key, range_no``) with ``_before``, the pieces of the ranges before its own."""
    counts = cut.select(key, "range_no", pieces.cast("long").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(key, "range_no", F.coalesce(before, F.lit(0)).alias("_before"))
    return cut.join(offsets, [key, "range_no"])


def with_limits(drafts: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """Drafts and bodies as items, with the limits of their kind (three rows: broadcast)."""
    d = drafts.select(F.col("id").alias("item_id"), F.when(F.col("line_start").isNotNull(), "code").otherwise("prose").alias("item"), F.col("content").alias("text"))
    b = documents.select(F.col("source_id").alias("item_id"), F.lit("document").alias("item"), F.col("body").alias("text"))
    small = limits.select("item", "target_tokens", "max_tokens", "overlap_tokens", "chars_per_token")
    return d.unionByName(b).join(F.broadcast(small), "item")


def p5_found(drafts: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """``item_id, cut``: every item above its limit, ``forced`` when some stretch is by itself above the limit."""
    cut = cut_ranges(with_limits(drafts, documents, limits).where(F.col("item_id").isNotNull()), with_text=False)
    return cut.groupBy("item_id").agg(F.max(F.col("stretch").cast("int")).alias("f")).select("item_id", F.when(F.col("f") == 1, "forced").otherwise("natural").alias("cut"))


_FILE_PIECES = "path string, range_no int, pieces array<struct<start_byte:long,fresh_byte:long,end_byte:long,forced:boolean>>"


def split_files(files: DataFrame, limit: Limit, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of UTF-8 files by byte ranges: ``path, piece_no, start_byte, fresh_byte, end_byte, forced``.

    ``files`` has ``path`` (on a shared file system) and ``size`` in bytes.  A task reads one range and a halo on either
    side, never the file.  A range's real begin is the best boundary about its first byte, chosen alike by
    both neighbours; piece numbers are prefix sums of the ranges' counts.  Empty files give no rows.
    """
    many = F.ceil(F.col("size") / range_bytes).cast("int")
    ranges = files.where(F.col("size") > 0).select("path", F.col("size").cast("long").alias("size"), F.explode(F.sequence(F.lit(0), many - 1)).alias("range_no"))
    tasks = ranges.repartition(int(min(20_000, max(1, ranges.count()))))  # round robin: a range a task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, k in b.itertuples(index=False):
                pieces = [dict(zip(("start_byte", "fresh_byte", "end_byte", "forced"), p)) for p in cut_file_range(path, int(k), int(size), limit, range_bytes)]
                yield pd.DataFrame({"path": [path], "range_no": [k], "pieces": [pieces]})

    cut = checkpointed(tasks.mapInPandas(run, _FILE_PIECES))
    pieces = numbered(cut, "path", F.size("pieces")).select("path", "_before", F.posexplode("pieces").alias("k", "p"))
    return pieces.select("path", (F.col("_before") + F.col("k") + 1).alias("piece_no"), *[F.col(f"p.{c}").alias(c) for c in ("start_byte", "fresh_byte", "end_byte", "forced")])


def cut_file_range(path: str, k: int, size: int, limit: Limit, range_bytes: int) -> list[tuple]:
    """Pieces of the ``k``-th byte range of a file; offsets in bytes."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:/", path):
        system, name = fs.FileSystem.from_uri(path)
    else:
        system, name = fs.LocalFileSystem(), path
    halo = 4 * limit.most  # UTF-8 needs at most 4 bytes for what UTF-16 needs one unit for
    low = max(0, k * range_bytes - 2 * halo)
    high = min(size, (k + 1) * range_bytes + 2 * halo)
    with system.open_input_file(name) as f:
        raw = f.read_at(high - low, low)
    lead = next((i for i in range(4) if i >= len(raw) or raw[i] & 0xC0 != 0x80), 0) if low else 0
    text = raw[lead:].decode("utf-8", "ignore" if high < size else "replace")
    at = low + lead
    where = lambda byte: len(raw[lead : _char_start(raw, byte - low)].decode("utf-8", "ignore"))
    last = (k + 1) * range_bytes >= size
    begin = 0 if k == 0 else section_cut(text, where(k * range_bytes), limit)[0]
    stop, divides = (len(text), False) if last else section_cut(text, where((k + 1) * range_bytes), limit)
    pieces = cut_section(text, begin, stop, limit)
    if divides and pieces:
        pieces[-1].forced = True
    # One pass over the text gives the bytes before each piece's ends.
    marks = sorted({x for p in pieces for x in (p.start, p.fresh, p.end)})
    offset, done, total = {}, 0, at
    for m in marks:
        total += len(text[done:m].encode("utf-8"))
        done = m
        offset[m] = total
    return [(offset[p.start], offset[p.fresh], offset[p.end], p.forced) for p in pieces]


def _char_start(raw: bytes, i: int) -> int:
    """The first byte of the character that byte ``i`` belongs to."""
    while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
        i -= 1
    return i


def p5_files(documents: DataFrame, limits: DataFrame, range_bytes: int = 1 << 20) -> DataFrame:
    """The bodies, written one after another to files of the shared folder, cut there by byte ranges as giant files are.

    ``file`` (from 0, by name), ``piece_no`` and the bytes of each piece.  The limits are those of ``document``.
    """
    spark = documents.sparkSession
    row = limits.where(F.col("item") == "document").select("target_tokens", "max_tokens", "overlap_tokens", "chars_per_token").first()
    if row is None:
        return spark.createDataFrame([], "file int, piece_no long, start_byte long, fresh_byte long, end_byte long, forced boolean")
    folder = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    documents.where(F.col("body").isNotNull()).select(F.col("body").alias("value")).write.text(folder, lineSep="\n\n")
    files = spark.createDataFrame(list_files(spark, folder), "path string, size long")
    order = F.row_number().over(W.orderBy("path")) - 1  # one row a file
    return split_files(files, Limit.of(*row), range_bytes).join(files.select("path", order.alias("file")), "path").drop("path")


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of a folder's data files, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f.getPath().toString(), f.getLen()) for f in found if not f.getPath().getName().startswith(("_", ".")))
