"""Retrieval filters as one predicate; both rankers use the same."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    source_type: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    authority: list[str] = field(default_factory=list)
    lang: list[str] = field(default_factory=list)
    #: ISO day, month or year as text: from (inclusive) and up to (exclusive), compared as text.
    after: str | None = None
    before: str | None = None
    contains: str | None = None
    #: Rows whose date says nothing; a date bound leaves them out.
    undated: tuple[tuple[str, str], ...] = (("devportal", "doc"),)

    def __bool__(self) -> bool:
        return bool(self.source_type or self.kind or self.authority or self.lang or self.after or self.before or self.contains)


def predicate(f: Filters) -> Column:
    """The rows that pass every filter; null columns pass none that names them."""
    out = F.lit(True)
    for name in ("source_type", "kind", "authority", "lang"):
        if wanted := getattr(f, name):
            out = out & F.col(name).isin(wanted)
    if f.after or f.before:
        out = out & (F.coalesce("last_modified", F.lit("")) != "")
        if f.after:
            out = out & (F.col("last_modified") >= f.after)
        if f.before:
            out = out & (F.col("last_modified") < f.before)
        for source_type, kind in f.undated:
            out = out & ~((F.col("source_type") == source_type) & (F.col("kind") == kind))
    if f.contains:
        out = out & F.contains(F.lower("text"), F.lit(f.contains.lower()))
    return F.coalesce(out, F.lit(False))
