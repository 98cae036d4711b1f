"""Globs and wildcards as anchored regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` within a folder, ``?`` one character of a name; case does not matter."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return "(?i)^" + "".join(out) + "$"


def wildcard_regex(pattern: str) -> str:
    """``*`` anything, ``?`` one character; case does not matter."""
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out
