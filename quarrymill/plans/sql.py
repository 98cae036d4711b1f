"""Pieces of SQL that several checks share."""

from __future__ import annotations

from ..functions import text as T
from ..functions import values as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STOP = "[" + ", ".join(q(w) for w in V.STOP_WORDS) + "]"


def fold(x: str) -> str:
    a, b = T.folding()
    return f"lower(translate(regexp_replace({x}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), {q(a)}, {q(b)}))"


def tokens(x: str) -> str:
    keep = lambda e: f"list_filter({e}, lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"
    words = keep(f"regexp_extract_all({fold(f'coalesce({x}, {q(str())})')}, '[\\p{{L}}\\p{{N}}]+')")
    split = keep("regexp_extract_all(t, '\\p{L}+|\\p{N}+')")
    return f"flatten(list_transform({words}, lambda t: CASE WHEN regexp_matches(t, '\\p{{L}}') AND regexp_matches(t, '\\p{{N}}') THEN list_concat([t], {split}) ELSE [t] END))"


#: Chunks, each id once: the last delivery.
CHUNKS = """ch AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, title NULLS FIRST,
    authority NULLS FIRST, last_modified NULLS FIRST, rel_path NULLS FIRST, ordinal NULLS FIRST) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1)"""

#: Pages, each source_id once: the last fetch.
PAGES = """kb AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC NULLS LAST, title NULLS FIRST,
    authority NULLS FIRST, last_modified NULLS FIRST, rel_path NULLS FIRST) AS rn FROM kb_documents WHERE source_id IS NOT NULL) WHERE rn = 1)"""

#: The stated query set: every document whose id is divisible by 100 and that has a title.
ASKED = "asked AS (SELECT doc_id AS qid, title AS text FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)"

#: Keyword scores of the queries over all chunks.
BM25 = f"""
    terms AS (SELECT id, unnest(toks) AS term, len(toks) AS dl FROM (SELECT id, {tokens('text')} AS toks FROM ch)),
    postings AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM terms GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    corpus AS (SELECT count(*) AS n, avg(len({tokens('text')})) AS avgdl FROM ch),
    qterms AS (SELECT qid, term, min(pos) AS pos FROM (SELECT qid, unnest(toks) AS term, unnest(range(0, len(toks))) AS pos FROM (SELECT qid, {tokens('text')} AS toks FROM asked)) GROUP BY qid, term),
    scored AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, min(pos) AS first_pos
        FROM qterms JOIN postings USING (term) JOIN df USING (term) CROSS JOIN corpus GROUP BY qid, id)"""

#: Usable vectors: exactly 64 finite numbers, not all zero.
USABLE = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"


def mock_vector(x: str, dims: int) -> str:
    """The mock embedding before it is normalised; cosine does not need more."""
    h = "md5(w)"
    le = f"CAST('0x' || {h}[7:8] || {h}[5:6] || {h}[3:4] || {h}[1:2] AS BIGINT)"
    sign = f"CASE WHEN CAST('0x' || {h}[9:10] AS INT) % 2 = 1 THEN 1.0 ELSE -1.0 END"
    words = f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"list_transform(range(0, {dims}), lambda i: coalesce(list_sum(list_transform(list_filter({words}, lambda w: {le} % {dims} = i), lambda w: {sign})), 0.0))"
