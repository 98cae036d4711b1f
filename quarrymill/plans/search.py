"""Queries: keyword, vector and hybrid search, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, bm25, evaluate, retrieval, vectors
from ..operators.filters import Filters, predicate
from . import data
from .sql import ASKED, BM25, CHUNKS, USABLE, mock_vector, tokens

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"WITH {CHUNKS} SELECT id, len({tokens('text')}) AS n_tokens, len(list_distinct({tokens('text')})) AS n_terms FROM ch")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = data.chunks(spark, d, "text").select("id", T.tokenize(F.col("text")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(f"WITH {CHUNKS}, t AS (SELECT unnest({tokens('text')}) AS term FROM ch) SELECT term, count(*) AS n FROM t WHERE regexp_matches(term, '\\p{{N}}') GROUP BY term")
def tokenize_alnum_split(spark: SparkSession, d: str) -> DataFrame:
    t = data.chunks(spark, d, "text").select(F.explode(T.tokenize(F.col("text"))).alias("term"))
    return t.where(F.col("term").rlike(r"\p{N}")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS}, {ASKED}, {BM25} SELECT term, df.df AS df, sum(tf)::BIGINT AS cf, round(max(ln(1 + (n - df.df + 0.5) / (df.df + 0.5))), 6) AS idf FROM postings JOIN df USING (term) CROSS JOIN corpus GROUP BY term, df.df")
def bm25_build_stats(spark: SparkSession, d: str) -> DataFrame:
    ix = bm25.build(data.chunks(spark, d, "text"), keep=True)
    cf = ix.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("n", ix.corpus.select("n").scalar())
    return cf.select("term", "df", "cf", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


_TOP = "SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_pos, id) AS rank FROM {src} QUALIFY rank <= {k}"


@query(f"WITH {CHUNKS}, {ASKED}, {BM25} {_TOP.format(src='scored', k=24)}")
def bm25_top24(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(bm25.build(data.chunks(spark, d, "text"), keep=True), data.asked(spark, d))


@query(f"WITH {CHUNKS}, {ASKED}, {BM25}, f AS (SELECT s.* FROM scored s JOIN ch USING (id) WHERE ch.lang IN ('en', 'it') AND ch.kind = 'doc') {_TOP.format(src='f', k=24)}")
def bm25_filtered_stats_invariant(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "text", "lang", "kind")
    return bm25.search(bm25.build(ch, keep=True), data.asked(spark, d), allowed=ch.where(predicate(Filters(lang=["en", "it"], kind=["doc"]))))


_VEC = """SELECT qid, id, d AS distance, round(1 - d, 6) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (
    SELECT q.vec_id AS qid, e.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS d
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 {more}) QUALIFY rank <= 24"""


@query(_VEC.format(more=""))
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    e = data.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.search(e, e.where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("vector").alias("qvec")))


@query(_VEC.format(more="AND e.label IN (1, 3, 5)"))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = data.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    qs = e.where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    return vectors.search(e.where(F.col("label").isin(1, 3, 5)), qs)


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS w FROM documents),
    p AS (SELECT doc_id, CAST('0x' || md5(w)[7:8] || md5(w)[5:6] || md5(w)[3:4] || md5(w)[1:2] AS BIGINT) % 256 AS i, CASE WHEN CAST('0x' || md5(w)[9:10] AS INT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM w)
    SELECT doc_id, i, sum(s)::BIGINT AS value FROM p GROUP BY doc_id, i"""
)
def mock_embed_components(spark: SparkSession, d: str) -> DataFrame:
    return vectors.embedding_components(data.read(spark, d, "documents").select("doc_id", F.col("title").alias("text")), "doc_id")


@query(f"WITH {CHUNKS} SELECT id, round(sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])), 5) AS norm, round(list_sum(list_transform(vector[1:16], lambda x: x::DOUBLE * x::DOUBLE)) / list_inner_product(vector::DOUBLE[], vector::DOUBLE[]), 5) AS head_share FROM ch WHERE {USABLE.format(v='vector')}")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "vector").where(vectors.usable(F.col("vector"), 64))
    unit = vectors.l2_normalise(F.col("vector"))
    return ch.select("id", F.round(vectors.norm(F.col("vector")), 5).alias("norm"), F.round(vectors.dot(F.slice(unit, 1, 16), F.slice(unit, 1, 16)), 5).alias("head_share"))


_FUSED = f"""WITH {CHUNKS}, {ASKED}, {BM25},
    kw AS ({_TOP.format(src='scored', k=24)}),
    qv AS (SELECT qid, {mock_vector('text', 64)} AS qvec FROM asked),
    vd AS (SELECT qid, id, round(1 - list_cosine_similarity(qvec::DOUBLE[], vector::DOUBLE[]), 6) AS d FROM qv, ch WHERE {USABLE.format(v='vector')} AND {USABLE.format(v='qvec')}),
    vc AS (SELECT qid, id, round(1 - d, 6) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM vd QUALIFY rank <= 24),
    fused AS (SELECT coalesce(v.qid, k.qid) AS qid, coalesce(v.id, k.id) AS id, v.rank AS vector_rank, k.rank AS keyword_rank, v.similarity,
        coalesce(1.0 / (5 + v.rank), 0) + coalesce(1.0 / (5 + k.rank), 0) AS score FROM vc v FULL JOIN kw k ON v.qid = k.qid AND v.id = k.id)"""
_RANKED = """, boosted AS (SELECT f.* EXCLUDE (score), ch.source_id, round(score * CASE authority WHEN 'binding' THEN 1.15 WHEN 'normative' THEN 1.12 ELSE 1 END, 6) AS score FROM fused f JOIN ch USING (id)),
    capped AS (SELECT * FROM boosted QUALIFY row_number() OVER (PARTITION BY qid, source_id ORDER BY score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, id) <= 3)
    SELECT qid, id, source_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, id) AS rank FROM capped"""


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return data.asked(spark, d).withColumn("qvec", vectors.mock_embedding(F.col("text"), 64))


def _search_chunks(spark: SparkSession, d: str) -> DataFrame:
    return data.chunks(spark, d, "text", "vector", "source_id", "authority", "lang", "kind", "source_type", "last_modified")


@query(_FUSED + " SELECT qid, id, round(score, 6) AS score, vector_rank, keyword_rank, similarity FROM fused")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    ch, qs = _search_chunks(spark, d), _asked_vectors(spark, d)
    fused = retrieval.fuse(vectors.search(ch.select("id", "vector"), qs, 24, 64), bm25.search(bm25.build(ch, keep=True), qs))
    return fused.select("qid", "id", F.round("score", 6).alias("score"), "vector_rank", "keyword_rank", "similarity")


@query(_FUSED + _RANKED + " QUALIFY rank <= 6")
def hybrid_rrf_boosted(spark: SparkSession, d: str) -> DataFrame:
    ch = _search_chunks(spark, d)
    found = retrieval.search(ch, _asked_vectors(spark, d), bm25.build(ch, keep=True), o=retrieval.Options(drop_duplicates=False))
    return found.select("qid", "id", "source_id", "score", "rank")


@query(f"SELECT qid, source_id, count(*) AS n FROM ({_FUSED + _RANKED}) GROUP BY qid, source_id")
def hybrid_doc_cap(spark: SparkSession, d: str) -> DataFrame:
    ch, qs = _search_chunks(spark, d), _asked_vectors(spark, d)
    fused = retrieval.fuse(vectors.search(ch.select("id", "vector"), qs, 24, 64), bm25.search(bm25.build(ch, keep=True), qs))
    return retrieval.rank_fused(fused, ch).groupBy("qid", "source_id").agg(F.count("*").alias("n"))


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, with filters and without near duplicates (greedy, so no SQL)."""
    ch = _search_chunks(spark, d)
    return retrieval.search(ch, _asked_vectors(spark, d), bm25.build(ch, keep=True), filters=Filters(kind=["doc", "api", "project"])).select("qid", "id", "source_id", "score", "rank", F.size("duplicates").alias("n_duplicates"))


_CASES = f"""cases AS (SELECT a.qid, a.text, d.lang, d.source, coalesce(e.expected, []) AS expected, len(coalesce(e.expected, [])) = 0 AS should_abstain FROM asked a JOIN documents d ON a.qid = d.doc_id
    LEFT JOIN (SELECT lower(title) AS t, list_sort(list(DISTINCT source_id)) AS expected FROM ch WHERE title IS NOT NULL GROUP BY 1) e ON lower(a.text) = e.t)"""
_SCORED = f"""hits AS (SELECT s.qid, ch.source_id, s.rank FROM ({_TOP.format(src='scored', k=24)}) s JOIN ch USING (id)),
    docs AS (SELECT qid, list(source_id ORDER BY r, source_id) AS retrieved FROM (SELECT qid, source_id, min(rank) AS r FROM hits GROUP BY qid, source_id) GROUP BY qid),
    {_CASES},
    judged AS (SELECT c.*, coalesce(d.retrieved, []) AS retrieved, list_min(list_filter(list_transform(expected, lambda e: list_position(coalesce(d.retrieved, []), e)), lambda p: p > 0)) AS rank,
        CASE WHEN len(expected) > 0 THEN round(len(list_intersect(expected, coalesce(d.retrieved, []))) / len(expected), 6) ELSE 0.0 END AS recall FROM cases c LEFT JOIN docs d USING (qid))"""


def _cases(spark: SparkSession, d: str, ch: DataFrame) -> DataFrame:
    """Questions whose answer is known: the documents that carry the question as their title."""
    e = ch.where(F.col("title").isNotNull()).groupBy(F.lower("title").alias("t")).agg(F.sort_array(F.collect_set("source_id")).alias("expected"))
    docs = data.read(spark, d, "documents").select(F.col("doc_id").alias("qid"), "lang", "source")
    a = data.asked(spark, d).join(docs, "qid")
    j = a.join(e, F.lower(a["text"]) == e["t"], "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
    return j.select("qid", "text", "lang", "source", "expected", (F.size("expected") == 0).alias("should_abstain"))


def _scored(spark: SparkSession, d: str, k: int = 24, after: int = 0) -> DataFrame:
    ch = data.chunks(spark, d, "text", "title", "source_id")
    hits = bm25.search(bm25.build(ch, keep=True), data.asked(spark, d), k).where(F.col("rank") > after).join(ch.select("id", "source_id"), "id")
    return evaluate.score_cases(_cases(spark, d, ch), hits)


@query(f"WITH {CHUNKS}, {ASKED}, {BM25}, {_SCORED} SELECT qid, rank::INT AS rank, recall, len(retrieved) AS n_retrieved, should_abstain FROM judged")
def eval_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("qid", "rank", "recall", F.size("retrieved").cast("long").alias("n_retrieved"), "should_abstain")


_MEASURES = """count(*) AS n, count_if(NOT should_abstain) AS answerable, round(avg(CASE WHEN NOT should_abstain THEN CASE WHEN rank <= 6 THEN 1.0 ELSE 0.0 END END), 6) AS hit_at_k,
    round(avg(CASE WHEN NOT should_abstain THEN coalesce(1.0 / rank, 0) END), 6) AS mrr, round(avg(CASE WHEN NOT should_abstain THEN recall END), 6) AS recall,
    round(avg(CASE WHEN should_abstain OR coalesce(rank <= 6, false) THEN 1.0 ELSE 0.0 END), 6) AS pass_rate"""


@query(
    f"""WITH {CHUNKS}, {ASKED}, {BM25}, {_SCORED} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS grouping,
    CASE WHEN grouping(lang) = 0 THEN coalesce(lang, '(none)') WHEN grouping(source) = 0 THEN coalesce(source, '(none)') ELSE 'all' END AS value, {_MEASURES}
    FROM judged GROUP BY GROUPING SETS ((lang), (source), ())"""
)
def eval_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summarise(_scored(spark, d), ["lang", "source"])


@query(
    f"""WITH {CHUNKS}, {ASKED}, {BM25}, {_SCORED}, few AS (SELECT qid, list(source_id ORDER BY r, source_id) AS got FROM (SELECT qid, source_id, min(rank) AS r FROM hits WHERE rank > 3 GROUP BY qid, source_id) GROUP BY qid),
    a AS (SELECT j.qid, should_abstain OR coalesce(rank <= 6, false) AS was, should_abstain OR coalesce(list_min(list_filter(list_transform(expected, lambda e: list_position(coalesce(f.got, []), e)), lambda p: p > 0)) <= 6, false) AS now FROM judged j LEFT JOIN few f USING (qid))
    SELECT qid, CASE WHEN was THEN 'regression' ELSE 'fix' END AS change FROM a WHERE was <> now"""
)
def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    """The search against the same search without its first three passages."""
    ch, asked = data.chunks(spark, d, "title", "source_id"), data.asked(spark, d)
    hits = bm25.best(data.chunks(spark, d, "text"), asked).join(ch.select("id", "source_id"), "id")
    known = ch.select(F.lower("title").alias("t"), "source_id")
    return evaluate.compare_without_first(asked.select("qid", F.lower("text").alias("t")), hits, known, 3)


@query(
    f"""WITH {CHUNKS}, {ASKED}, {_CASES}, norm AS (SELECT *, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS q FROM cases), ex AS (SELECT qid, unnest(expected) AS s FROM cases)
    SELECT qid, 'repeated id' AS problem FROM cases GROUP BY qid HAVING count(*) > 1
    UNION ALL SELECT n.qid, 'repeated question' FROM norm n JOIN (SELECT q, min(qid) AS f FROM norm GROUP BY q) USING (q) WHERE n.qid <> f
    UNION ALL SELECT DISTINCT qid, 'unknown document' FROM ex WHERE s NOT IN (SELECT source_id FROM kb_documents WHERE source_id IS NOT NULL)
    UNION ALL SELECT DISTINCT qid, 'crowded document' FROM ex WHERE s IN (SELECT s FROM ex GROUP BY s HAVING count(DISTINCT qid) > 4)"""
)
def eval_dataset_validate(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "title", "source_id")
    return evaluate.validate_cases(_cases(spark, d, ch), data.read(spark, d, "kb_documents").select("source_id").where(F.col("source_id").isNotNull()))


@query(f"SELECT qid, source_id, min(rank) AS best, count(*) AS passages FROM (WITH {CHUNKS}, {ASKED}, {BM25} SELECT s.*, ch.source_id FROM ({_TOP.format(src='scored', k=24)}) s JOIN ch USING (id)) GROUP BY qid, source_id")
def results_by_document(spark: SparkSession, d: str) -> DataFrame:
    ch = data.chunks(spark, d, "text", "source_id")
    hits = bm25.search(bm25.build(ch, keep=True), data.asked(spark, d)).join(ch.select("id", "source_id"), "id")
    return answers.group_by_document(hits).select("qid", "source_id", "best", "passages")
