import pytest
from pyspark.sql import functions as F

from quarrymill.operators import bm25, dedupe, retrieval, vectors
from quarrymill.operators.filters import Filters, predicate


def test_filters_do_not_change_statistics(spark):
    docs = spark.createDataFrame([("a", "policy manager", "en"), ("b", "policy", "it"), ("c", "other words", "en")], "id string, text string, lang string")
    q = spark.createDataFrame([(1, "policy")], "qid int, text string")
    ix = bm25.build(docs)
    free = {r["id"]: r["score"] for r in bm25.search(ix, q).collect()}
    held = {r["id"]: r["score"] for r in bm25.search(ix, q, allowed=docs.where("lang = 'it'")).collect()}
    assert held == {"b": free["b"]} and free["b"] > free["a"]


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "id string, text string")
    q = spark.createDataFrame([(1, "policy")], "qid int, text string")
    assert bm25.search(bm25.build(docs), q).count() == 0


def chunks(spark):
    return spark.createDataFrame(
        [("1", "gitlab", "doc", "2024-05-03", "A_B 100%"), ("2", "gitlab", "doc", "", "ab"), ("3", "devportal", "doc", "2024-06", "a_b"), ("4", "devportal", "api", "2025", None), ("5", None, None, None, "x")],
        "id string, source_type string, kind string, last_modified string, text string",
    ).withColumns({"authority": F.lit("unknown"), "lang": F.lit("en")})


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_predicates(spark):
    c = chunks(spark)
    assert ids(c.where(predicate(Filters(after="2024")))) == ["1", "4"]
    assert ids(c.where(predicate(Filters(before="2024-06")))) == ["1"]
    assert ids(c.where(predicate(Filters(contains="a_b")))) == ["1", "3"]
    assert ids(c.where(predicate(Filters(contains="100%")))) == ["1"]
    assert ids(c.where(predicate(Filters(kind=["api"])))) == ["4"]
    assert ids(c.where(predicate(Filters()))) == ["1", "2", "3", "4", "5"]


def test_vector_ties_and_unusable(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", [float("nan"), 1.0]), ("s", [1.0]), ("u", None)], "id string, vector array<double>")
    q = spark.createDataFrame([(7, [3.0, 0.0])], "qid int, qvec array<double>")
    out = vectors.search(v, q, 2, 2).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in out] == [("a", 0.0), ("b", 0.0)]


def test_many_queries_take_passes(spark, monkeypatch):
    v = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(50)], "id string, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "qid int, qvec array<double>")
    want = sorted(map(tuple, vectors.search(v, q, 3, 2).collect()))
    monkeypatch.setattr(vectors, "MAX_QUERIES", 7)
    assert sorted(map(tuple, vectors.search(v, q, 3, 2).collect())) == want and len(want) == 60


def test_fusion_and_cap(spark):
    v = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8)], "qid int, id string, rank int, similarity double")
    k = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "qid int, id string, rank int")
    c = spark.createDataFrame([("a", "s", "binding", "x"), ("b", "s", "none", "y"), ("c", "s", "none", "z")], "id string, source_id string, authority string, text string")
    out = retrieval.rank_fused(retrieval.fuse(v, k), c, retrieval.Options(max_per_document=2)).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in out] == [("b", 1), ("a", 2)]
    assert out[0]["score"] == round(1 / 7 + 1 / 6, 6) and out[1]["score"] == round(1 / 6 * 1.15, 6)
    assert [r["similarity"] for r in retrieval.fuse(v, k).where("id = 'c'").collect()] == [None]


def test_greedy_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(60))
    r = spark.createDataFrame([(1, "a", "s1", 1, long), (1, "b", "s2", 2, long + " tail"), (1, "c", "s1", 3, long), (1, "d", "s3", 4, "short")], "qid int, id string, source_id string, rank int, text string")
    out = {x["id"]: x["duplicates"] for x in dedupe.drop_near_duplicates(r).collect()}
    assert out == {"a": ["s2"], "c": [], "d": []}


def test_latest_row_of_a_hot_key(spark):
    rows = [("hot", f"t{i}", i) for i in range(2000)] + [("cold", "x", 0), (None, "y", 1)]
    df = spark.createDataFrame(rows, "id string, title string, n int").withColumn("indexed_at", F.timestamp_seconds(F.col("n")))
    assert sorted((r["id"], r["title"]) for r in dedupe.latest(df).collect()) == [("cold", "x"), ("hot", "t1999")]


def brute_links(texts, t=0.8, least=20):
    import re

    sets = {}
    for k, x in texts:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    seen, reps = {}, []
    for k, x in sorted(texts):
        key = tuple(re.findall(r"[^\W_]+", (x or "").lower()))
        if key not in seen:
            seen[key] = k
            reps.append(k)
    return {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if min(len(sets[a]), len(sets[b])) >= least and len(sets[a] & sets[b]) >= t * min(len(sets[a]), len(sets[b])) - 1e-9}


def test_near_links_like_brute_force(spark):
    import random

    rnd = random.Random(3)
    base = [[f"v{rnd.randrange(400)}" for _ in range(70)] for _ in range(6)]
    texts = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(rnd.randrange(8)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(9)}"
        texts.append((i, " ".join(w[: rnd.randrange(40, 71)])))
    texts += [(60, texts[0][1]), (61, None), (62, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = {(r["a"], r["b"]) for r in dedupe.near_duplicate_links(df, "doc_id", "text").collect()}
    assert out == brute_links(texts) and out


def test_best_like_search_over_an_index(spark):
    import random

    rnd = random.Random(5)
    words = [f"word{chr(97 + i)}" for i in range(12)]
    docs = [(f"d{i % 7}:{i}", " ".join(rnd.choices(words, k=rnd.randrange(0, 9)))) for i in range(400)] + [("e", None), ("f", "")]
    asked = [(i, " ".join(rnd.choices([*words, "absent"], k=rnd.randrange(0, 5)))) for i in range(40)] + [(90, "worda worda wordb"), (91, "worda worda wordb")]
    d = spark.createDataFrame(docs, "id string, text string").repartition(5)
    q = spark.createDataFrame(asked, "qid long, text string")
    rows = lambda df: sorted(map(tuple, df.select("qid", "id", "rank", "score").collect()))
    want = rows(bm25.search(bm25.build(d), q, 10))
    assert rows(bm25.best(d, q, 10)) == want and want
    assert rows(bm25.best(d.where("false"), q, 10)) == rows(bm25.best(d, q.where("false"), 10)) == []


def test_comparison_by_rows_like_by_lists(spark):
    import random

    from pyspark.sql import functions as F

    from quarrymill.operators import evaluate

    rnd = random.Random(6)
    asked = spark.createDataFrame([(i, f"t{rnd.randrange(14)}") for i in range(80)], "qid long, t string")
    hits = spark.createDataFrame([(i, f"s{rnd.randrange(12)}", r) for i in range(70) for r in range(1, rnd.randrange(2, 20))], "qid long, source_id string, rank int")
    known = spark.createDataFrame([(f"t{rnd.randrange(10)}", f"s{rnd.randrange(14)}") for _ in range(14)] + [("t11", None)], "t string, source_id string")
    lists = known.groupBy("t").agg(F.collect_set("source_id").alias("e")).select("t", "e")
    cases = asked.join(lists, "t", "left").select("qid", F.coalesce("e", F.array().cast("array<string>")).alias("expected")).withColumn("should_abstain", F.size("expected") == 0)
    want = evaluate.compare(evaluate.score_cases(cases, hits), evaluate.score_cases(cases, hits.where("rank > 3")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(evaluate.compare_without_first(asked, hits, known, 3)) == rows(want)
    assert {x["change"] for x in want.collect()} == {"regression", "fix"}


def test_comparison_keeps_less_than_its_input(spark):
    """The index of all terms, written once for each of the two runs, took many times the chunks' own size."""
    from pathlib import Path

    from quarrymill.plans import search
    from quarrymill.session import shared_folder

    data = Path("/root/testdata/sf0.001")
    if not data.is_dir():
        pytest.skip("no tables here")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    used = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = used()
    search.eval_compare(spark, str(data)).collect()
    assert 0 < used() - before < (data / "chunks.parquet").stat().st_size


def test_near_links_keep_less_than_the_texts(spark):
    """Shingles, eight bytes each, took more than the texts; what is kept are packed words and sketches."""
    from pathlib import Path

    from quarrymill.session import shared_folder

    texts = [(i, " ".join(f"word{chr(97 + (i * k) % 23)}{chr(97 + (i + k * k) % 19)}" for k in range(150))) for i in range(300)]
    folder = Path(shared_folder(spark).removeprefix("file:"))
    used = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = used()
    dedupe.near_duplicate_links(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()
    assert 0 < used() - before < sum(len(t) for _, t in texts) / 2


def test_near_links_shuffle_less_than_the_texts(spark):
    """Texts of common sentences meet at many shingles: shingles and candidate pairs were shuffled, many times the texts."""
    import random

    rnd = random.Random(8)
    sentences = [" ".join(f"w{rnd.randrange(300)}" for _ in range(9)) for _ in range(60)]
    texts = [(f"t{i}", ". ".join(rnd.sample(sentences, rnd.randrange(3, 40)))) for i in range(600)]
    for i in range(60):
        parts = texts[i][1].split(". ")
        texts.append((f"u{i}", ". ".join(parts[: max(3, len(parts) - 1)] + rnd.sample(sentences, i % 3))))
    texts += [(f"v{i}", texts[i][1].upper()) for i in range(20)] + [("short", "a b c d"), ("none", None)]
    docs = spark.createDataFrame(texts, "doc_id string, text string").repartition(3)
    shuffled = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(k) for k in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    docs = docs.checkpoint(True)
    before = shuffled()
    out = [(r["a"], r["b"]) for r in dedupe.near_duplicate_links(docs, "doc_id", "text").collect()]
    used = shuffled() - before
    assert set(out) == brute_links(sorted(texts, key=lambda t: t[0])) and len(out) == len(set(out)) > 60
    assert 0 < used < sum(len(t or "") for _, t in texts)
    # Here groups have no room for witnesses.
    assert {(r["a"], r["b"]) for r in dedupe.near_duplicate_links(docs, "doc_id", "text", 0.5).collect()} == brute_links(sorted(texts, key=lambda t: t[0]), 0.5)


def test_near_links_leave_no_files(spark):
    from pathlib import Path

    from quarrymill.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40))), (2, " ".join(f"w{i}" for i in range(44)))], "doc_id long, text string")
    out = dedupe.near_duplicate_links(docs, "doc_id", "text")
    assert not list(folder.glob("near-*"))
    assert [tuple(r) for r in out.collect()] == [(1, 2, 36, 1.0)]
    assert dedupe.near_duplicate_links(docs.where("false"), "doc_id", "text").collect() == []
