"""Incremental runs, answers, evaluation, event logs."""

from pyspark.sql import functions as F

from quarrymill.operators import answers, evaluate, incremental
from quarrymill.streaming import events


def test_incremental(spark):
    docs = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z"), ("d", "4", "n")], "source_id string, content_hash string, embed_hash string")
    man = spark.createDataFrame([("a", "1", "x"), ("b", "9", "y"), ("c", "9", "q"), ("gone", "1", None)], "source_id string, content_hash string, embed_hash string")
    out = {r["source_id"]: r["status"] for r in incremental.classify(docs, man).collect()}
    assert out == {"a": "unchanged", "b": "refresh", "c": "changed", "d": "added", "gone": "removed"}
    assert "gone" not in {r["source_id"] for r in incremental.classify(docs, man, complete=False).collect()}


def test_reuse_needs_every_chunk(spark):
    new = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("c", 0, "x")], "source_id string, ordinal int, text string")
    old = spark.createDataFrame([("a", 0, "x", [1.0]), ("a", 1, "y", [1.0]), ("b", 0, "changed", [1.0]), ("c", 0, "x", [1.0]), ("c", 1, "more", [1.0])], "source_id string, ordinal int, text string, vector array<float>")
    assert {r["source_id"]: r["reuse"] for r in incremental.reusable(new, old, 1).collect()} == {"a": True, "b": False, "c": False}


def test_budget_and_carry(spark):
    rows = spark.createDataFrame([("q", 1, 900), ("q", 2, 50), ("q", 3, 10), ("r", 1, 30)], "q string, n int, size int")
    kept = answers.budget_prefix(rows, "q", [F.asc("n")], F.col("size"), 100)
    assert sorted((r["q"], r["n"]) for r in kept.collect()) == [("q", 1), ("r", 1)]
    blocks = spark.createDataFrame([("c", 1, "x", 80, False), ("c", 2, "y", 50, False), ("c", 3, "z", 60, True), ("c", 4, "x", 40, False)], "conv string, n int, chunk_id string, size int, cited boolean")
    assert [(r["n"], r["chunk_id"]) for r in answers.carry_blocks(blocks, 24, 100).orderBy("n").collect()] == [(3, "z"), (4, "x")]


def test_citations(spark):
    df = spark.createDataFrame([("see [3] and [1], [3] [99]", [1, 2, 3])], "t string, v array<int>")
    assert df.select(answers.cited_numbers(F.col("t"), F.col("v")).alias("c")).first()["c"] == [3, 1]


def test_scores(spark):
    cases = spark.createDataFrame([(1, ["b", "z"], False), (2, [], True), (3, ["q"], False)], "qid int, expected array<string>, should_abstain boolean").withColumn("lang", F.lit("en"))
    hits = spark.createDataFrame([(1, s, i) for i, s in enumerate("aabcb", 1)], "qid int, source_id string, rank int")
    scored = evaluate.score_cases(cases, hits)
    assert {r["qid"]: (r["rank"], r["recall"]) for r in scored.collect()} == {1: (2, 0.5), 2: (None, 0.0), 3: (None, 0.0)}
    all_ = evaluate.summarise(scored, ["lang"]).where("grouping = 'all'").first()
    assert (all_["hit_at_k"], all_["mrr"], all_["pass_rate"]) == (0.5, 0.25, 0.666667)


def test_stride_sample(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    got = sorted(r["k"] for r in evaluate.stride_sample(rows, "k", 10).collect())
    assert got == list(range(0, 1000, 100))


def test_throughput(spark):
    s = spark.createDataFrame([("r", 0, 0), ("r", 1000, 10), ("r", 2000, 30), ("r", 100000, 130)], "run string, t long, units long")
    assert [r["rate"] for r in events.throughput(s, 5).orderBy("t").collect()] == [None, 10.0, 15.0, round(100 / 98, 6)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "doc", "s", "a", "f1", "2025-01-01 00:00:00"), (2, "doc", "s", "a", "f2", "2025-01-01 00:10:00"), (2, "doc", "s", "a", "f2", "2025-01-01 00:10:00"), (3, "skip", "s", "b", None, "2025-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "event_id long, event_type string, source string, source_id string, fingerprint string, at string").withColumn("emitted_at", F.to_timestamp("at")).withColumn("rel_path", F.lit("p")).drop("at")
    df.write.parquet(str(src))
    state = str(tmp_path / "state")
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = stream.writeStream.foreachBatch(events.merge_state(state)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = events.read_state(spark, state).collect()
    assert [(r["source_id"], r["fingerprint"]) for r in got] == [("a", "f2")]
    out = events.stream_rates(spark.readStream.schema(df.schema).parquet(str(src)), "emitted_at", "source")
    q = out.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from rates").first()[0] == 4 * 6
    once = events.stream_once(spark.readStream.schema(df.schema).parquet(str(src)), "event_id", "emitted_at", "1 hour")
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from once").first()[0] == 3


def test_logs(spark, tmp_path):
    p = str(tmp_path / "log")
    events.append_log(spark.createDataFrame([("a", 1)], "k string, n int"), p)
    events.append_log(spark.createDataFrame([("b", 2)], "k string, n int"), p)
    (tmp_path / "log" / "extra.json").write_text("not json\n")
    assert sorted(r["k"] for r in events.read_log(spark, p, "k string, n int").collect()) == ["a", "b"]


def test_state_of_many_batches(spark, tmp_path):
    """Versions hold what a batch names; a whole state now and then; a retried batch changes nothing."""
    import os

    state = str(tmp_path / "state")
    sink = events.merge_state(state, whole_every=3)
    batch = lambda k: spark.createDataFrame([(k * 10 + i, "doc", "s", f"i{(k + i) % 4}", f"f{k}{i}", None, f"2025-01-01 00:00:{k:02d}") for i in range(2)], "event_id long, event_type string, source string, source_id string, fingerprint string, rel_path string, emitted_at string")
    want = {}
    for k in range(7):
        sink(batch(k), k)
        want |= {f"i{(k + i) % 4}": f"f{k}{i}" for i in range(2)}
        if k == 4:
            sink(batch(k), k)
        assert {r["source_id"]: r["fingerprint"] for r in events.read_state(spark, state).collect()} == want
    assert sorted(n for n in os.listdir(state) if n.startswith("whole")) == ["whole=000000000002", "whole=000000000005"]
    assert spark.read.parquet(f"{state}/version=000000000006").count() == 2 and events.read_state(spark, str(tmp_path / "none")) is None
