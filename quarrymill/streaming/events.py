"""Event logs, in batches and as streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYNC_SCHEMA = "event_id long, event_type string, source string, source_id string, rel_path string, title string, last_modified string, fingerprint string, reason string, extra map<string,string>, emitted_at timestamp, received_at timestamp"


def sliding_rate(rows: DataFrame, by: str, at: str, value: str, seconds: int) -> DataFrame:
    """``event_id, by, n, total`` over the ``seconds`` up to each event."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    w = W.partitionBy(by).orderBy(us).rangeBetween(-seconds * 1_000_000, 0)
    return rows.select("event_id", by, F.count("*").over(w).alias("n"), F.round(F.sum(value).over(w), 4).alias("total"))


def sessions(rows: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """``by, first_ts, last_ts, n``: runs of events whose neighbours are less than ``gap`` apart."""
    g = rows.groupBy(by, F.session_window(F.col(at).cast("timestamp"), gap)).agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.count("*").alias("n"))
    return g.drop("session_window")


def throughput(samples: DataFrame, seconds: int, by: str = "run") -> DataFrame:
    """``by, t, rate``: units a second between the first and the last sample of the window up to each sample.

    ``samples`` has ``t`` (milliseconds) and ``units`` so far.  A window with one sample takes the one before it;
    the first sample of a run has no rate.
    """
    w = W.partitionBy(by).orderBy("t")
    r = w.rangeBetween(-seconds * 1000, 0)
    t0, u0 = F.first("t").over(r), F.first("units").over(r)
    alone = t0 == F.col("t")
    t0, u0 = F.when(alone, F.lag("t").over(w)).otherwise(t0), F.when(alone, F.lag("units").over(w)).otherwise(u0)
    return samples.select(by, "t", F.round((F.col("units") - u0) * 1000 / F.nullif(F.col("t") - t0, F.lit(0)), 6).alias("rate"))


def stream_rates(stream: DataFrame, at: str, by: str, late: str = "10 minutes", size: str = "30 minutes", step: str = "5 minutes") -> DataFrame:
    """Events by sliding window; those later than ``late`` after the newest are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size, step), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def stream_once(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each event once, however often it is delivered within ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


_STATE = ["fingerprint", "rel_path", "emitted_at", "event_id"]
#: Versions after which a whole state is written.
WHOLE_EVERY = 32


def _last_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "source_id").agg(F.max_by(F.struct(*_STATE), F.struct("emitted_at", "event_id")).alias("r")).select("source", "source_id", *[F.col(f"r.{c}").alias(c) for c in _STATE])


def merge_state(state_path: str, whole_every: int = WHOLE_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the last state of each (source, source_id).

    A micro-batch writes only the items it names, as a version beside the others; every ``whole_every`` versions the state is
    written whole, so a batch costs what it holds and a reader few versions.  A retried batch overwrites its own version alone,
    and a lost run leaves the last one.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        items = batch.where(F.col("event_type").isin("doc", "unchanged") & F.col("source_id").isNotNull()).select("source", "source_id", *_STATE)
        _last_of(items).write.mode("overwrite").parquet(f"{state_path}/version={epoch:012d}")
        if epoch % whole_every == whole_every - 1:
            read_state(batch.sparkSession, state_path, epoch + 1).write.mode("overwrite").parquet(f"{state_path}/whole={epoch:012d}")

    return sink


def read_state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The state after all versions, or after those before an epoch; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if "=" in n and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{n}/_SUCCESS"))]
    epochs = lambda kind: sorted(int(n.partition("=")[2]) for n in done if n.startswith(f"{kind}=") and (before is None or int(n.partition("=")[2]) < before))
    whole = epochs("whole")[-1:]
    parts = [f"{state_path}/whole={e:012d}" for e in whole] + [f"{state_path}/version={e:012d}" for e in epochs("version") if not whole or e > whole[0]]
    return _last_of(reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in parts])) if parts else None


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; concurrent writers add files of their own."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
