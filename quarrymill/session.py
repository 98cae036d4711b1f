"""Session defaults, and how Python workers find this package."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Defaults for sessions that this package opens itself.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def open_session(master: str = "local[*]", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("quarrymill")
    for k, v in (DEFAULTS | extra).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    A temporary folder serves only in local mode, where this machine runs everything; elsewhere a missing setting is an error.
    """
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not where:
            import tempfile

            where = tempfile.mkdtemp(prefix="quarrymill-")
        spark.sparkContext.setCheckpointDir(where)
    return context.getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """Round robin over the cores where a scan has fewer parts than they; large inputs have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with a check that Python workers can import this package.

    Functions of an imported package are pickled by name, so workers on other machines need its files.
    The package goes out once per session as a zip, whatever PYTHONPATH the cluster has.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _ship(spark)
        return query(spark, sf_dir)

    return run


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import shutil
    import tempfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    built = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="quarrymill-")) / "quarrymill"), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(built)
    _shipped.add(app)
