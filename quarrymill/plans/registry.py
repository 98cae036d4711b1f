"""Every query of the core operators, and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, graphs, runs, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = search.QUERIES | corpus.QUERIES | graphs.QUERIES | runs.QUERIES
ORACLE: dict[str, str] = search.ORACLE | corpus.ORACLE | graphs.ORACLE | runs.ORACLE
