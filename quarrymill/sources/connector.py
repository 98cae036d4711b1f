"""Connectors as a Spark data source: pages of records from anything that lists them.

``register(spark)`` makes ``spark.read.format("listing")`` available.  The transport is a function named by
``module:function``; it takes a cursor and the options and returns (records, next cursor).  Tests use a stub, and
a deployment names its own client: no network code lives here.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, source_id string, rel_path string, title string, url string, last_modified string, fingerprint string, body string"


class Shard(InputPartition):
    def __init__(self, root: str):
        self.root = root


def with_retries(call: Callable, attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> object:
    """``call()`` again after a failure that may pass, waiting twice as long each time, at most 30 seconds."""
    for n in range(attempts + 1):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if n == attempts:
                raise
            wait(min(30.0, 0.5 * 2**n) + random.random() * 0.1)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [Shard(r) for r in self.options.get("roots", "").split(",") if r] or [Shard("")]

    def read(self, partition: Shard) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        cursor = None
        for _ in range(int(self.options.get("max_pages", "1000"))):
            records, cursor = with_retries(lambda: fetch(partition.root, cursor, dict(self.options)))
            for r in records:
                yield tuple(r.get(c.split()[0]) for c in SCHEMA.split(", "))
            if not cursor:
                return


class ListingSource(DataSource):
    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
