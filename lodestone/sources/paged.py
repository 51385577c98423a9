"""Pulls page by page, as a Python data source; pages are files, as there is no network here."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pull(InputPartition):
    """All pages of one seed: they come one after the other, seeds side by side."""

    def __init__(self, seed: str):
        self.seed = seed


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.size, self.cap, self.since = int(options.get("pagesize", 100)), int(options.get("cap", 1000)), options.get("since", "")

    def partitions(self) -> list[Pull]:
        return [Pull(x) for x in sorted(os.listdir(self.folder)) if os.path.isdir(f"{self.folder}/{x}")]

    def page(self, seed: str, number: int) -> list[dict]:
        path = f"{self.folder}/{seed}/{number}.json"
        if not os.path.exists(path):
            return []
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def read(self, partition: Pull) -> Iterator[tuple]:
        """Stops at an empty page, a short one, the cap, or a page whose oldest item is older than ``since``."""
        given, number = 0, 0
        while given < self.cap:
            items = self.page(partition.seed, number)
            for item in items[: self.cap - given]:
                yield partition.seed, number, item.get("id"), item.get("title"), item.get("published")
            given += len(items)
            number += 1
            oldest = min((x["published"] for x in items if x.get("published")), default=None)
            if len(items) < self.size or (self.since and oldest and oldest < self.since):
                return


class PagedSource(DataSource):
    """``spark.read.format("paged").option("pagesize", 100).option("cap", 1000).option("since", "2025-01-01").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "seed string, page int, id string, title string, published string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
