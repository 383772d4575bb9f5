"""A paged source, such as a wiki's pages behind an API, as a Python data source: one partition for each run of pages."""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Run(InputPartition):
    def __init__(self, first: int, pages: int):
        self.first, self.pages = first, pages


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        module, name = options["fetch"].split(":")
        self.fetch = getattr(importlib.import_module(module), name)
        self.limit, self.pages, self.run = int(options.get("limit", 50)), int(options.get("pages", 1)), int(options.get("run", 10))

    def partitions(self):
        return [_Run(k, min(self.run, self.pages - k)) for k in range(0, self.pages, self.run)]

    def read(self, partition: _Run):
        for page in range(partition.first, partition.first + partition.pages):
            rows = self.fetch(page * self.limit, self.limit)
            yield from (tuple(r) for r in rows)
            if len(rows) < self.limit:
                return


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").option("fetch", "module:function")...

    fetch(start, limit) gives up to `limit` rows (id, title, text, updated_at as text) from a place on. `pages` is how
    many pages there are at most, `run` how many one task reads; a task stops at a page that isn't full.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, title string, text string, updated_at string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
