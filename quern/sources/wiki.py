"""A wiki behind a paged interface as a data source with filter push-down, and the paths of its pages."""

from __future__ import annotations

import importlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition


class _Part(InputPartition):
    def __init__(self, first: int = 0, pages: int = 0, one: str | None = None):
        self.first, self.pages, self.one = first, pages, one


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        module, name = options["api"].split(":")
        self.api = getattr(importlib.import_module(module), name)
        self.space = options.get("space", "")
        self.limit, self.pages, self.run = int(options.get("limit", 50)), int(options.get("pages", 1)), int(options.get("run", 10))
        self.one, self.since, self.strict = None, None, False

    def pushFilters(self, filters):
        """An id and an earliest time of change are left to the wiki; all else Spark filters."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column == "id" and self.one is None:
                self.one = str(f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and column == "updated_at" and self.since is None:
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                self.since, self.strict = at, isinstance(f, GreaterThan)
            else:
                yield f

    def partitions(self):
        if self.one is not None:
            return [_Part(one=self.one)]
        return [_Part(k, min(self.run, self.pages - k)) for k in range(0, self.pages, self.run)]

    def read(self, partition: _Part):
        for page in self._pages(partition):
            when = datetime.fromisoformat(page["when"].replace("Z", "+00:00")) if page.get("when") else None
            if when is not None and when.tzinfo is None:
                when = when.replace(tzinfo=timezone.utc)
            # the wiki's filter knows minutes only
            if self.since is not None and (when is None or when < self.since or (self.strict and when == self.since)):
                continue
            yield (str(page["id"]), page.get("title"), page.get("html") or "", page.get("author"), when, page.get("version"), page.get("parent"), self.space)

    def _pages(self, partition: _Part):
        if partition.one is not None:
            page = self.api.one(partition.one)
            if page is not None:
                yield page
            return
        since = None if self.since is None else self.since.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M")
        for k in range(partition.first, partition.first + partition.pages):
            found = self.api.search(self.space, since, k * self.limit, self.limit)
            yield from found
            if len(found) < self.limit:
                return


class WikiSource(DataSource):
    """spark.dataSource.register(WikiSource); spark.read.format("wiki").option("api", "module:object")...

    The object has search(space, since, start, limit), which gives up to `limit` pages from a place on, and one(id), which
    gives a page or None; a page is a dict of id, title, html, author, when (ISO time), version, parent (id or None).
    `pages` is how many pages of results there are at most, `run` how many one task reads; a task stops at one
    that isn't full. With spark.sql.python.filterPushdown.enabled a filter on updated_at (>, >=) is sent as `since`, to
    the minute, and held exactly here, and id = '...' fetches that page only. Spark keeps one reader for what a load() returns: load again
    for another query that is planned before this one has run.
    """

    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return "id string, title string, html string, author string, updated_at timestamp, version int, parent_id string, space string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def page_paths(pages: DataFrame, most: int = 32) -> DataFrame:
    """id, path of pages (id, title, parent_id): the titles from the top page to the page, joined by ` / `, up to `most` levels.

    Each round joins the pages that were placed last with their children. A parent that isn't there begins no path: its
    children stand at the top. Pages in a circle don't come back.
    """
    from quern.store import materialised

    known = pages.select(F.col("id").alias("parent_id")).distinct()
    inside = materialised(pages.select("id", F.coalesce("title", F.lit("")).alias("title"), "parent_id").join(known, "parent_id", "left_semi"))
    tops = pages.join(inside.select("id"), "id", "left_anti")
    found = last = materialised(tops.select("id", F.coalesce("title", F.lit("")).alias("path")))
    for _ in range(most):
        last = materialised(inside.join(last.withColumnRenamed("id", "parent_id"), "parent_id").select("id", F.concat_ws(" / ", "path", "title").alias("path")))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def wiki_documents(pages: DataFrame) -> DataFrame:
    """source_id, path, title, author, updated_at, content, content_type, page_id, version of WikiSource's pages."""
    placed = pages.join(page_paths(pages), "id", "left")
    return placed.select(F.concat(F.lit("wiki_"), "id").alias("source_id"), "path", "title", "author", "updated_at", F.col("html").alias("content"), F.lit("html").alias("content_type"), F.col("id").alias("page_id"), "version")
