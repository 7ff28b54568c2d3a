"""A cursor feed of revisions as a Spark data source: pages are JSON files, each naming the next one.

    spark.dataSource.register(FeedSource)
    spark.read.format("cursor_feed").option("path", folder).option("start", "page0.json").load()
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "uuid string, feed_id string, status string, title string, business_name string, municipal string, modified string, url string, page string"
MOST_PAGES = 2000


def read_page(folder: str, name: str) -> tuple[list[tuple], str | None]:
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        page = json.load(f)
    rows = []
    for item in page.get("items") or []:
        entry = item.get("_feed_entry") or {}
        rows.append((entry.get("uuid"), item.get("id"), entry.get("status"), entry.get("title"), entry.get("businessName"), entry.get("municipal"), entry.get("sistEndret"), item.get("url"), name))
    return rows, page.get("next_url")


def walk(folder: str, start: str, most: int = MOST_PAGES) -> Iterator[tuple[str, list[tuple]]]:
    """(page, rows) from `start` on, until a page is missing or empty, or names no next one."""
    name: str | None = start
    for _ in range(most):
        if not name or not os.path.exists(os.path.join(folder, name)):
            return
        rows, following = read_page(folder, name)
        if not rows:
            return
        yield name, rows
        name = following


class FeedReader(DataSourceReader):
    """One partition: a page's address is known only from the page before it."""

    def __init__(self, options):
        self.folder, self.start, self.most = options["path"], options.get("start", "page0.json"), int(options.get("maxpages", MOST_PAGES))

    def partitions(self):
        return [InputPartition(self.start)]

    def read(self, partition):
        for _, rows in walk(self.folder, partition.value, self.most):
            yield from rows


class FeedStream(SimpleDataSourceStreamReader):
    """The same walk as a stream; the offset is the cursor, kept in the checkpoint."""

    def __init__(self, options):
        self.folder, self.start = options["path"], options.get("start", "page0.json")

    def initialOffset(self):
        return {"next": self.start}

    def read(self, start):
        name = start["next"]
        if not name or not os.path.exists(os.path.join(self.folder, name)):
            return iter([]), start
        rows, following = read_page(self.folder, name)
        return iter(rows), {"next": following or ""}

    def readBetweenOffsets(self, start, end):
        name = start["next"]
        rows = []
        while name and name != end["next"]:
            own, name = read_page(self.folder, name)
            rows += own
        return iter(rows)

    def commit(self, end):
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls):
        return "cursor_feed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FeedReader(self.options)

    def simpleStreamReader(self, schema):
        return FeedStream(self.options)
