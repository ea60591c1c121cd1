"""A paged feed as a Spark data source: one input partition for each page, fetched where it is read.

    register(spark)
    spark.read.format("salesflow_pages").option("url", "http://host/promotions?page={page}").load()

Options: url with {page} (http, https, or a file or folder that pyarrow's file systems reach), first (1), cap (1000), pages (how
many; else the driver finds the last page by doubling and halving, a few fetches). A page that lacks data or pagination,
has another number, or says wrongly whether one follows is an error of its task.
"""

from __future__ import annotations

import json
import sys
import urllib.request

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from salesflow.sources.feeds import PROMOTION, FeedError

FIELDS = [c.split()[0] for c in PROMOTION.split(", ")]


def fetch(url: str) -> bytes | None:
    """A page's bytes, None if it is not there; the part files of a folder are joined."""
    if url.startswith(("http://", "https://")):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return None
            raise
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return None
    files = [path]
    if info.type == fs.FileType.Directory:
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith(("_", ".")))
    return b"".join(system.open_input_stream(f).read() for f in files)


def page_of(url: str, number: int) -> dict | None:
    """A page that keeps the contract, None if it is not there."""
    body = fetch(url.format(page=number))
    if body is None:
        return None
    try:
        page = json.loads(body)
        records, place = page["data"], page["pagination"]
        good = isinstance(records, list) and isinstance(place["has_next"], bool) and place["page"] == number
    except (ValueError, TypeError, KeyError) as error:
        raise FeedError(f"page {number} lacks data or pagination") from error
    if not good:
        raise FeedError(f"page {number} lacks data or pagination")
    return page


class Page(InputPartition):
    def __init__(self, number: int, last: int):
        self.number, self.last = number, last


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.first, self.cap = options["url"], int(options.get("first", 1)), int(options.get("cap", 1000))
        self.pages = int(options["pages"]) if "pages" in options else None

    def _ends(self, number: int) -> bool:
        """Whether no page follows."""
        page = page_of(self.url, number)
        return page is None or not page["pagination"]["has_next"]

    def partitions(self) -> list[Page]:
        if self.pages is not None:
            last = self.first + self.pages - 1
        else:
            step, before = 1, self.first - 1  # the page before is there and not the last
            while not self._ends(before + step):
                before, step = before + step, step * 2
                if before - self.first + 1 >= self.cap:
                    raise FeedError(f"more than {self.cap} pages")
            low, last = before, before + step
            while last - low > 1:
                middle = (low + last) // 2
                low, last = (low, middle) if self._ends(middle) else (middle, last)
        if last - self.first + 1 > self.cap:
            raise FeedError(f"{last - self.first + 1} pages are more than {self.cap}")
        return [Page(n, last) for n in range(self.first, last + 1)]

    def read(self, partition: Page):
        page = page_of(self.url, partition.number)
        if page is None:
            raise FeedError(f"page {partition.number} is missing")
        if page["pagination"]["has_next"] != (partition.number < partition.last):
            raise FeedError(f"page {partition.number} says wrongly whether one follows")
        said = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        for at, record in enumerate(page["data"]):
            yield (partition.number, at, *(said(record.get(f)) for f in FIELDS))


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "salesflow_pages"

    def schema(self) -> str:
        return f"page int, record_index int, {PROMOTION}"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session; its code travels with it, so executors need not have the library."""
    for module in (sys.modules[__name__], sys.modules["salesflow.sources.feeds"]):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(PageSource)
