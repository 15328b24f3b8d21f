"""A paged service as a Spark data source: one partition per page, so that pages are fetched by the executors."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SIZE = 100
MAX_PAGES = 60


def page_count(total: int, max_pages: int = MAX_PAGES, size: int = PAGE_SIZE) -> int:
    """Pages to read, known from the first one's total."""
    return min(max_pages, math.ceil(total / size)) if total > 0 else 0


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.tries = options["url"], int(options.get("tries", "3"))
        self.max_pages = int(options.get("maxpages", options.get("maxPages", str(MAX_PAGES))))

    def fetch(self, number: int) -> str:
        for k in range(self.tries):
            try:
                with urlopen(self.url.format(page=number), timeout=30) as got:
                    return got.read().decode("utf-8", "replace")
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(1.5 * (k + 1))
        raise OSError(self.url)

    def partitions(self) -> list[Page]:
        try:
            total = int(json.loads(self.fetch(1))["result"]["pagging"]["totCount"])
        except (ValueError, KeyError, TypeError):
            total = 0
        return [Page(n) for n in range(1, max(1, page_count(total, self.max_pages)) + 1)]

    def read(self, partition: Page) -> Iterator[tuple[int, str | None]]:
        """A page's body; a page after the first that can't be read is skipped."""
        try:
            yield partition.number, self.fetch(partition.number)
        except OSError:
            if partition.number == 1:
                raise


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").option("url", "http://.../{page}")."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def list_keys(html: str) -> list[tuple[str, str]]:
    """(key, title) of a crawled list page, as the page has them."""
    found = re.findall(r"goView\('([^']+)'\)\s*;?\s*\"[^>]*>([^<]+)<", html)
    return [(k.strip(), t.strip()) for k, t in found if k.strip() and t.strip()]


class Detail(InputPartition):
    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.items = items


class CrawlReader(PagedReader):
    """Lists are walked on the driver, since each page says whether there is a next one; details are fetched by the executors."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.detail, self.delay = options["detail"], float(options.get("delay", "0.3"))
        self.tabs, self.size = options.get("tabs", "").split(","), int(options.get("size", "50"))

    def page(self, url: str) -> str:
        """A page, empty where it can't be read."""
        time.sleep(self.delay)
        try:
            with urlopen(url, timeout=30) as got:
                return got.read().decode("utf-8", "replace")
        except OSError:
            return ""

    def partitions(self) -> list[Detail]:
        """A tab ends with its second empty page in a row; keys in digits alone belong to another catalogue; the first of equal keys counts."""
        found: dict[str, str] = {}
        for tab in self.tabs:
            empty = 0
            for number in range(1, self.max_pages + 1):
                items = list_keys(self.page(self.url.format(tab=tab, page=number)))
                empty = 0 if items else empty + 1
                if empty == 2:
                    break
                for key, title in items:
                    if not key.isdecimal():
                        found.setdefault(key, title)
        items = list(found.items())
        return [Detail(items[at : at + self.size]) for at in range(0, len(items), self.size)]

    def read(self, partition: Detail) -> Iterator[tuple[str, str, str]]:
        for key, title in partition.items:
            yield key, title, self.page(self.detail.format(key=quote(key)))


class CrawlSource(DataSource):
    """spark.read.format("crawl") with url ("http://.../{tab}?page={page}"), detail ("http://.../{key}") and tabs: (key, title, html)."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "key string, title string, html string"

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(self.options)
