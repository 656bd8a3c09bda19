"""The sources as tables: ``spark.read.format("europe_pmc" | "arxiv")``, read on the executors.

Options: ``query``; ``limit`` (hits of the query before Spark's own filters), ``page_size``,
``readers`` (partitions), ``start_date``, ``end_date``, ``slices`` (Europe PMC: the range of dates in so many
parts, each with a cursor of its own), ``spacing`` (seconds between requests in all), ``retries``, ``base_url``.

Filters on ``publication_date`` and, for arXiv, ``category`` narrow the query that is sent; Spark checks
every filter again, since a source's ranges are days. ``position`` is a hit's place in the source's
order, which slices keep as they go from the latest days to the earliest.

Requests keep their distance across the whole cluster without a
coordinator: time is dealt into slots of ``spacing`` seconds, and of n readers the i-th may only
begin a request in slots whose number leaves i by n, one in each. That takes clocks that agree and one scan
of a source at a time. A page that fails is asked for again by itself; a cursor goes on where it was.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import SourceError
from . import arxiv, europe_pmc

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SLICE = 1 << 40
_DAY = re.compile(r"\d{4}-\d\d-\d\d")


@dataclass
class Share(InputPartition):
    """The pages or slices of one reader: number, number + of, number + 2 of, ..."""

    number: int
    of: int
    total: int


class Slots:
    """Lets the ``number``-th of ``of`` readers begin in its own slots of time alone."""

    def __init__(self, spacing: float, number: int = 0, of: int = 1):
        self.spacing, self.number, self.of, self.last = spacing, number, of, -1

    def wait(self) -> None:
        if not self.spacing:
            return
        slot = max(self.last + 1, int(time.time() / self.spacing) + 1)
        slot += (self.number - slot) % self.of
        self.last = slot
        time.sleep(max(0.0, slot * self.spacing - time.time()))


class Reader(DataSourceReader):
    """What the sources share: options, pushed filters, requests."""

    days = ("publication_date",)

    def __init__(self, options: dict, base_url: str, most: int, spacing: float):
        if not (query := options.get("query")):
            raise SourceError("a search needs the option query")
        number = lambda name, default: int(options.get(name, default))
        self.query, self.limit = query, number("limit", 1 << 40)
        self.size, self.readers, self.retries = min(number("page_size", most), most, max(1, self.limit)), max(1, number("readers", 4)), number("retries", 3)
        self.start, self.end = options.get("start_date"), options.get("end_date")
        self.slices, self.spacing = max(1, number("slices", 1)), float(options.get("spacing", spacing))
        self.base_url, self.categories = options.get("base_url", base_url), None

    def pushFilters(self, filters):
        """Takes what narrows the query, and gives every filter back to be checked by Spark too."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == self.days and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and _DAY.match(str(f.value)):
                day = f.value[:10]
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.start = max(self.start or day, day)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.end = min(self.end or day, day)
            elif name == ("category",) and isinstance(f, EqualTo | In):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.categories = some if self.categories is None else self.categories & some
            yield f

    def get(self, slots: Slots, path: str, **params) -> bytes:
        """The answer to one request, asked for again where that may help."""
        url = f"{self.base_url}{path}?{urllib.parse.urlencode(params)}"
        for left in range(self.retries, -1, -1):
            slots.wait()
            try:
                with urllib.request.urlopen(url, timeout=60) as answer:
                    return answer.read()
            except (OSError, urllib.error.URLError) as e:
                refused = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code != 429
                if refused or not left:
                    raise SourceError(f"{url}: {e}") from e
        raise AssertionError

    def probe(self) -> Slots:
        return Slots(self.spacing)


class EuropePmcReader(Reader):
    def dated(self, start: str | None, end: str | None) -> str:
        return europe_pmc.dated(self.query, start, end)

    def ranges(self) -> list[tuple[str | None, str | None]]:
        """The slices of the asked days, the latest first."""
        if self.slices == 1 or not (self.start and self.end):
            return [(self.start, self.end)]
        first, last = date.fromisoformat(self.start), date.fromisoformat(self.end)
        days = max(0, (last - first).days + 1)
        n = max(1, min(self.slices, days))
        edges = [first + timedelta(days * i // n) for i in range(n + 1)]
        return [(a.isoformat(), (b - timedelta(1)).isoformat()) for a, b in zip(edges, edges[1:], strict=False)][::-1]

    def partitions(self):
        n = len(self.ranges())
        readers = min(self.readers, n)
        return [Share(i, readers, n) for i in range(readers)]

    def read(self, partition: Share):
        slots, ranges = Slots(self.spacing, partition.number, partition.of), self.ranges()
        order = {"sort": "P_PDATE_D desc"} if partition.total > 1 else {}
        for number in range(partition.number, partition.total, partition.of):
            cursor, at = "*", 0
            while at < self.limit:
                size = min(self.size, self.limit - at)
                answer = json.loads(self.get(slots, "/search", query=self.dated(*ranges[number]), format="json", pageSize=size, cursorMark=cursor, resultType="core", **order))
                found = answer.get("resultList", {}).get("result", [])
                for hit in found[:size]:
                    pmcid, pmid, title, abstract, authors, day, journal, doi = europe_pmc.EuropePmc._hit(hit)
                    names = [tuple(a.get(k) for k in ("fullName", "firstName", "lastName", "initials")) for a in authors]
                    yield number * SLICE + at, pmcid, pmid, title, abstract, names, day, journal, doi
                    at += 1
                following = answer.get("nextCursorMark")
                if not found or not following or following == cursor:
                    break
                cursor = following


class ArxivReader(Reader):
    def full_query(self) -> str:
        query = self.query
        if self.start or self.end:
            day = lambda d, default: (d or default).replace("-", "")
            query = f"({query}) AND submittedDate:[{day(self.start, '1900-01-01')}0000 TO {day(self.end, '3000-12-31')}2359]"
        if self.categories:
            query = f"({query}) AND ({' OR '.join(f'cat:{c}' for c in sorted(self.categories))})"
        return query

    def page(self, slots: Slots, start: int, size: int) -> bytes:
        return self.get(slots, "", search_query=self.full_query(), start=start, max_results=size, sortBy="relevance", sortOrder="descending")

    def partitions(self):
        if self.categories is not None and not self.categories:
            return [Share(0, 1, 0)]
        total = min(self.limit, arxiv.total(self.page(self.probe(), 0, 1)))
        pages = -(-total // self.size)
        readers = max(1, min(self.readers, pages))
        return [Share(i, readers, total) for i in range(readers)]

    def read(self, partition: Share):
        slots = Slots(self.spacing, partition.number, partition.of)
        for start in range(partition.number * self.size, partition.total, partition.of * self.size):
            size = min(self.size, partition.total - start)
            for i, (paper, title, abstract, authors, day, categories) in enumerate(arxiv.entries(self.page(slots, start, size))[:size]):
                yield start + i, paper, title, abstract, authors, day, categories, categories[0] if categories else None


class EuropePmcHits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "europe_pmc"

    def schema(self) -> str:
        return f"position long, {europe_pmc.HITS}"

    def reader(self, schema) -> DataSourceReader:
        return EuropePmcReader(dict(self.options), europe_pmc.EuropePmc.base_url, europe_pmc.EuropePmc.most, europe_pmc.EuropePmc.spacing)


class ArxivHits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arxiv"

    def schema(self) -> str:
        return f"position long, {arxiv.HITS}, category string"

    def reader(self, schema) -> DataSourceReader:
        return ArxivReader(dict(self.options), arxiv.Arxiv.base_url, arxiv.Arxiv.most, arxiv.Arxiv.spacing)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filter pushdown."""
    for source in (EuropePmcHits, ArxivHits):
        spark.dataSource.register(source)
    spark.conf.set(PUSHDOWN, "true")


def hits(spark: SparkSession, source: str, query: str, limit: int | None = None, **options) -> DataFrame:
    """The source's hits as a table with ``position``; with a limit, the first so many in the source's order."""
    register(spark)
    options |= {"query": query} | ({"limit": limit} if limit is not None else {})
    rows = spark.read.format(source).options(**options).load()
    return rows if limit is None else rows.orderBy("position").limit(limit)
