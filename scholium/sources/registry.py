"""Sources by name. A source searches, describes a paper, downloads, and tells what it is."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError


class Source(ABC):
    """Base of the sources; ``fetch`` gets a URL's bytes and can be replaced, as tests do."""

    name = ""
    base_url = ""
    description = ""
    formats: list[str] = []
    most = 0
    documentation = ""
    spacing = 0.0

    def __init__(self, spark: SparkSession, fetch=None):
        self.spark, self._fetch, self._last = spark, fetch, 0.0

    def fetch(self, url: str, paced: bool = True) -> bytes:
        if paced and self.spacing:
            wait = self._last + self.spacing - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            self._last = time.monotonic()
        try:
            if self._fetch:
                return self._fetch(url)
            with urllib.request.urlopen(url, timeout=60) as answer:
                return answer.read()
        except OSError as e:
            raise SourceError(f"{self.name}: {e}") from e

    def url(self, path: str, **params) -> str:
        return f"{self.base_url}{path}?{urllib.parse.urlencode(params)}"

    @abstractmethod
    def search(self, query: str, limit: int = 100, start_date: str | None = None, end_date: str | None = None, **options) -> DataFrame: ...

    @abstractmethod
    def paper(self, paper_id: str) -> dict: ...

    @abstractmethod
    def download_urls(self, paper_id: str, formats: list[str]) -> dict[str, str]: ...

    def download(self, paper_id: str, folder: str, formats: list[str] | None = None) -> dict:
        """Files of a paper in ``folder``; a format the source lacks is an error."""
        import os

        formats = formats or self.formats[:1]
        unknown = [f for f in formats if f not in self.formats]
        if unknown:
            raise SourceError(f"{self.name} has no {', '.join(unknown)}")
        os.makedirs(folder, exist_ok=True)
        files = {}
        for kind, url in self.download_urls(paper_id, formats).items():
            files[kind] = os.path.join(folder, f"{paper_id.replace('/', '_')}.{'tar.gz' if kind == 'source' else kind}")
            with open(files[kind], "wb") as out:
                out.write(self.fetch(url, paced=False))
        return {"success": bool(files), "paper_id": paper_id, "files": files}

    @classmethod
    def info(cls) -> dict:
        return {"name": cls.name, "base_url": cls.base_url, "description": cls.description, "supported_formats": cls.formats, "max_results_per_query": cls.most, "api_documentation": cls.documentation}


_SOURCES: dict[str, type[Source]] = {}


def register(name: str, source: type[Source]) -> None:
    _SOURCES[name] = source


def names() -> list[str]:
    return sorted(_SOURCES)


def source(name: str, spark: SparkSession, fetch=None) -> Source:
    if name not in _SOURCES:
        raise SourceError(f"unknown source {name}; there are {', '.join(names())}")
    return _SOURCES[name](spark, fetch)


def catalog(spark: SparkSession) -> DataFrame:
    """One row a source."""
    rows = [tuple(_SOURCES[n].info().values()) for n in names()]
    return spark.createDataFrame(rows, "name string, base_url string, description string, supported_formats array<string>, max_results_per_query int, api_documentation string").orderBy(F.col("name"))
