"""arXiv through its Atom feed, at most one request in three seconds."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame

from ..errors import SourceError
from .registry import Source, register

HITS = "arxiv_id string, title string, abstract string, authors array<struct<name: string>>, publication_date string, categories array<string>"
_ATOM, _OWN = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"
_COUNT = "{http://a9.com/-/spec/opensearch/1.1/}totalResults"


def total(feed: bytes) -> int:
    """How many hits the query has in all, as a feed says."""
    try:
        return int(ET.fromstring(feed).findtext(_COUNT) or 0)
    except (ET.ParseError, ValueError) as e:
        raise SourceError(f"arXiv: broken feed: {e}") from e


def entries(feed: bytes) -> list[tuple]:
    """Hits of a feed."""
    try:
        root = ET.fromstring(feed)
    except ET.ParseError as e:
        raise SourceError(f"arXiv: broken feed: {e}") from e
    text = lambda e, name: e.findtext(f"{_ATOM}{name}", "")
    return [
        (text(e, "id").rsplit("/", 1)[-1], text(e, "title"), text(e, "summary"), [(text(a, "name"),) for a in e.findall(f"{_ATOM}author")], text(e, "published"), [c.get("term") for c in e.findall(f"{_OWN}primary_category")])
        for e in root.findall(f"{_ATOM}entry")
    ]


class Arxiv(Source):
    name = "arXiv"
    base_url = "http://export.arxiv.org/api/query"
    description = "Preprints in physics, mathematics and computer science"
    formats = ["pdf", "source"]
    most = 2000
    documentation = "https://arxiv.org/help/api"
    spacing = 3.0

    def _search(self, query: str, limit: int) -> list[tuple]:
        return entries(self.fetch(self.url("", search_query=query, start=0, max_results=min(limit, self.most), sortBy="relevance", sortOrder="descending")))

    def search(self, query: str, limit: int = 100, start_date: str | None = None, end_date: str | None = None, categories: list[str] | None = None, **options) -> DataFrame:
        if start_date or end_date:
            day = lambda d, default: (d or default).replace("-", "")
            query = f"({query}) AND submittedDate:[{day(start_date, '1900-01-01')}0000 TO {day(end_date, '3000-12-31')}2359]"
        found = []
        if categories:
            found = self._search(f"({query}) AND ({' OR '.join(f'cat:{c}' for c in categories)})", limit)
        return self.spark.createDataFrame((found or self._search(query, limit))[:limit], HITS)

    def paper(self, paper_id: str) -> dict:
        found = entries(self.fetch(self.url("", id_list=paper_id, max_results=1)))
        if not found:
            raise SourceError(f"arXiv has no paper {paper_id}")
        return dict(zip(("arxiv_id", "title", "abstract", "authors", "publication_date", "categories"), found[0], strict=True))

    def download_urls(self, paper_id: str, formats: list[str]) -> dict[str, str]:
        urls = {"pdf": f"https://arxiv.org/pdf/{paper_id}.pdf", "source": f"https://arxiv.org/e-print/{paper_id}"}
        return {f: urls[f] for f in formats}


register("arxiv", Arxiv)
