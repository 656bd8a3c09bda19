"""Europe PMC through its REST search."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..errors import SourceError
from .registry import Source, register

AUTHOR = "struct<fullName: string, firstName: string, lastName: string, initials: string>"
HITS = f"pmcid string, pmid string, title string, abstract string, authors array<{AUTHOR}>, publication_date string, journal string, doi string"


def dated(query: str, start: str | None, end: str | None) -> str:
    """The query within a range of first publication dates; either end may be open."""
    if not start and not end:
        return query
    return f"({query}) AND (FIRST_PDATE:[{start or '0001-01-01'} TO {end or '3000-12-31'}])"


def pmcids(numbers: list[str], base_url: str | None = None, fetch=None) -> dict[str, str]:
    """The PMC ids of PubMed ids, by one request; ids without one are left out."""
    query = f"SRC:MED AND EXT_ID:({' OR '.join(numbers)})"
    source = EuropePmc(None, fetch)
    source.base_url = base_url or source.base_url
    return {str(r["pmid"]): r["pmcid"] for r in source._results(query, len(numbers)) if r.get("pmid") and r.get("pmcid")}


class EuropePmc(Source):
    name = "Europe PMC"
    base_url = "https://www.ebi.ac.uk/europepmc/webservices/rest"
    description = "Literature of the life sciences"
    formats = ["xml", "pdf"]
    most = 1000
    documentation = "https://europepmc.org/Help"

    def _results(self, query: str, size: int) -> list[dict]:
        answer = json.loads(self.fetch(self.url("/search", query=query, format="json", pageSize=min(size, self.most), resultType="core")))
        return answer.get("resultList", {}).get("result", [])

    @staticmethod
    def _hit(r: dict) -> tuple:
        authors = [{k: a.get(k) for k in ("fullName", "firstName", "lastName", "initials")} for a in r.get("authorList", {}).get("author", [])]
        return r.get("pmcid", ""), r.get("pmid", ""), r.get("title", ""), r.get("abstractText", ""), authors, r.get("firstPublicationDate", ""), r.get("journalTitle", ""), r.get("doi", "")

    def search(self, query: str, limit: int = 100, start_date: str | None = None, end_date: str | None = None, **options) -> DataFrame:
        rows = self._results(dated(query, start_date, end_date), limit)[:limit]
        return self.spark.createDataFrame([self._hit(r) for r in rows], HITS)

    def paper(self, paper_id: str) -> dict:
        found = self._results(f"EXT_ID:{paper_id}", 1)
        if not found:
            raise SourceError(f"{self.name} has no paper {paper_id}")
        return dict(zip([c.split()[0] for c in ("pmcid", "pmid", "title", "abstract", "authors", "publication_date", "journal", "doi")], self._hit(found[0]), strict=True))

    def download_urls(self, paper_id: str, formats: list[str]) -> dict[str, str]:
        number = paper_id.removeprefix("PMC")
        if paper_id.startswith("PPR"):
            raise SourceError(f"{self.name} has no full text of preprint {paper_id}")
        if not paper_id.startswith("PMC"):
            number = (self.paper(paper_id)["pmcid"] or "").removeprefix("PMC")
            if not number:
                raise SourceError(f"{self.name} has no full text of {paper_id}")
        urls = {"xml": f"{self.base_url}/PMC{number}/fullTextXML", "pdf": f"https://europepmc.org/articles/PMC{number}?pdf=render"}
        return {f: urls[f] for f in formats}


register("europe_pmc", EuropePmc)
