"""Export of reviewed papers for a retrieval system."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.metadata import citation

#: Fixed values of the manifest's format.
VERSION = "1.0"
NAME = "chatbot_manifest.json"
HINT = {"primary_text_source": "xml_path", "fallback_text_source": "abstract", "metadata_fields_for_retrieval": ["title", "abstract", "doi", "pmcid", "citation_label"]}
RECORD = ["source_id", "citation_label", "title", "abstract", "doi", "pmcid", "pmid", "publication_date", "journal", "authors", "xml_path", "pdf_path", "metadata_path"]


def records(papers: DataFrame, corpus_dir: str) -> DataFrame:
    """A 13-field record for each paper that has has_xml and has_pdf."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    path = lambda kind: F.when(F.col(f"has_{kind}"), F.concat(F.lit(f"{corpus_dir}/data/documents/{kind}/"), "paper_id", F.lit(f".{kind}"))).otherwise("")
    made = {
        "source_id": F.col("paper_id"),
        "citation_label": citation(F.col("title"), F.col("authors"), F.col("publication_date")),
        "authors": F.coalesce("authors", F.array().cast("array<string>")),
        "xml_path": path("xml"),
        "pdf_path": path("pdf"),
        "metadata_path": F.concat(F.lit(f"{corpus_dir}/data/metadata/"), "paper_id", F.lit("_metadata.json")),
    }
    return papers.select(*(made.get(c, text(c) if c not in made else None).alias(c) for c in RECORD))


def included(papers: DataFrame, review: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Papers to export: those a review includes, else those of ``ids``, else all. No included row means no paper."""
    if review is not None:
        ids = review.where(F.col("review_status") == "include").select("paper_id")
    return papers if ids is None else papers.join(ids.select("paper_id"), "paper_id", "inner")


def missing(papers: DataFrame, review: DataFrame) -> DataFrame:
    """Included papers that the corpus lacks."""
    return review.where(F.col("review_status") == "include").join(papers, "paper_id", "left_anti").select("paper_id")


def write(papers: DataFrame, corpus_dir: str, folder: str, review: DataFrame | None = None, ids: DataFrame | None = None) -> str:
    """The manifest as one JSON file, its records streamed to it; raises if an included paper is unknown."""
    if review is not None and not (lost := missing(papers, review)).isEmpty():
        raise CorpusError(f"no paper {lost.first().paper_id}")
    os.makedirs(folder, exist_ok=True)
    path, count = os.path.join(folder, NAME), 0
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'{{"export_version": {json.dumps(VERSION)}, "corpus_dir": {json.dumps(corpus_dir)}, "papers": [')
        for row in records(included(papers, review, ids), corpus_dir).toLocalIterator():
            out.write(("," if count else "") + "\n" + json.dumps(row.asDict(recursive=True), ensure_ascii=False))
            count += 1
        out.write(f'\n], "paper_count": {count}, "chunking_hint": {json.dumps(HINT)}}}\n')
    return path
