"""Whole workflows in one call: query and review, a pilot run of a configuration, ingest and review, reviewed export."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..shared import written
from ..sources.registry import Source, source
from . import export, files, ingest, review, runs
from .corpus import Corpus

REPOSITORY = "europe_pmc"
LIMIT = 25
FORMATS = ("xml",)


def search_and_download(origin: Source, query: str, limit: int, folder: str, formats: list[str]) -> tuple[list[dict], list[str], dict[str, str]]:
    """(hits, ids that were downloaded, why others were not); a hit that fails does not stop the rest."""
    os.makedirs(folder, exist_ok=True)
    hits = [r.asDict(recursive=True) for r in origin.search(query, limit).collect()]
    done, failed = [], {}
    for hit in hits:
        paper = hit.get("pmcid") or hit.get("arxiv_id") or hit.get("pmid")
        if not paper:
            continue
        try:
            if origin.download(paper, folder, formats)["success"]:
                done.append(paper)
        except Exception as e:  # whatever a source answers, the other hits go on
            failed[paper] = str(e) or type(e).__name__
    return hits, done, failed


def _harvest(spark: SparkSession, query_name: str, query_string: str, folder: str, repository: str, limit: int, formats, fetch, notes: str = "", revision_of: str | None = None) -> tuple[dict, str, str]:
    """Search and download into ``folder``: the run's record, and where it and the hits were saved."""
    formats = list(formats or FORMATS)
    hits, done, _ = search_and_download(source(repository, spark, fetch), query_string, limit, folder, formats)
    results = os.path.join(folder, "search_results.json")
    with open(results, "w", encoding="utf-8") as out:
        json.dump(hits, out, indent=2, ensure_ascii=False)
    run = runs.record(query_name, query_string, repository, limit, formats, folder, len(hits), len(done), notes, revision_of)
    return run, results, runs.save(spark, run, folder)


def _line(run: dict) -> str:
    return f"Query '{run['query_name']}': {run['result_count']} results, {run['downloaded_count']} downloaded -> {run['output_dir']}"


def _downloaded(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, kind, length) of full texts in a folder, by the ids that hits get."""
    stem = F.regexp_replace("paper_id", r"\.tar$", "")  # sources come as .tar.gz
    return files.paper_files(files.listing(spark, folder, recursive=False)).select(F.concat(F.lit("europe_pmc_"), stem).alias("paper_id"), "kind", "length")


def run_query_and_review(spark: SparkSession, query_name: str, query_string: str, folder: str, repository: str = REPOSITORY, limit: int = LIMIT, formats=FORMATS, notes: str = "", revision_of: str | None = None, fetch=None) -> dict:
    """Search, download, record the run and export the review table under ``folder``; counts, paths and the table."""
    run, results, saved = _harvest(spark, query_name, query_string, folder, repository, limit, formats, fetch, notes, revision_of)
    found = ingest.search_results(spark, results, arxiv_ids=True).withColumn("paper_id", F.replace("paper_id", F.lit("/"), F.lit("_")))
    table, _ = written(review.rows(review.with_files(found, _downloaded(spark, folder), sized=False), query_name, query_string), "review")
    paths = review.export(table, os.path.join(folder, "review"))
    counts = review.summary(table).first().asDict()
    about = {k: run[k] for k in ("query_name", "query_string", "result_count", "downloaded_count", "output_dir")}
    return about | counts | {"search_results_path": results, "query_run_path": saved, "review_paths": paths, "table": table, "query_run": run, "summary": _line(run)}


def pilot(spark: SparkSession, config_path: str, root: str, fetch=None) -> dict:
    """The query of a YAML configuration, harvested under ``root``/queries; the run's record with its summary."""
    config = runs.config(config_path)
    for name in ("query_name", "query_string"):
        if not config.get(name):
            raise CorpusError(f"{config_path} has no {name}")
    folder = os.path.join(root, "queries", config.get("output_subdir") or config["query_name"])
    run, results, _ = _harvest(spark, config["query_name"], config["query_string"], folder, config.get("repository") or REPOSITORY, int(config.get("limit") or LIMIT), config.get("formats"), fetch)
    return run | {"summary": _line(run), "search_results_path": results}


def tables_of(corpus_dir: str) -> str:
    """Where a bagged corpus keeps its papers' table: beside the payload, whose manifests list what was harvested."""
    return f"{corpus_dir.rstrip('/')}/papers"


def ingest_and_review(spark: SparkSession, directory: str, corpus_dir: str, query_run: str | None = None) -> dict[str, str]:
    """Record folders and their full texts into a bagged corpus, and its review table; each format's path."""
    bag = files.Bag(spark, corpus_dir).create()
    corpus = Corpus(spark, tables_of(corpus_dir))
    added = ingest.ingest_folders(spark, directory, corpus, bag=bag)
    if added:
        new = spark.createDataFrame([(i,) for i in added], "paper_id string").distinct()
        files.write_metadata(corpus.papers().join(new, "paper_id"), corpus_dir)
        bag.update()
    name, text = runs.context(spark, query_run)
    table = review.rows(review.with_files(corpus.papers(), bag.full_texts()), name, text)
    return review.export(table, os.path.join(corpus_dir, "analysis", "review"))


def export_reviewed(spark: SparkSession, corpus_dir: str, folder: str, review_path: str | None = None) -> str:
    """The export manifest of the papers that a review table includes; of all papers where there is no such file."""
    table = review.read_json(spark, review_path) if review_path and os.path.isfile(review_path) else None
    papers = review.with_files(Corpus(spark, tables_of(corpus_dir)).papers(), files.Bag(spark, corpus_dir).full_texts())
    return export.write(papers, corpus_dir, folder, table)
