"""Saved harvests to papers: record folders and flat search results."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.metadata import flat_authors, paper_id, split_authors
from ..functions.text import blank_to_null, first_filled
from ..schema import PAPERS
from .corpus import Corpus
from .files import DOCUMENTS, Bag

RECORD = "title string, abstractText string, doi string, pmcid string, pmid string, authorString string, firstPublicationDate string, dateOfCreation string, pubYear string, journalInfo struct<journal: struct<title: string>>"
RECORD_FILE = "eupmc_result.json"
HIT = "pmcid string, pmid string, arxiv_id string, title string, abstract string, publication_date string, journal string, doi string, categories array<string>"


def _as_papers(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PAPERS))


def from_record(rows: DataFrame, prefix: str = "europe_pmc_", folder: str | None = None) -> DataFrame:
    """Papers of raw Europe PMC records."""
    ids = [F.col(folder)] if folder else [F.col("pmcid"), F.col("pmid")]
    made = rows.select(
        paper_id(prefix, *ids).alias("paper_id"),
        F.lit("europe_pmc").alias("source"),
        "pmcid",
        "pmid",
        "doi",
        "title",
        F.col("abstractText").alias("abstract"),
        split_authors(F.col("authorString")).alias("authors"),
        first_filled(F.col("firstPublicationDate"), F.col("dateOfCreation"), F.col("pubYear"), default="").alias("publication_date"),
        F.coalesce(F.col("journalInfo.journal.title"), F.lit("")).alias("journal"),
    )
    return _as_papers(made)


def folders(spark: SparkSession, directory: str) -> DataFrame:
    """Raw records of child folders PMC*, with the folder's name as ``folder``; none if the directory is missing."""
    if "://" not in directory and not os.path.isdir(directory):
        return spark.createDataFrame([], RECORD).withColumn("folder", F.lit(""))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", RECORD_FILE).load(directory)
    name = F.regexp_extract("path", r"/(PMC[^/]*)/[^/]+$", 1)
    texts = files.select(name.alias("folder"), F.decode("content", "UTF-8").alias("text")).where(F.col("folder") != "")
    parsed = texts.withColumn("record", F.from_json("text", RECORD, {"mode": "PERMISSIVE"}))
    broken = F.try_parse_json("text").isNull()
    return parsed.select(F.when(broken, F.raise_error(F.concat(F.lit("broken record in "), "folder"))).otherwise(F.col("folder")).alias("folder"), "record.*")


def copy_full_texts(directory: str, bag: Bag, prefix: str = "europe_pmc_") -> int:
    """Copy fulltext.xml and fulltext.pdf of every record folder to the bag's documents and hash the payload anew; how many."""
    count = 0
    for name in sorted(os.listdir(directory)):
        if not name.startswith("PMC") or not os.path.isfile(os.path.join(directory, name, RECORD_FILE)):
            continue
        for kind in ("xml", "pdf"):
            origin = os.path.join(directory, name, f"fulltext.{kind}")
            if os.path.isfile(origin):
                target = f"{bag.path}/{DOCUMENTS}/{kind}/{prefix}{name}.{kind}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                shutil.copy2(origin, target)
                count += 1
    bag.update()
    return count


def ingest_folders(spark: SparkSession, directory: str, corpus: Corpus, prefix: str = "europe_pmc_", bag: Bag | None = None) -> list[str]:
    """Add every folder's paper to the corpus, and its full texts to a bag; their ids. A broken record fails the whole ingest before it writes."""
    papers = from_record(folders(spark, directory), prefix, "folder")
    corpus.add(papers)
    if bag is not None and os.path.isdir(directory):
        copy_full_texts(directory, bag, prefix)
    return sorted(r.paper_id for r in papers.select("paper_id").toLocalIterator())


def search_results(spark: SparkSession, path: str, prefix: str = "europe_pmc_", arxiv_ids: bool = False) -> DataFrame:
    """Papers of a saved JSON array of hits; ``arxiv_ids``: those count as ids too."""
    if "://" not in path and not os.path.isfile(path):
        raise CorpusError(f"no search results {path}")
    whole = spark.read.text(path, wholetext=True)
    if whole.where(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))).isEmpty():
        raise CorpusError(f"{path} is no list of hits")
    texts = whole.select(F.explode(F.from_json("value", "array<string>")).alias("hit"))
    hits = texts.select(F.from_json("hit", HIT).alias("h"), F.get_json_object("hit", "$.authors").alias("a"))
    ids = [F.col("h.pmcid"), F.col("h.arxiv_id"), F.col("h.pmid")] if arxiv_ids else [F.col("h.pmcid"), F.col("h.pmid")]
    authors = F.from_json("a", "array<string>")
    single = F.when(F.col("a").isNotNull() & authors.isNull() & blank_to_null(F.col("a")).isNotNull(), F.array("a"))
    return _as_papers(hits.select(paper_id(prefix, *ids).alias("paper_id"), F.col("h.*"), flat_authors(F.coalesce(authors, single)).alias("authors")))


def stream_folders(spark: SparkSession, directory: str, corpus: Corpus, checkpoint: str, prefix: str = "europe_pmc_"):
    """A streaming query that adds the papers of record files as they appear; each is read once."""
    stream = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", RECORD_FILE).load(directory)
    rows = stream.select(F.regexp_extract("path", r"/(PMC[^/]*)/[^/]+$", 1).alias("folder"), F.from_json(F.decode("content", "UTF-8"), RECORD).alias("record")).where("folder <> '' and record is not null").select("folder", "record.*")
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: corpus.add(from_record(batch, prefix, "folder"))).start()
