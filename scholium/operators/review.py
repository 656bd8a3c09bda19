"""The review table: build, validate, filter, rank, export."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.metadata import joined_authors
from ..functions.scoring import AIR_QUALITY, Profile, scored
from ..functions.text import first_filled, snippet
from ..schema import DEFAULT_STATUS, REVIEW, REVIEW_COLUMNS, STATUSES

HIGH_SCORE = 5


def with_files(papers: DataFrame, files: DataFrame, sized: bool = True) -> DataFrame:
    """Adds has_xml and has_pdf from a table of files; ``sized``: an empty file does not count."""
    there = F.col("length") > 0 if sized else F.lit(True)
    kinds = files.groupBy("paper_id").agg(*(F.coalesce(F.max((F.col("kind") == k) & there), F.lit(False)).alias(f"has_{k}") for k in ("xml", "pdf")))
    no = F.lit(False)
    return papers.join(kinds, "paper_id", "left").withColumns({c: F.coalesce(c, no) for c in ("has_xml", "has_pdf")})


def rows(papers: DataFrame, query_name: str = "", query_string: str = "", profile: Profile = AIR_QUALITY, status: Column | None = None, notes: Column | None = None) -> DataFrame:
    """A review row for each paper that has has_xml and has_pdf."""
    empty = F.lit("")
    text = lambda c: F.coalesce(F.col(c), empty)
    made = {
        "review_status": F.lit(DEFAULT_STATUS) if status is None else status,
        "score": F.col("score"),
        "paper_id": F.col("paper_id"),
        "authors": joined_authors(F.col("authors")),
        "has_xml": F.col("has_xml"),
        "has_pdf": F.col("has_pdf"),
        "query_name": F.lit(query_name),
        "query_string": F.lit(query_string),
        "abstract_snippet": snippet(first_filled(F.col("abstract"), default="")),
        "review_notes": empty if notes is None else notes,
    }
    made |= {f"{k}_terms": F.array_join(f"{k}_list", ", ") for k in ("location", "pollutant", "health")}
    return scored(papers, profile).select(*(made.get(c, text(c) if c not in made else None).alias(c) for c in REVIEW_COLUMNS))


def ranked(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("score"), F.asc("paper_id"))


def validated(table: DataFrame) -> DataFrame:
    """The table, whose reading fails at a row with an unknown status; missing columns fail at once."""
    missing = [c for c in REVIEW_COLUMNS if c not in table.columns]
    if missing:
        raise CorpusError(f"review table lacks {', '.join(missing)}")
    known = F.coalesce(F.col("review_status").isin(*STATUSES), F.lit(False))
    return table.withColumn("review_status", F.when(known, F.col("review_status")).otherwise(F.raise_error(F.concat(F.lit("unknown review_status: "), F.coalesce("review_status", F.lit("null"))))))


def of_status(table: DataFrame, status: str) -> DataFrame:
    return table.where(F.col("review_status") == status)


def high(table: DataFrame, least: int = HIGH_SCORE, with_xml: bool = False) -> DataFrame:
    out = table.where(F.col("score") >= least)
    return out.where("has_xml") if with_xml else out


def to_pandas(table: DataFrame):
    """The table, best papers first, as a pandas frame on the driver: for tables that people review."""
    return ranked(table).toPandas()


def with_term(table: DataFrame, pattern: str) -> DataFrame:
    """Rows whose title or snippet matches a pattern in any case."""
    return table.where(F.coalesce(F.col("title").rlike(f"(?i){pattern}"), F.lit(False)) | F.coalesce(F.col("abstract_snippet").rlike(f"(?i){pattern}"), F.lit(False)))


def summary(table: DataFrame) -> DataFrame:
    """Counters of a review table."""
    counts = {"row_count": F.count("*"), "high_score_count": F.count_if(F.col("score") >= HIGH_SCORE), "xml_count": F.count_if("has_xml"), "high_with_xml": F.count_if((F.col("score") >= HIGH_SCORE) & F.col("has_xml"))}
    return table.agg(*(v.alias(k) for k, v in counts.items()))


def markdown_line() -> Column:
    title = F.substring(F.replace(F.coalesce("title", F.lit("")), F.lit("|"), F.lit("\\|")), 1, 80)
    return F.concat(F.lit("| "), F.concat_ws(" | ", F.col("review_status"), F.col("score").cast("string"), title, F.col("pmcid"), F.initcap(F.col("has_xml").cast("string"))), F.lit(" |"))


def write_json(table: DataFrame, path: str) -> str:
    """One JSON array, streamed row by row to the driver."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(ranked(table).toLocalIterator()):
            out.write(("," if i else "") + "\n" + json.dumps(row.asDict(), indent=2, ensure_ascii=False))
        out.write("\n]\n")
    return path


def write_csv(table: DataFrame, path: str) -> str:
    with open(path, "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(REVIEW_COLUMNS)
        writer.writerows(tuple(r) for r in ranked(table).select(*REVIEW_COLUMNS).toLocalIterator())
    return path


def write_markdown(table: DataFrame, path: str) -> str:
    with open(path, "w", encoding="utf-8") as out:
        out.write("# Corpus review table\n\n| review_status | score | title | pmcid | has_xml |\n| --- | ---: | --- | --- | --- |\n")
        out.writelines(r[0] + "\n" for r in ranked(table).select(markdown_line()).toLocalIterator())
    return path


def export(table: DataFrame, folder: str, name: str = "review_table") -> dict[str, str]:
    """The table as JSON, CSV and Markdown; each format's path."""
    os.makedirs(folder, exist_ok=True)
    base = os.path.join(folder, name)
    return {"json": write_json(table, f"{base}.json"), "csv": write_csv(table, f"{base}.csv"), "markdown": write_markdown(table, f"{base}.md")}


def read_json(spark, path: str) -> DataFrame:
    """An exported (and perhaps edited) review table."""
    return validated(spark.read.schema(REVIEW).option("multiLine", True).json(path))
