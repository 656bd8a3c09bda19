"""Lexicon profiles and the additive relevance score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import filled, first_filled, has_text, matching_terms


@dataclass(frozen=True)
class Profile:
    """Terms that count anywhere, and those that count in the title (with what it may start with)."""

    location: list[str]
    pollutant: list[str]
    health: list[str]
    title_strong: list[str] = field(default_factory=list)
    title_start: list[str] = field(default_factory=list)
    title_weak: list[str] = field(default_factory=list)


#: The lexicon of the default profile.
AIR_QUALITY = Profile(
    location=["india", "indian", "delhi", "mumbai", "kolkata", "chennai", "bengaluru", "bangalore", "hyderabad", "ahmedabad", "lucknow", "kanpur", "patna", "pune", "jaipur", "uttar pradesh", "maharashtra", "west bengal", "tamil nadu", "karnataka"],
    pollutant=["aqi", "air quality index", "pm2.5", "pm10", "pm 2.5", "pm 10", "particulate matter", "ambient air pollution", "air pollution", "no2", "so2", "o3", "ozone", "carbon monoxide"],
    health=["exposure", "mortality", "morbidity", "respiratory", "cardiovascular", "health", "epidemiology", "public health"],
    title_strong=["air quality index", " aqi"],
    title_start=["aqi"],
    title_weak=["air pollution", "pm2.5", "pm10", "particulate"],
)


def _has_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def blob() -> Column:
    """Title, abstract, journal and authors as one lower-case text."""
    empty = F.lit("")
    parts = [F.coalesce(F.col("title"), empty), F.coalesce(F.col("abstract"), empty), F.coalesce(F.col("journal"), empty), F.coalesce(F.array_join("authors", " "), empty)]
    return F.lower(F.concat_ws(" ", *parts))


def with_abstract(papers: DataFrame) -> DataFrame:
    """Where a paper has no abstract, that of a column ``abstracttext`` if there is one."""
    return papers.withColumn("abstract", first_filled(F.col("abstract"), F.col("abstracttext"))) if "abstracttext" in papers.columns else papers


def with_terms(papers: DataFrame, profile: Profile = AIR_QUALITY) -> DataFrame:
    """Adds location_list, pollutant_list and health_list; the blob is made once."""
    rows = with_abstract(papers).withColumn("_blob", blob())
    lists = {f"{k}_list": matching_terms(F.col("_blob"), getattr(profile, k)) for k in ("location", "pollutant", "health")}
    return rows.withColumns(lists).drop("_blob")


def score(profile: Profile = AIR_QUALITY) -> Column:
    """Points of a paper that has the term lists, has_xml and has_pdf."""
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    starts = F.lit(False)
    for t in profile.title_start:
        starts = starts | title.startswith(t)
    some = lambda name: F.size(name) > 0
    xml, pdf = (F.coalesce(F.col(c), F.lit(False)) for c in ("has_xml", "has_pdf"))
    points = F.when(_has_any(title, profile.title_strong) | starts, 3).when(_has_any(title, profile.title_weak), 2).otherwise(0)
    points = points + F.when(some("location_list"), 2).otherwise(-3)
    for rule, worth in ((some("pollutant_list"), 2), (some("health_list"), 1), (xml, 1), (pdf, 1), (filled(F.col("doi")) & filled(F.col("journal")), 1)):
        points = points + F.when(rule, worth).otherwise(0)
    return (points + F.when(~xml & ~pdf & ~has_text(F.col("abstract")), -2).otherwise(0)).cast("int")


def scored(papers: DataFrame, profile: Profile = AIR_QUALITY) -> DataFrame:
    return with_terms(papers, profile).withColumn("score", score(profile))
