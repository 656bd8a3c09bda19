"""Checks and mappings of paper metadata as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, filled, first_filled, has_text, strip

#: Field names of sources and the standard names they stand for.
ALIASES = {
    "Title": "title",
    "title": "title",
    "Abstract": "abstract",
    "abstract": "abstract",
    "AbstractText": "abstract",
    "DOI": "doi",
    "doi": "doi",
    "Authors": "authors",
    "authors": "authors",
    "AuthorList": "authors",
    "Publication_Date": "publication_date",
    "publication_date": "publication_date",
    "firstPublicationDate": "publication_date",
    "Journal": "journal",
    "journal": "journal",
    "journalTitle": "journal",
}
REQUIRED = ["title", "abstract", "doi", "authors", "publication_date"]


def normalised(raw: Column) -> Column:
    """A map with standard field names; others are lower-cased, and of equal names the last wins."""
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    entries = F.transform(F.map_entries(raw), lambda e: F.struct(F.coalesce(F.try_element_at(names, e["key"]), F.lower(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def doi_valid(doi: Column) -> Column:
    return F.coalesce(strip(doi).rlike(r"^10\.[0-9]{4,}/\S+$"), F.lit(False))


def date_valid(date: Column) -> Column:
    text = strip(date)
    shaped = text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & ~text.startswith("0000-")
    return F.coalesce(shaped & F.try_to_date(F.when(shaped, text), "y-M-d").isNotNull(), F.lit(False))


def title_valid(title: Column) -> Column:
    return F.coalesce(F.length(strip(title)).between(10, 500), F.lit(False))


def abstract_valid(abstract: Column) -> Column:
    return F.coalesce(F.length(strip(abstract)) >= 50, F.lit(False))


def authors_valid(authors: Column) -> Column:
    return F.coalesce((F.size(authors) > 0) & F.forall(authors, lambda a: filled(strip(a))), F.lit(False))


def present(column: Column, of_list: bool = False) -> Column:
    """Present and not blank."""
    return F.coalesce(F.size(column) > 0, F.lit(False)) if of_list else has_text(column)


def required_present() -> Column:
    out = F.lit(True)
    for name in REQUIRED:
        out = out & present(F.col(name), name == "authors")
    return out


def complete() -> Column:
    """The looser check, which white space passes."""
    out = F.lit(True)
    for name in REQUIRED:
        out = out & (present(F.col(name), True) if name == "authors" else filled(F.col(name)))
    return out


def report() -> dict[str, Column]:
    """Five columns of presence and five of validity; the latter are null where the field is absent."""
    checks = {"doi": doi_valid, "publication_date": date_valid, "authors": authors_valid, "title": title_valid, "abstract": abstract_valid}
    out = {f"{n}_present": present(F.col(n), n == "authors") for n in REQUIRED}
    return out | {f"{n}_valid": F.when(F.col(n).isNotNull(), check(F.col(n))) for n, check in checks.items()}


def split_authors(text: Column) -> Column:
    """Names of a comma-separated string, without final dots; blank parts go before the dots do."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda a: filled(strip(a)))
    return F.transform(parts, lambda a: strip(F.regexp_replace(strip(a), r"\.+$", "")))


def flat_authors(authors: Column) -> Column:
    """Names of an array of JSON texts, each a name or a record with fullName, lastName, firstName or name."""

    def name(item: Column) -> Column:
        value = F.try_parse_json(item)
        of = lambda field: blank_to_null(F.try_variant_get(value, f"$.{field}", "string"))
        record = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        return F.when(record, F.coalesce(of("fullName"), of("lastName"), of("firstName"), of("name"))).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), item))

    return F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), name), filled)


def joined_authors(authors: Column) -> Column:
    return F.array_join(F.coalesce(authors, F.array().cast("array<string>")), "; ")


def paper_id(prefix: str, *ids: Column) -> Column:
    return F.concat(F.lit(prefix), first_filled(*ids, default="unknown"))


def citation(title: Column, authors: Column, date: Column) -> Column:
    lead = F.coalesce(F.get(authors, F.lit(0)), F.lit("Unknown"))
    lead = F.when(F.contains(lead, F.lit(",")), strip(F.get(F.split(lead, ","), F.lit(0)))).otherwise(lead)
    year = first_filled(F.substring(date, 1, 4), default="n.d.")
    return F.concat(lead, F.lit(" ("), year, F.lit("). "), first_filled(title, default="Untitled"))


def run_summary() -> Column:
    return F.format_string("Query '%s': %d results, %d downloaded -> %s", F.col("query_name"), F.col("result_count"), F.coalesce(F.col("downloaded_count"), F.lit(0)), F.col("output_dir"))
