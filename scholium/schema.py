"""Table schemas of a corpus."""

from pyspark.sql import types as T

_S = T.StringType()


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


#: ``extra`` has every key that has no column.
PAPERS = T.StructType(
    [T.StructField("paper_id", _S, False), *_fields("source", "pmcid", "pmid", "arxiv_id", "doi", "title", "abstract")]
    + [T.StructField("authors", T.ArrayType(_S)), *_fields("publication_date", "journal"), T.StructField("categories", T.ArrayType(_S)), T.StructField("extra", T.VariantType())]
)
FILES = T.StructType([*_fields("paper_id", "kind", "path"), T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType())])
#: Fixed order of the review table's columns.
REVIEW_COLUMNS = [
    "review_status",
    "score",
    "paper_id",
    "pmcid",
    "pmid",
    "doi",
    "title",
    "publication_date",
    "journal",
    "authors",
    "has_xml",
    "has_pdf",
    "query_name",
    "query_string",
    "location_terms",
    "pollutant_terms",
    "health_terms",
    "abstract_snippet",
    "review_notes",
]
_REVIEW_TYPES = {"score": T.IntegerType(), "has_xml": T.BooleanType(), "has_pdf": T.BooleanType()}
REVIEW = T.StructType([T.StructField(c, _REVIEW_TYPES.get(c, _S)) for c in REVIEW_COLUMNS])
STATUSES = ("include", "review", "exclude")
DEFAULT_STATUS = "review"
QUERY_RUNS = T.StructType(
    [*_fields("query_name", "query_string", "repository"), T.StructField("limit", T.IntegerType()), T.StructField("formats", T.ArrayType(_S)), *_fields("output_dir")]
    + [T.StructField("result_count", T.IntegerType()), T.StructField("downloaded_count", T.IntegerType()), T.StructField("run_timestamp", T.TimestampType()), *_fields("notes", "revision_of")]
)
AUTHOR = T.StructType([*_fields("fullName", "firstName", "lastName", "name")])
#: A saved search hit; authors stay JSON text because their items may be names or records.
HIT = T.StructType(_fields("pmcid", "pmid", "arxiv_id", "title", "abstract", "publication_date", "journal", "doi"))
