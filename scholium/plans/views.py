"""Papers, files, reviews and runs made of the driver's test tables.

Dates, DOIs and authors are integer formulas on doc_id with deliberate invalid
cases, so that every check has both outcomes. ``SQL`` has the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import split_authors
from ..functions.scoring import Profile

#: Short stems that hit some but not all of the test prose.
PROFILE = Profile(location=["than", "ment", "keit", "ción", "heor"], pollutant=["ther ", "eaux", "lich", "arra", "ingre"], health=["worth", "edst", "onre", "vi"], title_strong=["ea", " die"], title_start=["th"], title_weak=["on", "en"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    padded = F.format_string("%04d-%02d-%02d", (2000 + d % 25).cast("int"), (1 + d % 12).cast("int"), (1 + d % 28).cast("int"))
    plain = F.concat((2000 + d % 25).cast("string"), F.lit("-"), (1 + d % 12).cast("string"), F.lit("-"), (1 + d % 28).cast("string"))
    names = F.concat(F.lit("Author A"), (d % 17).cast("string"), F.lit(", Writer B"), (d % 13).cast("string"), F.lit("., "))
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), d.cast("string")).alias("paper_id"),
        F.when(d % 4 == 0, "").otherwise(F.concat(F.lit("PMC"), d.cast("string"))).alias("pmcid"),
        F.when(d % 3 == 0, "").otherwise(d.cast("string")).alias("pmid"),
        F.when(d % 9 == 0, "").when(d % 6 == 0, "invalid-doi").otherwise(F.concat(F.lit("10."), (1000 + d % 9000).cast("string"), F.lit("/d"), d.cast("string"))).alias("doi"),
        F.substring(F.substring_index(text, "\n", 1), 1, 120).alias("title"),
        F.when(d % 13 == 0, "   ").otherwise(text).alias("abstract"),
        F.when(d % 10 == 0, F.lit("")).otherwise(names).alias("author_string"),
        F.when(d % 11 == 0, "").when(d % 7 == 0, "2024-13-01").when(d % 5 == 0, plain).otherwise(padded).alias("publication_date"),
        F.when(d % 8 == 0, "").otherwise(F.col("source")).alias("journal"),
        F.col("lang").alias("category"),
    ).withColumn("authors", split_authors(F.col("author_string")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML file for each page, a PDF for every third, some of them empty."""
    p = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("doc_"), p.cast("string")).alias("paper_id"), "page_id", F.when(p % 10 == 9, F.lit(0)).otherwise(F.octet_length("html")).cast("long").alias("length"))
    xml = pages.select("paper_id", F.lit("xml").alias("kind"), "length")
    pdf = pages.where(p % 3 == 0).select("paper_id", F.lit("pdf").alias("kind"), (F.col("length") / 2).cast("long").alias("length"))
    return xml.unionByName(pdf)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, status) of the labelled documents."""
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("paper_id"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("status"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each event type, day by day, each a revision of the one before."""
    events = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("hits"), F.count_if(F.col("value") > 50).alias("got"))
    number = F.expr("row_number() over (partition by event_type order by day)")
    rows = events.withColumn("number", number)
    name = lambda n: F.concat("event_type", F.lit("_"), n.cast("string"))
    return rows.select(name(F.col("number")).alias("query_name"), F.when(F.col("number") > 1, name(F.col("number") - 1)).alias("revision_of"), F.concat(F.lit("out/"), "event_type").alias("output_dir"), F.col("hits").cast("int").alias("result_count"), F.col("got").cast("int").alias("downloaded_count"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of each event type as the papers that a query finds in daily runs, with their events counted."""
    day = F.to_date("ts")
    found = table(spark, sf_dir, "events").where("ts is not null").groupBy(F.col("event_type").alias("query_name"), F.col("user_id").cast("string").alias("key"), day.alias("day")).agg(F.count("*").cast("string").alias("digest"))
    return found.select("query_name", "key", F.datediff("day", F.lit("2000-01-01")).alias("run"), F.col("day").cast("timestamp").alias("run_at"), "digest")


SQL = """
papers as (
  select doc_id, 'doc_' || doc_id as paper_id,
    case when doc_id % 4 = 0 then '' else 'PMC' || doc_id end as pmcid,
    case when doc_id % 3 = 0 then '' else doc_id::varchar end as pmid,
    case when doc_id % 9 = 0 then '' when doc_id % 6 = 0 then 'invalid-doi' else '10.' || (1000 + doc_id % 9000) || '/d' || doc_id end as doi,
    left(split_part(text, chr(10), 1), 120) as title,
    case when doc_id % 13 = 0 then '   ' else text end as abstract,
    case when doc_id % 10 = 0 then '' else 'Author A' || (doc_id % 17) || ', Writer B' || (doc_id % 13) || '., ' end as author_string,
    case when doc_id % 11 = 0 then '' when doc_id % 7 = 0 then '2024-13-01'
         when doc_id % 5 = 0 then (2000 + doc_id % 25) || '-' || (1 + doc_id % 12) || '-' || (1 + doc_id % 28)
         else printf('%04d-%02d-%02d', 2000 + doc_id % 25, 1 + doc_id % 12, 1 + doc_id % 28) end as publication_date,
    case when doc_id % 8 = 0 then '' else source end as journal, lang as category,
    case when doc_id % 10 = 0 then []::varchar[] else ['Author A' || (doc_id % 17), 'Writer B' || (doc_id % 13)] end as authors
  from documents),
files as (
  select 'doc_' || page_id as paper_id, 'xml' as kind, case when page_id % 10 = 9 then 0 else strlen(html) end::bigint as length from pages
  union all
  select 'doc_' || page_id, 'pdf', (case when page_id % 10 = 9 then 0 else strlen(html) end // 2)::bigint from pages where page_id % 3 = 0),
has as (select paper_id, max(case when kind = 'xml' and length > 0 then 1 else 0 end) = 1 as has_xml, max(case when kind = 'pdf' and length > 0 then 1 else 0 end) = 1 as has_pdf from files group by 1),
with_files as (select p.*, coalesce(has_xml, false) as has_xml, coalesce(has_pdf, false) as has_pdf from papers p left join has using (paper_id)),
decisions as (select 'doc_' || doc_id as paper_id, case when max(quality) = 1 then 'include' else 'exclude' end as status from labels group by doc_id),
terms as (
  select *, lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(journal, '') || ' ' || array_to_string(authors, ' ')) as blob, lower(title) as low from with_files),
found as (
  select *, list_filter(['than', 'ment', 'keit', 'ción', 'heor'], lambda t: contains(blob, t)) as location_list,
    list_filter(['ther ', 'eaux', 'lich', 'arra', 'ingre'], lambda t: contains(blob, t)) as pollutant_list,
    list_filter(['worth', 'edst', 'onre', 'vi'], lambda t: contains(blob, t)) as health_list from terms),
scored as (
  select *, (case when contains(low, 'ea') or contains(low, ' die') or starts_with(low, 'th') then 3 when contains(low, 'on') or contains(low, 'en') then 2 else 0 end
    + case when len(location_list) > 0 then 2 else -3 end + case when len(pollutant_list) > 0 then 2 else 0 end + case when len(health_list) > 0 then 1 else 0 end
    + has_xml::int + has_pdf::int + case when doi <> '' and journal <> '' then 1 else 0 end
    + case when trim(abstract) = '' and not has_xml and not has_pdf then -2 else 0 end)::int as score from found),
review as (
  select coalesce(d.status, 'review') as review_status, score, paper_id, pmcid, pmid, doi, title, publication_date, journal, array_to_string(authors, '; ') as authors, has_xml, has_pdf,
    'test_query' as query_name, 'ea OR die' as query_string, array_to_string(location_list, ', ') as location_terms, array_to_string(pollutant_list, ', ') as pollutant_terms, array_to_string(health_list, ', ') as health_terms,
    left(abstract, 200) || case when length(abstract) > 200 then '...' else '' end as abstract_snippet, '' as review_notes
  from scored left join decisions d using (paper_id)),
runs as (
  select event_type || '_' || number as query_name, case when number > 1 then event_type || '_' || (number - 1) end as revision_of, 'out/' || event_type as output_dir, hits::int as result_count, got::int as downloaded_count
  from (select event_type, day, hits, got, row_number() over (partition by event_type order by day) as number
        from (select event_type, ts::date as day, count(*) as hits, count(*) filter (value > 50) as got from events group by all)))
"""
