"""A query for each operator over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as X
from ..operators import corpus, export, files, keywords, lexicon, review, runs
from ..operators.search_index import SearchIndex
from ..shared import new_path
from ..streaming import changes, windows
from . import views as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL over the views."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql if sql.lstrip().lower().startswith("with ") else f"with recursive {V.SQL} {sql}"
        return f

    return add


def _review(spark, d):
    rows = review.with_files(V.papers(spark, d), V.files(spark, d))
    rows = rows.join(V.decisions(spark, d), "paper_id", "left")
    return review.rows(rows, "test_query", "ea OR die", V.PROFILE, status=F.coalesce("status", F.lit("review")))


@query("select paper_id from papers")
def corpus_list(spark, d):
    return V.papers(spark, d).select("paper_id")


_CARD = ["paper_id", "pmcid", "pmid", "doi", "title", "publication_date", "journal"]


@query("select paper_id, pmcid, pmid, doi, title, publication_date, journal from papers where paper_id = 'doc_7'")
def corpus_get(spark, d):
    return corpus.get(V.papers(spark, d), "doc_7").select(*_CARD)


@query("select paper_id, title from papers where contains(lower(title), 'then')")
def corpus_search_title(spark, d):
    return corpus.search(V.papers(spark, d), "TheN").select("paper_id", "title")


@query("select paper_id from papers where contains(lower(abstract), 'thing')")
def corpus_search_abstract(spark, d):
    return corpus.search(V.papers(spark, d), "thing", "abstract").select("paper_id")


@query("select paper_id from papers where contains(lower(array_to_string(authors, ', ')), 'a3, writer b')")
def corpus_search_authors(spark, d):
    return corpus.search(V.papers(spark, d), "A3, Writer B", "authors").select("paper_id")


@query("select (select count(*) from papers) as total_papers, round(sum(length) / 1048576, 4) as corpus_size_mb from files")
def corpus_stats(spark, d):
    rows = V.files(spark, d).withColumn("modified", F.current_timestamp())
    return corpus.statistics(V.papers(spark, d), rows).select("total_papers", "corpus_size_mb")


@query("select paper_id, title, journal from papers where paper_id not in (select paper_id from decisions) union all select paper_id, status, 'new' from decisions")
def corpus_upsert(spark, d):
    new = V.decisions(spark, d).select("paper_id", F.col("status").alias("title"), F.lit("new").alias("journal"))
    return corpus.upsert(V.papers(spark, d).select("paper_id", "title", "journal"), new)


@query("select paper_id, title, journal from papers where paper_id not in (select paper_id from decisions) union all select paper_id, status, 'new' from decisions")
def corpus_add(spark, d):
    """All papers added to a new corpus, and then the decided ones again with other titles."""
    made = corpus.Corpus(spark, new_path(spark, "corpus"))
    made.add(V.papers(spark, d).select("paper_id", "title", "journal"))
    made.add(V.decisions(spark, d).select("paper_id", F.col("status").alias("title"), F.lit("new").alias("journal")))
    return made.papers().select("paper_id", "title", "journal")


@query("select 'event_' || event_id as paper_id, json_extract_string(props, '$.k') as k, event_type from events where contains(json_extract_string(props, '$.k'), '7')")
def open_metadata_search(spark, d):
    """Events as papers whose every key is open metadata, found again by a path in it."""
    made = corpus.Corpus(spark, new_path(spark, "corpus"))
    events = V.table(spark, d, "events").select(F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("paper_id"), "event_type", F.parse_json("props").alias("props"))
    made.add(events)
    found = corpus.search(made.papers(), "7", "props.k")
    return found.select("paper_id", corpus.open_text("props.k").alias("k"), corpus.open_text("event_type").alias("event_type"))


@query("select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1995-06-30'")
def date_range_search(spark, d):
    return corpus.by_date(V.table(spark, d, "orders"), "1995-01-01", "1995-06-30", "o_orderdate").select("o_orderkey", "o_totalprice")


@query("select paper_id, category from papers where category in ('de', 'fr')")
def category_search(spark, d):
    return corpus.in_categories(V.papers(spark, d), ["de", "fr"]).select("paper_id", "category")


@query("select paper_id, category from papers")
def category_fallback(spark, d):
    return corpus.in_categories(V.papers(spark, d), ["tlh"]).select("paper_id", "category")


@query("select doc_id, 'europe_pmc_' || coalesce(nullif(pmcid, ''), nullif(pmid, ''), 'unknown') as paper_id from papers")
def id_coalesce(spark, d):
    return V.papers(spark, d).select("doc_id", M.paper_id("europe_pmc_", F.col("pmcid"), F.col("pmid")).alias("paper_id"))


@query("select doc_id, case when doc_id % 2 = 0 then doi else title end as title, publication_date, journal as foobar from papers")
def normalize_fields(spark, d):
    raw = F.map_from_arrays(F.array(F.lit("Title"), F.lit("firstPublicationDate"), F.lit("FooBar"), F.when(F.col("doc_id") % 2 == 0, "title").otherwise("other")), F.array("title", "publication_date", "journal", "doi"))
    out = V.papers(spark, d).select("doc_id", M.normalised(raw).alias("m"))
    return out.select("doc_id", *(F.col("m")[k].alias(k) for k in ("title", "publication_date", "foobar")))


@query("select doc_id, coalesce(array_to_string(authors, '|'), '') as names, len(authors) as n from papers")
def authors_split(spark, d):
    names = M.split_authors(F.col("author_string"))
    return V.papers(spark, d).select("doc_id", F.array_join(names, "|").alias("names"), F.size(names).cast("long").alias("n"))


@query("select doc_id, array_to_string(case when doc_id % 10 = 0 then []::varchar[] when doc_id % 2 = 0 then [authors[1]] else authors end, '|') as names from papers")
def authors_flatten(spark, d):
    a = F.col("authors")
    record = F.to_json(F.struct(F.get(a, F.lit(0)).alias("fullName"), F.lit("x").alias("lastName")))
    last = F.to_json(F.struct(F.lit("").alias("fullName"), F.get(a, F.lit(0)).alias("lastName")))
    mixed = F.when(F.size(a) == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 2 == 0, F.array(record, F.lit("{}"), F.lit(""))).otherwise(F.array(last, F.get(a, F.lit(1))))
    return V.papers(spark, d).select("doc_id", F.array_join(M.flat_authors(mixed), "|").alias("names"))


@query("select doc_id, array_to_string(authors, '; ') as authors from papers")
def authors_join(spark, d):
    return V.papers(spark, d).select("doc_id", M.joined_authors(F.col("authors")).alias("authors"))


@query("select doc_id, left(abstract, 200) || case when length(abstract) > 200 then '...' else '' end as snippet from papers")
def abstract_snippet(spark, d):
    return V.papers(spark, d).select("doc_id", X.snippet(F.col("abstract")).alias("snippet"))


@query("select doc_id, regexp_full_match(trim(doi), '10\\.[0-9]{4,}/[^\\s]+') as valid from papers")
def validate_doi(spark, d):
    return V.papers(spark, d).select("doc_id", M.doi_valid(F.col("doi")).alias("valid"))


@query("select doc_id, try_strptime(publication_date, '%Y-%m-%d') is not null as valid from papers")
def validate_date(spark, d):
    return V.papers(spark, d).select("doc_id", M.date_valid(F.col("publication_date")).alias("valid"))


_REQUIRED = "trim(title) <> '' and trim(abstract) <> '' and trim(doi) <> '' and len(authors) > 0 and trim(publication_date) <> ''"


@query(f"select doc_id, {_REQUIRED} as required, title <> '' and abstract <> '' and doi <> '' and len(authors) > 0 and publication_date <> '' as complete from papers")
def validate_required(spark, d):
    return V.papers(spark, d).select("doc_id", M.required_present().alias("required"), M.complete().alias("complete"))


_REPORT = """select doc_id, trim(title) <> '' as title_present, trim(abstract) <> '' as abstract_present, trim(doi) <> '' as doi_present, len(authors) > 0 as authors_present, trim(publication_date) <> '' as publication_date_present,
  regexp_full_match(trim(doi), '10\\.[0-9]{4,}/[^\\s]+') as doi_valid, try_strptime(publication_date, '%Y-%m-%d') is not null as publication_date_valid, len(authors) > 0 as authors_valid,
  length(trim(title)) between 10 and 500 as title_valid, length(trim(abstract, chr(10) || ' ')) >= 50 as abstract_valid from papers"""


@query(_REPORT)
def validate_report(spark, d):
    return V.papers(spark, d).select("doc_id", *(v.alias(k) for k, v in M.report().items()))


@query(f"select category, count(*) as n, count(*) filter (doi_valid) as dois, count(*) filter (publication_date_valid) as dates, count(*) filter (title_valid and abstract_valid and authors_valid) as texts from ({_REPORT}) join papers using (doc_id) group by category")
def validation_rollup(spark, d):
    rows = V.papers(spark, d).select("category", *(v.alias(k) for k, v in M.report().items()))
    counts = {"n": F.count("*"), "dois": F.count_if("doi_valid"), "dates": F.count_if("publication_date_valid"), "texts": F.count_if(F.col("title_valid") & F.col("abstract_valid") & F.col("authors_valid"))}
    return rows.groupBy("category").agg(*(v.alias(k) for k, v in counts.items()))


_STOP = ", ".join(f"'{w}'" for w in keywords.STOP_WORDS if len(w) > 3)
_TOKENS = f"tokens as (select paper_id, w, pos from (select paper_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (select paper_id, regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]+') as ws from papers)) where regexp_full_match(w, '[a-z]{{4,}}') and w not in ({_STOP}))"


@query(f"with {V.SQL}, {_TOKENS}, counted as (select paper_id, w as word, count(*) as n, min(pos) as first_pos from tokens group by 1, 2) select paper_id, rank::int as rank, word, n from (select *, row_number() over (partition by paper_id order by n desc, first_pos) as rank from counted) where rank <= 10")
def keywords_per_doc(spark, d):
    return keywords.top(V.papers(spark, d))


@query(f"with {V.SQL}, {_TOKENS} select w as word, count(*) as n from tokens group by 1")
def keywords_corpus(spark, d):
    return keywords.corpus_counts(V.papers(spark, d))


@query("select paper_id, array_to_string(location_list, ', ') as location_terms, array_to_string(pollutant_list, ', ') as pollutant_terms, array_to_string(health_list, ', ') as health_terms from found")
def lexicon_match(spark, d):
    rows = review.scored(review.with_files(V.papers(spark, d), V.files(spark, d)), V.PROFILE)
    return rows.select("paper_id", *(F.array_join(f"{k}_list", ", ").alias(f"{k}_terms") for k in ("location", "pollutant", "health")))


@query("""select paper_id, count(term) as n, min(term) as first from papers left join (select distinct lower(left(title, 9)) as term from papers where title <> '') on contains(lower(abstract), term) group by paper_id""")
def lexicon_large(spark, d):
    """How each title begins as a lexicon: as many terms as there are papers, nearly."""
    papers = V.papers(spark, d)
    terms = papers.where("title <> ''").select(F.lower(F.substring("title", 1, 9)).alias("term"))
    found = lexicon.matches(papers.select("paper_id", F.lower("abstract").alias("text")), terms)
    return found.select("paper_id", F.size("terms").cast("long").alias("n"), F.get("terms", F.lit(0)).alias("first"))


@query("select paper_id from papers where contains(lower(abstract), 'thing')")
def corpus_search_indexed(spark, d):
    index = SearchIndex(spark, new_path(spark, "search-index")).build(V.papers(spark, d))
    return index.search("Thing")


@query("select paper_id, score from scored")
def relevance_score(spark, d):
    return review.scored(review.with_files(V.papers(spark, d), V.files(spark, d)), V.PROFILE).select("paper_id", "score")


@query("select * from review")
def review_table(spark, d):
    return review.validated(_review(spark, d))


@query("select paper_id, score, title from review order by score desc, paper_id limit 15")
def review_topk(spark, d):
    return review.ranked(_review(spark, d)).select("paper_id", "score", "title").limit(15)


@query("select paper_id, review_status from review where review_status = 'include'")
def review_filter_include(spark, d):
    return review.of_status(_review(spark, d), "include").select("paper_id", "review_status")


@query("select paper_id, score from review where score >= 5 and has_xml")
def review_high_score_xml(spark, d):
    return review.high(_review(spark, d), with_xml=True).select("paper_id", "score")


@query("select paper_id from review where regexp_matches(title, '(?i)thing|ou$') or regexp_matches(abstract_snippet, '(?i)thing|ou$')")
def review_term_filter(spark, d):
    return review.with_term(_review(spark, d), "(?:thing|ou$)").select("paper_id")


@query("select count(*) as row_count, count(*) filter (score >= 5) as high_score_count, count(*) filter (has_xml) as xml_count, count(*) filter (score >= 5 and has_xml) as high_with_xml from review")
def review_summary(spark, d):
    return review.summary(_review(spark, d))


@query("select paper_id, '| ' || review_status || ' | ' || score || ' | ' || left(replace(title, '|', '\\|'), 80) || ' | ' || pmcid || ' | ' || case when has_xml then 'True' else 'False' end || ' |' as line from review")
def review_markdown_rows(spark, d):
    return _review(spark, d).select("paper_id", review.markdown_line().alias("line"))


@query("select paper_id, has_xml, has_pdf from with_files")
def file_presence_join(spark, d):
    return review.with_files(V.papers(spark, d), V.files(spark, d)).select("paper_id", "has_xml", "has_pdf")


@query("select page_id, sha256(html) as digest, strlen(html)::bigint as length from pages")
def manifest_sha256(spark, d):
    return V.table(spark, d, "pages").select("page_id", files.digest(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("length"))


@query()
def manifest_sha512(spark, d):
    return V.table(spark, d, "pages").select("page_id", files.digest(F.col("html").cast("binary"), "sha512").alias("digest"))


@query("select sum(length) || '.' || count(*) as payload_oxum from (select page_id, strlen(html) as length from pages)")
def payload_oxum(spark, d):
    return files.payload_oxum(V.table(spark, d, "pages").select(F.col("page_id").alias("path"), F.octet_length("html").cast("long").alias("length")))


@query("""select case when page_id % 7 = 0 and state = 'extra' then 'data/moved/' else 'data/' end || page_id as path, 'sha256' as alg, state from (
  select page_id, unnest(case when page_id % 7 = 0 then ['missing', 'extra'] when page_id % 13 = 0 then ['changed'] else [] end) as state from pages)""")
def fixity_diff(spark, d):
    """All pages as a manifest has them, and all as they are: every seventh moved, every thirteenth changed."""
    p = F.col("page_id")
    pages = V.table(spark, d, "pages").select(p, F.lit("sha256").alias("alg"), F.sha2("html", 256).alias("digest"))
    path = lambda folder: F.concat(folder, p.cast("string")).alias("path")
    then = pages.select(path(F.lit("data/")), "alg", "digest")
    now = pages.select(path(F.when(p % 7 == 0, "data/moved/").otherwise("data/")), "alg", F.when(p % 13 == 0, "x").otherwise(F.col("digest")).alias("digest"))
    return files.fixity(then, now)


@query("select doc_id, coalesce(authors[1], 'Unknown') || ' (' || coalesce(nullif(left(publication_date, 4), ''), 'n.d.') || '). ' || coalesce(nullif(title, ''), 'Untitled') as label from papers")
def citation_label(spark, d):
    return V.papers(spark, d).select("doc_id", M.citation(F.col("title"), F.col("authors"), F.col("publication_date")).alias("label"))


_RECORDS = """select paper_id as source_id, coalesce(authors[1], 'Unknown') || ' (' || coalesce(nullif(left(publication_date, 4), ''), 'n.d.') || '). ' || coalesce(nullif(title, ''), 'Untitled') as citation_label,
  title, abstract, doi, pmcid, pmid, publication_date, journal, array_to_string(authors, '; ') as authors, case when has_xml then 'c/data/documents/xml/' || paper_id || '.xml' else '' end as xml_path,
  case when has_pdf then 'c/data/documents/pdf/' || paper_id || '.pdf' else '' end as pdf_path, 'c/data/metadata/' || paper_id || '_metadata.json' as metadata_path
  from with_files join decisions using (paper_id) where status = 'include'"""


def _exported(spark, d):
    chosen = V.decisions(spark, d).select("paper_id", F.col("status").alias("review_status"))
    return export.records(export.included(review.with_files(V.papers(spark, d), V.files(spark, d)), review=chosen), "c")


@query(_RECORDS)
def export_records(spark, d):
    return _exported(spark, d).withColumn("authors", F.array_join("authors", "; "))


@query(f"select '1.0' as export_version, count(*) as paper_count, count(*) filter (xml_path <> '') as with_xml, md5(string_agg(source_id, ',' order by source_id)) as ids_md5 from ({_RECORDS})")
def export_manifest(spark, d):
    ids = F.md5(F.array_join(F.sort_array(F.collect_list("source_id")), ","))
    return _exported(spark, d).agg(F.lit(export.VERSION).alias("export_version"), F.count("*").alias("paper_count"), F.count_if(F.col("xml_path") != "").alias("with_xml"), ids.alias("ids_md5"))


@query("select paper_id from decisions where status = 'include' and paper_id not in (select paper_id from files)")
def export_missing_assert(spark, d):
    return export.missing(V.files(spark, d).select("paper_id"), V.decisions(spark, d).select("paper_id", F.col("status").alias("review_status")))


_KEYS = "coalesce(nullif(pmcid, ''), nullif(pmid, ''), nullif(paper_id, ''))"


@query(f"with recursive {V.SQL}, a as (select distinct {_KEYS} as k from papers where category <> 'de'), b as (select distinct {_KEYS} as k from papers where journal <> 'src3') select (select count(*) from a) as prior_count, (select count(*) from b) as current_count, (select count(*) from a join b using (k)) as overlap, (select count(*) from b where k not in (select k from a)) as new_count, (select count(*) from a where k not in (select k from b)) as dropped_count")
def run_compare(spark, d):
    papers = V.papers(spark, d)
    return runs.compare(papers.where("category <> 'de'"), papers.where("journal <> 'src3'"))


@query(f"with recursive {V.SQL}, chain as (select query_name, query_name as root, 0 as depth from runs where revision_of is null union all select r.query_name, c.root, c.depth + 1 from runs r join chain c on r.revision_of = c.query_name) select query_name, root, depth from chain")
def run_revision_chain(spark, d):
    return runs.revisions(V.runs(spark, d))


_CHANGES = """
with hits as (
  select event_type as query_name, user_id::varchar as key, (ts::date - date '2000-01-01')::int as run, count(*)::varchar as digest
  from events where ts is not null and user_id is not null group by all),
seen as (
  select *, lag(run) over w as before, lag(digest) over w as was, lead(run) over w as after, max(run) over () as last
  from hits window w as (partition by query_name, key order by run))
select query_name, key, run, case when before = run - 1 then 'changed' else 'new' end as change, digest from seen where before is distinct from run - 1 or digest <> was
union all
select query_name, key, (run + 1)::int, 'dropped', digest from seen where coalesce(after, last + 1) > run + 1
"""


@query(_CHANGES)
def run_changes(spark, d):
    return changes.between(V.hits(spark, d))


@query(_CHANGES)
def run_changes_stream(spark, d):
    return changes.followed_table(spark, V.hits(spark, d))


@query("select r.query_name, r.revision_of, p.result_count as prior_count, r.result_count - p.result_count as change from runs r left join runs p on r.revision_of = p.query_name")
def run_prior_join(spark, d):
    r = V.runs(spark, d)
    p = r.select(F.col("query_name").alias("prior"), F.col("result_count").alias("prior_count"))
    return r.join(p, r.revision_of == p.prior, "left").select("query_name", "revision_of", "prior_count", (F.col("result_count") - F.col("prior_count")).alias("change"))


@query("select 'Query ''' || query_name || ''': ' || result_count || ' results, ' || downloaded_count || ' downloaded -> ' || output_dir as line from runs")
def run_summary(spark, d):
    return V.runs(spark, d).select(M.run_summary().alias("line"))


@query("select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title from pages")
def html_title_extract(spark, d):
    return V.table(spark, d, "pages").select("page_id", files.html_title(F.col("html")).alias("title"))


@query()
def xml_metadata(spark, d):
    """Each document as a small XML file, taken apart again."""
    papers = V.papers(spark, d)
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    authors = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author>"), a, F.lit("</author>"))), "")
    xml = F.concat(F.lit("<paper><title>"), safe("title"), F.lit("</title><doi>"), safe("doi"), F.lit("</doi>"), authors, F.lit("</paper>"))
    made = papers.select(F.concat("paper_id", F.lit(".xml")).alias("path"), xml.cast("binary").alias("content"), F.octet_length(xml).cast("long").alias("length"))
    return files.extract(made).select("path", "title", "doi", F.array_join("authors", "|").alias("authors"), "error")


@query("select 'http://arxiv.org/abs/' || url as url, split_part(url, '/', -1) as arxiv_id from pages")
def arxiv_id_from_url(spark, d):
    url = F.concat(F.lit("http://arxiv.org/abs/"), "url")
    return V.table(spark, d, "pages").select(url.alias("url"), F.element_at(F.split(url, "/"), -1).alias("arxiv_id"))


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    out = windows.counts(V.table(spark, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
