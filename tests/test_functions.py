import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scholium.functions import metadata as M
from scholium.functions import scoring
from scholium.functions import text as X
from scholium.operators import keywords, review
from scholium.schema import REVIEW_COLUMNS

STOP = set(keywords.STOP_WORDS)


def column(spark, values, kind, make):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_strip_is_pythons(spark):
    values = [" a ", "\x1c b\x85", "\t\n", "", "c", " d e "]
    assert column(spark, values, "string", X.strip) == [v.strip() for v in values]


@pytest.mark.parametrize("doi,valid", [("10.1000/sample", True), ("10.1038/nature12345", True), (" 10.1038/x ", True), ("invalid-doi", False), ("10.12/x", False), ("10.1000/a b", False), ("", False), (None, False)])
def test_doi(spark, doi, valid):
    assert column(spark, [doi], "string", M.doi_valid) == [valid]


def test_dates_are_strptimes(spark):
    rng = random.Random(4)
    values = ["2024-01-01", "2023-12-31", "2024-1-1", "invalid-date", "2024-13-01", "", None, "2024-02-30", "24-01-01", "2024-02-29", " 2024-01-05 ", "0000-01-01"]
    values += ["".join(rng.choice("0123456789-") for _ in range(rng.choice([8, 9, 10]))) for _ in range(300)]

    def valid(v):
        try:
            return bool(v) and bool(datetime.strptime(v.strip(), "%Y-%m-%d"))
        except ValueError:
            return False

    assert column(spark, values, "string", M.date_valid) == [valid(v) for v in values]


def test_lengths_and_authors(spark):
    assert column(spark, ["short", "x" * 10, " " * 20, "é" * 500, "x" * 501, None], "string", M.title_valid) == [False, True, False, True, False, False]
    assert column(spark, ["x" * 49, "x" * 50, None], "string", M.abstract_valid) == [False, True, False]
    assert column(spark, [["a"], [], ["a", " "], None], "array<string>", M.authors_valid) == [True, False, False, False]
    assert column(spark, ["Author A, Author B.", "", None, " , x .. ", "."], "string", M.split_authors) == [["Author A", "Author B"], [], [], ["x"], [""]]


def test_mixed_authors(spark):
    values = [['{"fullName": "A B"}', "C D", '{"lastName": "E"}', "{}", "", '"F"', '{"name": "G"}'], [], None]
    assert column(spark, values, "array<string>", M.flat_authors) == [["A B", "C D", "E", "F", "G"], [], []]


def test_normalised_fields(spark):
    raw = [{"Title": "a", "AuthorList": "b", "firstPublicationDate": "c", "journalTitle": "d", "FooBar": "e", "DOI": "f"}, None]
    got = column(spark, raw, "map<string,string>", M.normalised)
    assert got == [{"title": "a", "authors": "b", "publication_date": "c", "journal": "d", "foobar": "e", "doi": "f"}, None]
    last = spark.sql("select map('Title', '1', 'x', '0', 'title', '2') as v").select(M.normalised(F.col("v")).alias("o")).first().o
    assert last == {"title": "2", "x": "0"}


def test_citation(spark):
    rows = [("T", ["Roe, Jane", "X"], "2024-01-01"), ("", [], None), (None, None, "99")]
    frame = spark.createDataFrame(rows, "t string, a array<string>, d string")
    got = [r[0] for r in frame.select(M.citation(F.col("t"), F.col("a"), F.col("d"))).collect()]
    assert got == ["Roe (2024). T", "Unknown (n.d.). Untitled", "Unknown (99). Untitled"]


def paper(**kw):
    return {"paper_id": "p", "pmcid": "", "pmid": "", "doi": "", "title": "", "abstract": "x", "authors": [], "publication_date": "", "journal": "", "has_xml": False, "has_pdf": False} | kw


SCHEMA = "paper_id string, pmcid string, pmid string, doi string, title string, abstract string, authors array<string>, publication_date string, journal string, has_xml boolean, has_pdf boolean"
CASES = [
    (paper(title="Air quality index in Delhi", abstract="PM2.5 exposure", doi="10.1/x", journal="J", has_xml=True), 10),
    (paper(title="Urban parks in Europe"), -3),
    (paper(title="aqi trends"), 2),
    (paper(title="Levels of pm10"), 1),
    (paper(title="Nothing", abstract="  "), -5),
    (paper(title="Nothing", abstract=None, has_pdf=True), -2),
    (paper(title="Nothing", doi="10.1/x"), -3),
    (paper(title="AQI of Mumbai", abstract="health", doi="d", journal="j", has_xml=True, has_pdf=True), 11),
]


def test_scores(spark):
    rows = [tuple(c.values()) for c, _ in CASES]
    got = [r.score for r in scoring.scored(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()]
    assert got == [s for _, s in CASES]


def test_review_rows(spark, tmp_path):
    frame = spark.createDataFrame([tuple(c.values())[:0] or tuple((c | {"paper_id": f"p{i}"}).values()) for i, (c, _) in enumerate(CASES)], SCHEMA)
    table = review.validated(review.rows(frame, "q", "s"))
    assert table.columns == REVIEW_COLUMNS
    order = [(r.score, r.paper_id) for r in review.ranked(table).collect()]
    assert order == sorted(order, key=lambda x: (-x[0], x[1]))
    assert review.summary(table).first().high_score_count == 2 and review.high(table).count() == 2
    paths = review.export(table, str(tmp_path))
    assert review.read_json(spark, paths["json"]).count() == len(CASES)
    assert open(paths["csv"]).readline().strip() == ",".join(REVIEW_COLUMNS)
    assert "| review | 11 | AQI of Mumbai |  | True |" in open(paths["markdown"]).read()
    with pytest.raises(Exception, match="unknown review_status"):
        review.validated(table.withColumn("review_status", F.lit("maybe"))).collect()


def plain_keywords(text, most=10):
    counts = {}
    for w in re.findall(r"\b[a-zA-Z]{3,}\b", (text or "").lower()):
        if w not in STOP and len(w) > 3:
            counts[w] = counts.get(w, 0) + 1
    return [w for w, _ in sorted(counts.items(), key=lambda x: -x[1])[:most]]


def test_keywords(spark):
    texts = ["", None, "éole naïve pm2x abcd foo_bar test éa", "zeta alpha zeta beta alpha gamma", "this that with from climate adaptation climate", " ".join(f"word{c}" for c in "abcdefghijklm")]
    frame = spark.createDataFrame(list(enumerate(texts)), "paper_id int, abstract string")
    got = {r.paper_id: r.keywords for r in keywords.keyword_lists(frame).collect()}
    assert got == {i: plain_keywords(t) for i, t in enumerate(texts)}


def test_keywords_of_shared_keys_and_without_a_shuffle_of_texts(spark):
    long = " ".join(f"w{chr(97 + i % 7) * 4} alpha" for i in range(3000))
    rows = [("a", "beta beta gamma"), ("a", "gamma delta gamma the"), (None, "echo"), (None, "echo foxtrot"), ("b", long), ("c", None), ("d", "")]
    got = {}
    for r in keywords.top(spark.createDataFrame(rows, "paper_id string, abstract string")).collect():
        got.setdefault(r.paper_id, []).append((r.rank, r.word, r.n))
    assert {k: sorted(v) for k, v in got.items()} == {
        "a": [(1, "gamma", 3), (2, "beta", 2), (3, "delta", 1)],
        None: [(1, "echo", 2), (2, "foxtrot", 1)],
        "b": [(1, "alpha", 3000), *((i + 2, f"w{chr(97 + i) * 4}", 429 if i < 4 else 428) for i in range(7))],
    }
    alone = keywords.top(spark.createDataFrame(rows[4:], "paper_id string, abstract string"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
