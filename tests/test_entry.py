"""Every query over the smallest tables against its SQL."""

import glob
import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scholium.plans import views

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, DIR)
    names = sorted(frame.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in frame.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)


def test_corpus_filter_is_pushed(spark):
    plan = QUERIES["corpus_list"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_sha512_of_pages(spark, duck):
    want = {i: hashlib.sha512(h.encode()).hexdigest() for i, h in duck.sql("select page_id, html from pages").fetchall()}
    assert {r.page_id: r.digest for r in QUERIES["manifest_sha512"](spark, DIR).collect()} == want


def test_xml_metadata_is_the_papers(spark):
    papers = {f"{r.paper_id}.xml": r for r in views.papers(spark, DIR).collect()}
    found = QUERIES["xml_metadata"](spark, DIR).collect()
    assert len(found) == len(papers) > 0
    for r in found:
        p = papers[r.path]
        assert (r.title, r.doi, r.authors, r.error) == (p.title, p.doi, "|".join(p.authors), None)
