import json
import os

from scholium.operators import corpus
from scholium.operators.corpus import Corpus


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_every_key_comes_back_and_is_found(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/c")
    record = {"title": "On air", "authors": [{"fullName": "Ann Lee"}, "Bo"], "license": "CC BY", "pages": 12, "open": True, "none": None, "funding": {"agency": "DFG", "grants": ["A-1", "B-2"]}, "odd key": "x\"y", "x.y": 1.5}
    c.add_json(spark.createDataFrame([("p1", json.dumps(record)), ("p2", "{}")], "paper_id string, metadata string"))
    got = c.get("p1")
    assert {k: v for k, v in got.items() if k in record and k not in ("authors", "x.y")} == {k: v for k, v in record.items() if k not in ("authors", "x.y")}
    assert got["authors"] == ["Ann Lee", "Bo"] and got["extra"].keys() == record.keys() and float(got["x.y"]) == 1.5
    found = lambda query, field: {r.paper_id for r in c.search(query, field).collect()}
    for query, field in (("cc by", "license"), ("12", "pages"), ("dfg", "funding.agency"), ("b-2", "funding.grants.1"), ("a-1", "funding.grants"), ("x\"Y", "odd key"), ("true", "open"), ("bo", "authors"), ("AIR", "title")):
        assert found(query, field) == {"p1"}, field
    assert not found("x", "nothing") and not found("x", "funding.grants.9") and not found("x", 'a"]b') and not found("x", '"'+"'")


def test_columns_without_a_place_are_kept(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/c")
    c.add(spark.createDataFrame([("p1", "T", 7, ["a", "b"])], "paper_id string, title string, citations int, tags array<string>"))
    c.add(spark.createDataFrame([("p2", "U")], "paper_id string, title string"))
    assert c.get("p1")["citations"] == 7 and c.get("p1")["tags"] == ["a", "b"] and c.get("p2")["extra"] is None
    assert [r.paper_id for r in c.search("b", "tags").collect()] == ["p1"]


def test_adding_few_papers_writes_few_bytes(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/c")
    c.add(spark.range(60_000).selectExpr("concat('p', id) as paper_id", "sha2(string(id), 512) as title"))
    before = size(tmp_path / "c")
    c.add(spark.range(59_950, 60_050).selectExpr("concat('p', id) as paper_id", "'new' as title"))
    assert size(tmp_path / "c") - before < before / 100
    assert c.list().count() == 60_050 and c.papers().where("title = 'new'").count() == 100 and c.get("p59960")["title"] == "new"


def test_additions_override_and_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "ADDITIONS", 3)
    c = Corpus(spark, f"file://{tmp_path}/c")
    c.add(spark.range(200).selectExpr("concat('p', id) as paper_id", "'0' as title"))
    parts = []
    for i in range(1, 6):
        c.add(spark.createDataFrame([("p1", str(i)), (f"n{i}", str(i))], "paper_id string, title string"))
        parts.append(len(c._parts(c._number())))
        assert c.get("p1")["title"] == str(i) and c.list().count() == 200 + i
    assert parts == [2, 3, 4, 1, 2]
    c.add(spark.range(150).selectExpr("concat('p', id) as paper_id", "'big' as title"))
    assert len(c._parts(c._number())) == 1 and c.papers().where("title = 'big'").count() == 150


def test_expiry_keeps_what_pointers_name(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/c")
    for i in range(4):
        c.write(spark.createDataFrame([(f"p{i}", "t")], "paper_id string, title string"))
    c.add(spark.createDataFrame([("q", "t")], "paper_id string, title string"))
    assert c.expire(keep=1) == 0 and c.expire(keep=1, grace=0) == 4
    assert {r.paper_id for r in Corpus(spark, f"file://{tmp_path}/c").list().collect()} == {"p3", "q"}
    c.add(spark.createDataFrame([("r", "t")], "paper_id string, title string"))
    assert c.list().count() == 3
