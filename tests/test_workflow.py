import hashlib
import json
import os
import time

import pytest

from scholium import sources  # noqa: F401
from scholium.errors import CorpusError, SourceError
from scholium.functions import scoring
from scholium.operators import corpus, files, review, runs, workflow
from scholium.sources import arxiv, registry

ONE = [("p1", "One", "a"), ("p2", "Two", "b")]
COLUMNS = "paper_id string, title string, doi string"
HITS = {"resultList": {"result": [{"pmcid": "PMC1", "title": "Air pollution in Delhi", "abstractText": "Exposure to pm2.5 in India", "doi": "10.1/a", "journalTitle": "J"}, {"pmid": "2", "title": "Rivers of Europe"}, {"pmcid": "PMC3", "title": "Gone"}, {"title": "no id"}]}}
ATOM = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.1</id><title>T</title><summary>S</summary><author><name>N</name></author><published>2024</published></entry></feed>'


def fetch(url):
    if "/search" in url:
        return json.dumps(HITS if "EXT_ID" not in url else {}).encode()
    if "PMC3" in url:
        raise OSError("404")
    return b"<article/>"


def test_crash_before_the_pointer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    c = corpus.Corpus(spark, f"file://{tmp_path}/c")
    c.add(spark.createDataFrame(ONE, COLUMNS))

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(c, "_point", crash)
    with pytest.raises(KeyboardInterrupt):
        c.add(spark.createDataFrame([("p3", "Three", "c")], COLUMNS))
    again = corpus.Corpus(spark, f"file://{tmp_path}/c")
    assert {r.paper_id for r in again.list().collect()} == {"p1", "p2"}
    again.add(spark.createDataFrame([("p4", "Four", "d")], COLUMNS))
    assert {r.paper_id for r in again.list().collect()} == {"p1", "p2", "p4"}


def test_a_pointer_that_was_never_renamed_is_not_read(spark, tmp_path):
    c = corpus.Corpus(spark, f"file://{tmp_path}/c")
    c.add(spark.createDataFrame(ONE, COLUMNS))
    (tmp_path / "c" / ".v-half").write_text("v-ha")
    assert c.list().count() == 2


def test_the_later_of_two_writers_is_refused(spark, tmp_path):
    a, b = (corpus.Corpus(spark, f"file://{tmp_path}/c") for _ in range(2))
    a.add(spark.createDataFrame(ONE, COLUMNS))
    base = b._number()
    a.add(spark.createDataFrame([("p3", "Three", "c")], COLUMNS))
    with pytest.raises(CorpusError):
        b.write(spark.createDataFrame([("p4", "Four", "d")], COLUMNS), base)
    assert {r.paper_id for r in b.list().collect()} == {"p1", "p2", "p3"}


def test_unknown_field_finds_nothing(spark):
    papers = spark.createDataFrame(ONE, COLUMNS)
    assert corpus.search(papers, "One", "nothing").count() == 0 and corpus.search(papers, "one").count() == 1


def test_revisions_of_long_chains_orphans_and_circles(spark):
    rows = [("r0", None)] + [(f"r{i}", f"r{i - 1}") for i in range(1, 300)] + [("lost", "unknown"), ("later", "lost"), ("x", "y"), ("y", "z"), ("z", "x"), ("on", "x"), ("self", "self")]
    got = {r.query_name: (r.root, r.depth) for r in runs.revisions(spark.createDataFrame(rows, "query_name string, revision_of string")).collect()}
    assert len(got) == len(rows) and all(got[f"r{i}"] == ("r0", i) for i in range(300))
    assert got["lost"] == ("lost", 0) and got["later"] == ("lost", 1)
    assert all(got[n] == (None, None) for n in ("x", "y", "z", "on", "self"))
    assert runs.revisions(spark.createDataFrame([], "query_name string, revision_of string")).count() == 0


def test_abstract_falls_back(spark):
    rows = spark.createDataFrame([("a", "", "In India, mortality"), ("b", "own", "India"), ("c", None, None)], "paper_id string, abstract string, abstracttext string")
    papers = rows.selectExpr("*", "'' as title", "'' as journal", "'' as doi", "array('A') as authors", "false as has_xml", "false as has_pdf")
    got = {r.paper_id: r for r in scoring.scored(papers).collect()}
    assert got["a"].location_list == ["india"] and got["b"].location_list == [] and got["a"].score == 3 and got["c"].score == -5


def test_run_query_and_review(spark, tmp_path):
    out = workflow.run_query_and_review(spark, "aqi", "air", str(tmp_path / "o"), limit=4, fetch=fetch, notes="n")
    assert (out["result_count"], out["downloaded_count"], out["row_count"], out["xml_count"]) == (4, 1, 4, 1)
    assert out["summary"] == f"Query 'aqi': 4 results, 1 downloaded -> {tmp_path}/o" and out["query_run"]["notes"] == "n"
    assert runs.context(spark, out["query_run_path"]) == ("aqi", "air") and len(json.load(open(out["search_results_path"]))) == 4
    best = review.to_pandas(out["table"]).iloc[0]
    assert best.paper_id == "europe_pmc_PMC1" and best.has_xml and best.score >= 5 and len(json.load(open(out["review_paths"]["json"]))) == 4
    _, done, failed = workflow.search_and_download(registry.source("europe_pmc", spark, fetch), "air", 4, str(tmp_path / "p"), ["xml"])
    assert done == ["PMC1"] and set(failed) == {"2", "PMC3"}


def test_pilot(spark, tmp_path):
    config = tmp_path / "c.yaml"
    config.write_text("query_name: small\nquery_string: air\nlimit: 3\nformats:\n  - xml\n")
    run = workflow.pilot(spark, str(config), str(tmp_path), fetch)
    assert run["result_count"] == 3 and run["output_dir"] == f"{tmp_path}/queries/small" and os.path.exists(run["search_results_path"])
    config.write_text("query_name: small\n")
    with pytest.raises(CorpusError):
        workflow.pilot(spark, str(config), str(tmp_path), fetch)


def test_ingest_review_and_export(spark, tmp_path):
    for name, record in (("PMC1", {"title": "Air quality index of Delhi", "abstractText": "Exposure to pm10", "pmcid": "PMC1", "doi": "10.1/a", "journalInfo": {"journal": {"title": "J"}}}), ("PMC2", {"title": "Rivers", "pmcid": "PMC2"}), ("other", {})):
        (tmp_path / "h" / name).mkdir(parents=True)
        (tmp_path / "h" / name / "eupmc_result.json").write_text(json.dumps(record))
    (tmp_path / "h" / "PMC1" / "fulltext.xml").write_text("<article/>")
    (tmp_path / "h" / "PMC2" / "fulltext.pdf").write_bytes(b"%PDF")
    (tmp_path / "h" / "other" / "fulltext.xml").write_text("<no/>")
    root = str(tmp_path / "bag")
    paths = workflow.ingest_and_review(spark, str(tmp_path / "h"), root)
    rows = {r["paper_id"]: r for r in json.load(open(paths["json"]))}
    assert set(rows) == {"europe_pmc_PMC1", "europe_pmc_PMC2"} and rows["europe_pmc_PMC1"]["has_xml"] and rows["europe_pmc_PMC2"]["has_pdf"] and not rows["europe_pmc_PMC2"]["has_xml"]
    bag = files.Bag(spark, root)
    assert bag.valid() and os.path.exists(f"{root}/data/documents/xml/europe_pmc_PMC1.xml") and len(os.listdir(f"{root}/data/documents/xml")) == 1
    listed = {r.path for r in bag.expected().where("alg = 'sha512'").collect()}
    assert {"data/documents/xml/europe_pmc_PMC1.xml", "data/metadata/europe_pmc_PMC1_metadata.json"} <= listed
    assert json.load(open(f"{root}/data/metadata/europe_pmc_PMC1_metadata.json"))["title"] == "Air quality index of Delhi"
    assert json.load(open(workflow.export_reviewed(spark, root, str(tmp_path / "all"))))["paper_count"] == 2
    rows["europe_pmc_PMC1"]["review_status"] = "include"
    (tmp_path / "edited.json").write_text(json.dumps(list(rows.values())))
    path = workflow.export_reviewed(spark, root, str(tmp_path / "some"), str(tmp_path / "edited.json"))
    made = json.load(open(path))
    assert os.path.basename(path) == "chatbot_manifest.json" and os.path.exists(made["papers"][0]["metadata_path"])
    assert made["paper_count"] == 1 and made["papers"][0]["source_id"] == "europe_pmc_PMC1" and made["papers"][0]["xml_path"].endswith("europe_pmc_PMC1.xml")


def test_sha512_of_a_payload(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a").write_bytes(b"abc")
    (tmp_path / "data" / "b").write_bytes(b"")
    got = {(r.path, r.alg): r.digest for r in files.manifest(spark, str(tmp_path)).collect()}
    assert got == {(f"data/{n}", a): hashlib.new(a, raw).hexdigest() for n, raw in (("a", b"abc"), ("b", b"")) for a in ("sha256", "sha512")}


def test_arxiv_lookup_and_download(spark, tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        return ATOM if "api/query" in url and "none" not in url else b"<feed/>" if "none" in url else b"%PDF"

    a = registry.source("arxiv", spark, get)
    a.spacing = 0
    assert a.paper("2401.1")["title"] == "T" and "id_list=2401.1" in asked[-1]
    with pytest.raises(SourceError):
        a.paper("none")
    got = a.download("math/2401.1", str(tmp_path), ["pdf", "source"])
    assert {k: os.path.basename(p) for k, p in got["files"].items()} == {"pdf": "math_2401.1.pdf", "source": "math_2401.1.tar.gz"} and open(got["files"]["pdf"], "rb").read() == b"%PDF"
    assert asked[-2:] == ["https://arxiv.org/pdf/math/2401.1.pdf", "https://arxiv.org/e-print/math/2401.1"]


def test_requests_are_spaced(spark):
    a = arxiv.Arxiv(spark, lambda url: b"<feed/>")
    a.spacing = 0.2
    began = time.monotonic()
    for _ in range(3):
        a.fetch("u")
    assert 0.4 <= time.monotonic() - began < 2
    began = time.monotonic()
    a.fetch("u", paced=False)
    assert time.monotonic() - began < 0.1


def test_run_query_and_review_of_arxiv(spark, tmp_path):
    def get(url):
        return ATOM if "api/query" in url else b"%PDF"

    out = workflow.run_query_and_review(spark, "q", "x", str(tmp_path / "o"), repository="arxiv", limit=2, formats=["pdf"], fetch=get)
    row = out["table"].first()
    assert (row.paper_id, row.has_pdf, out["downloaded_count"]) == ("europe_pmc_2401.1", True, 1)


def test_any_failure_of_an_item_lets_the_others_go_on(spark, tmp_path):
    origin = registry.source("europe_pmc", spark, fetch)
    asked = origin.download

    def download(paper, *rest):
        if paper == "2":
            raise ValueError("malformed answer")
        return asked(paper, *rest)

    origin.download = download
    _, done, failed = workflow.search_and_download(origin, "air", 4, str(tmp_path / "p"), ["xml"])
    assert done == ["PMC1"] and failed["2"] == "malformed answer" and set(failed) == {"2", "PMC3"}


def test_bags_with_any_name(spark, tmp_path):
    for name in ("c++", "a b(1)", "bag/data/bag"):
        bag = files.Bag(spark, f"{tmp_path}/{name}").create()
        with open(f"{bag.path}/data/x.txt", "w") as out:
            out.write("x")
        bag.update()
        assert bag.valid() and {r.path for r in bag.expected().collect()} == {"data/keep", "data/x.txt"}
