"""Sources as tables, against a server on this machine that answers like them."""

import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from scholium.operators.idmap import IdMap
from scholium.sources import europe_pmc, scan

N = 2345
DAYS = [f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(N)]


class Service:
    """Europe PMC under /search, arXiv at the root; fails each of ``broken`` once."""

    def __init__(self):
        self.asked, self.broken, lock = [], set(), threading.Lock()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                path, _, query = self.path.partition("?")
                params = dict(urllib.parse.parse_qsl(query))
                with lock:
                    service.asked.append((time.time(), path, params))
                    place = params.get("cursorMark", params.get("start"))
                    fails = place in service.broken
                    service.broken.discard(place)
                body = None if fails else service.search(params) if path == "/search" else service.feed(params)
                self.send_response(503 if body is None else 200)
                self.end_headers()
                self.wfile.write(body or b"")

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    @staticmethod
    def search(p):
        query = p["query"]
        if "EXT_ID" in query:
            numbers = query.split("(")[1].rstrip(")").split(" OR ")
            return json.dumps({"resultList": {"result": [{"pmid": n, "pmcid": f"PMC{n}"} for n in numbers if int(n) % 5]}}).encode()
        rows = list(range(N))
        if "FIRST_PDATE" in query:
            first, last = query.split("[")[1].split("]")[0].split(" TO ")
            rows = [i for i in rows if first <= DAYS[i] <= last]
        if "sort" in p:
            rows.sort(key=lambda i: DAYS[i], reverse=True)
        at = 0 if p["cursorMark"] == "*" else int(p["cursorMark"])
        some = rows[at : at + int(p["pageSize"])]
        hits = [{"pmcid": f"PMC{i}", "pmid": str(i), "title": f"T{i}", "firstPublicationDate": DAYS[i], "authorList": {"author": [{"fullName": "A B"}]}} for i in some]
        return json.dumps({"hitCount": len(rows), "nextCursorMark": str(at + len(some)) if some else p["cursorMark"], "resultList": {"result": hits}}).encode()

    @staticmethod
    def feed(p):
        rows = [i for i in range(N) if "cat:" not in p["search_query"] or f"cat:c{i % 4}" in p["search_query"]]
        some = rows[int(p["start"]) : int(p["start"]) + int(p["max_results"])]
        entry = "<entry><id>http://arxiv.org/abs/{0}</id><title>T{0}</title><published>{1}T00:00:00Z</published><a:primary_category term='c{2}'/></entry>"
        return f"<feed xmlns='http://www.w3.org/2005/Atom' xmlns:a='http://arxiv.org/schemas/atom' xmlns:o='http://a9.com/-/spec/opensearch/1.1/'><o:totalResults>{len(rows)}</o:totalResults>{''.join(entry.format(i, DAYS[i], i % 4) for i in some)}</feed>".encode()


@pytest.fixture
def service():
    made = Service()
    yield made
    made.server.shutdown()


def test_more_than_a_page_complete_in_order_and_one_page_retried(spark, service):
    service.broken = {"1000"}
    rows = scan.hits(spark, "europe_pmc", "x", base_url=service.url, page_size=500).collect()
    assert [r.pmcid for r in sorted(rows, key=lambda r: r.position)] == [f"PMC{i}" for i in range(N)] and rows[0].authors[0].fullName == "A B"
    assert [a[2]["cursorMark"] for a in service.asked] == ["*", "500", "1000", "1000", "1500", "2000", "2345"]


def test_pages_in_parallel(spark, service):
    service.broken = {"900"}
    frame = scan.hits(spark, "arxiv", "x", base_url=service.url, page_size=300, spacing=0)
    assert frame.rdd.getNumPartitions() == 4
    service.asked.clear()
    assert [r.arxiv_id for r in sorted(frame.collect(), key=lambda r: r.position)] == [str(i) for i in range(N)]
    starts = [a[2]["start"] for a in service.asked if a[2]["max_results"] != "1"]
    assert sorted(starts, key=int) == ["0", "300", "600", "900", "900", "1200", "1500", "1800", "2100"]


def test_date_slices_keep_the_order(spark, service):
    rows = scan.hits(spark, "europe_pmc", "x", base_url=service.url, page_size=200, start_date="2024-02-01", end_date="2024-11-20", slices=7, readers=3).collect()
    rows.sort(key=lambda r: r.position)
    want = [d for d in DAYS if "2024-02-01" <= d <= "2024-11-20"]
    assert [r.publication_date for r in rows] == sorted(want, reverse=True) and len({r.pmcid for r in rows}) == len(want)


def test_limit(spark, service):
    assert [r.pmcid for r in scan.hits(spark, "europe_pmc", "x", 5, base_url=service.url).collect()] == [f"PMC{i}" for i in range(5)]
    assert [a[2]["pageSize"] for a in service.asked][-1] == "5" and scan.hits(spark, "arxiv", "x", 0, base_url=service.url, spacing=0).count() == 0


def test_filters_reach_the_query_and_the_rest_is_applied(spark, service):
    frame = scan.hits(spark, "europe_pmc", "x", base_url=service.url).where("publication_date > '2024-05-03' and publication_date <= '2024-06-10' and title like '%7'")
    got = {r.pmcid for r in frame.collect()}
    assert got == {f"PMC{i}" for i in range(N) if "2024-05-03" < DAYS[i] <= "2024-06-10" and i % 10 == 7}
    assert service.asked[-1][2]["query"] == "(x) AND (FIRST_PDATE:[2024-05-03 TO 2024-06-10])"
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "europe_pmc" in plan
    frame = scan.hits(spark, "arxiv", "x", base_url=service.url, spacing=0).where("category in ('c1', 'c3') and publication_date >= '2024-03-01' and position < 1000")
    service.asked.clear()
    assert {r.category for r in frame.collect()} == {"c1", "c3"}
    assert service.asked[-1][2]["search_query"] == "((x) AND submittedDate:[202403010000 TO 300012312359]) AND (cat:c1 OR cat:c3)"
    assert scan.hits(spark, "arxiv", "x", base_url=service.url, spacing=0).where("category = 'c1' and category = 'c2'").count() == 0


def test_requests_of_all_readers_keep_their_distance(spark, service):
    assert scan.hits(spark, "arxiv", "x", base_url=service.url, page_size=300, spacing=0.3).count() == N
    times = sorted(a[0] for a in service.asked)
    assert len(times) >= 9 and min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.2


def test_slots():
    a, b = scan.Slots(0.05, 0, 2), scan.Slots(0.05, 1, 2)
    taken = []
    for slots in (a, b, a, a, b):
        slots.wait()
        taken.append(slots.last)
        assert time.time() >= slots.last * 0.05 - 0.001
    assert len(set(taken)) == 5 and [s % 2 for s in taken] == [0, 1, 0, 0, 1]


def test_errors(spark, service):
    with pytest.raises(Exception, match="needs the option query"):
        scan.register(spark)
        spark.read.format("arxiv").load().collect()
    service.broken = {"*"}
    with pytest.raises(Exception, match="503"):
        scan.hits(spark, "europe_pmc", "x", base_url=service.url, retries=0).collect()


def test_ids_are_resolved_by_batches_and_once(spark, service, tmp_path):
    url = service.url
    papers = spark.createDataFrame([(f"p{i}", str(i // 2), "PMC0" if i % 50 == 0 else ["", None][i % 2]) for i in range(500)] + [("none", None, None), ("blank", "", "")], "paper_id string, pmid string, pmcid string")
    ids = IdMap(spark, f"file://{tmp_path}/ids")
    got = {r.paper_id: r.pmcid for r in ids.resolve(papers, lambda some: europe_pmc.pmcids(some, url), batch=40).collect()}
    assert len(got) == 502 and got["p0"] == "PMC0" and got["p3"] == "PMC1" and got["p10"] == "" and got["p11"] is None and got["none"] is None
    wanted = 250
    assert wanted // 40 <= len(service.asked) <= wanted // 40 + 2
    service.asked.clear()
    assert {r.paper_id: r.pmcid for r in ids.resolve(papers, lambda some: europe_pmc.pmcids(some, url)).collect()} == got and not service.asked
    more = papers.unionByName(spark.createDataFrame([("new", "9001", "")], papers.schema))
    assert {r.pmcid for r in ids.resolve(more, lambda some: europe_pmc.pmcids(some, url)).where("paper_id = 'new'").collect()} == {"PMC9001"} and len(service.asked) == 1
