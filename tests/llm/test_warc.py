import base64
import gzip
import hashlib
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholium.llm import warc

ROWS = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "v", "é" * 200_000), (6, "w", "é" * 200_000), (7, "v", "line\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>x</p>"), (None, "m", "alone"), (None, None, "alone")]


def plain(rows, least=0):
    """Expected result by the definition; a page without page_id is no one's response."""
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        best = max((q for q, _, g in rows if q is not None and (g or "") == (h or "")), default=p)
        again = len(raw) >= least and best != p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,chunk", [(0, 1 << 16), (5, 7)])
def test_round_trip(spark, tmp_path, least, chunk):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, data string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", least, chunk)
    got = warc.read_archives(manifest, payload=True)
    last = got.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, last), key=str) == plain(ROWS, least)
    body = {}
    for r in sorted(got.where("page_id is not null").collect(), key=lambda r: (r.page_id, r.chunk)):
        assert r.n_bytes == len(r.data) <= 1 << 16
        body[r.page_id] = body.get(r.page_id, b"") + bytes(r.data)
    told = {r[0]: r[3] for r in plain(ROWS, least)}
    assert body == {p: (h or "").encode() if told[p] == "response" else b"" for p, _, h in ROWS if p is not None}
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").iterdir()))
    assert raw.count(b"WARC-Type:") == len(ROWS)


def test_empty_and_repeats(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "b"), (2, "u", "c")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/r")).where("last").collect()
    assert len(got) == 4 and {r.record_type for r in got} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op7_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == plain(rows)


def test_records_are_cut_before_python(spark):
    """Chunk rows come in order, none longer than a chunk, in time that grows with the page and not its square."""
    text = "é<p>word" * 3_000_000
    pages = spark.createDataFrame([(1, "u", text), (2, "u", "")], "page_id long, url string, html string")
    rows = warc.chunked(pages, 1 << 16).select("page_id", "chunk", "last", F.octet_length("data").alias("size"), F.sha1("data").alias("sha")).collect()
    raw = text.encode()
    cut = [raw[a : a + (1 << 16)] for a in range(0, len(raw), 1 << 16)]
    assert [(r.chunk, r.last, r.size, r.sha) for r in rows if r.page_id == 1] == [(i, i == len(cut) - 1, len(c), hashlib.sha1(c).hexdigest()) for i, c in enumerate(cut)]
    assert [(r.chunk, r.last, r.size) for r in rows if r.page_id == 2] == [(0, True, 0)]


def test_memory_is_bounded_by_chunks(tmp_path):
    """Digests, writer and reader of a record of 200 MB hold but some chunks of it."""
    piece, many = bytes(range(256)) * 256, 3200
    digest = hashlib.sha1()
    for _ in range(many):
        digest.update(piece)
    digest = base64.b32encode(digest.digest()).decode()

    def rows(with_digest):
        for i in range(many):
            cols = {"page_id": [9], "n": [many * len(piece)], "h": [1], "chunk": [i], "data": [piece], "last": [i == many - 1]}
            full = {"page_id": [9], "url": ["u"], "n": [many * len(piece)], "record": [0], "chunk": [i], "last": [i == many - 1], "payload_digest": [digest], "response": pa.array([None], pa.int64()), "data": [piece]}
            yield pa.RecordBatch.from_pydict(full if with_digest else cols)

    tracemalloc.start()
    assert [b.column(3).to_pylist() for b in warc.running(rows(False)) if len(b)] == [[digest]]
    with open(tmp_path / "w.gz", "wb") as out:
        assert warc.stream(out, rows(True)) == 1
    with open(tmp_path / "w.gz", "rb") as source:
        last = [row for row, data in warc.read_records(source)][-1]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last[0] == 9 and last[4] and last[8] == digest and most < 8 << 20
