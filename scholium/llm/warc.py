"""WARC archives written and read as a chunked record table.

Pages become rows of record and chunk number, at most ``CHUNK`` bytes each, before
anything else happens to them: it is such rows that are shuffled, sorted and
handed to Python. A digest is carried from chunk to chunk of a record, and its last chunk
has that of all of it. A writer streams the chunks into gzip members, one a record, and
checks the digest it promised; no writer or reader holds a record's payload whole.
The reader turns archives back into such rows with the digest so far.

Records whose payloads are equal (digest and length, ``MIN_BYTES`` or longer) are one
response, that of the largest page_id, and revisits that refer to it. The
digests are found first, in rows without payload; which record is the response
comes from a partly aggregated maximum, so copies of one page by the million
do not meet in a task. Records find their digest by page_id, length and a 64-bit hash of
their payload, which need tell only payloads of the same page_id apart. The chunks are then
shuffled once, to the writers, without those of revisits.

A writer writes to a file of its attempt and renames it when complete.

Defined results: a null html is an empty payload; a page with a null page_id gets a
record with a number of its own, is a revisit if a page with a page_id has its
payload and else a response; a repeat of the response's row is a response
too; a null url has no target header; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, table, written

CHUNK = 1 << 16
MIN_BYTES = 0
READ = 1 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
CHUNKS = "page_id long, chunk int, n_bytes long, digest_so_far string, last boolean, record_type string, refers_to long, payload_bytes long, payload_digest string"


def chunked(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, url, n, h, record, chunk, last, data): each page's payload in rows of at most ``chunk`` bytes, in order.

    ``n`` and ``h`` are the payload's bytes and hash; ``record`` tells repeated rows apart within one reading.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body"), F.monotonically_increasing_id().alias("record"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk).cast("int"))  # of the body itself, which is so read out once and not once a chunk
    rows = rows.select("page_id", "url", "record", "body", F.octet_length("body").cast("long").alias("n"), F.xxhash64("body").alias("h"), F.explode(F.sequence(F.lit(1), count)).alias("number"))
    last = F.col("number") * F.lit(chunk).cast("long") >= F.col("n")
    return rows.select("page_id", "url", "n", "h", "record", (F.col("number") - 1).alias("chunk"), last.alias("last"), F.expr(f"substring(body, (number - 1) * {chunk} + 1, {chunk})").alias("data"))


def _bare(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def running(batches):
    """The digest of each record, carried over its chunks: rows of the last ones."""
    sha = hashlib.sha1()
    for batch in batches:
        data, digests = batch.column(4), []
        for i, (number, last) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            if number == 0:
                sha = hashlib.sha1()
            sha.update(data[i].as_buffer())
            if last:
                digests.append(_bare(sha))
        ends = batch.filter(batch.column(5))
        yield pa.RecordBatch.from_arrays([*ends.columns[:3], pa.array(digests, pa.string())], ["page_id", "n", "h", "payload_digest"])


def decided(pages: DataFrame, min_bytes: int = MIN_BYTES, chunk: int = CHUNK) -> DataFrame:
    """(r_page, r_n, r_h, payload_digest, response): each different record's digest and the page it refers to, null for a response."""
    rows = chunked(pages, chunk).select("page_id", "n", "h", "chunk", "data", "last")
    found, _ = written(rows.mapInArrow(running, "page_id long, n long, h long, payload_digest string").distinct(), "warc-digests")
    same = found.groupBy("payload_digest", "n").agg(F.max("page_id").alias("response"))
    joined = found.join(same, ["payload_digest", "n"])
    refers = F.when((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select(F.col("page_id").alias("r_page"), F.col("n").alias("r_n"), F.col("h").alias("r_h"), "payload_digest", refers.alias("response"))


def header(page_id: int | None, record: int, url: str | None, n: int, digest: str, response: int | None) -> tuple[bytes, bytes]:
    """WARC header and the block's bytes before the payload; ``response``: the page that a revisit refers to."""
    revisit = response is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    name = f"page:{page_id}" if page_id is not None else f"unnumbered:{record}"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{response}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", http


def stream(out, batches) -> int:
    """Write sorted chunk rows as records, a gzip member each; how many."""
    member, sha, records = None, None, 0
    for batch in batches:
        data = batch.column(8)
        for i, (page_id, url, n, record, number, last, digest, response) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True)):
            if number == 0:
                member, sha = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1()
                out.write(member.compress(b"".join(header(page_id, record, url, n, digest, response))))
                records += 1
            if response is None:
                piece = data[i].as_buffer()
                sha.update(piece)
                out.write(member.compress(piece))
            if last:
                if response is None and _bare(sha) != digest:
                    raise ValueError(f"two payloads of page {page_id} have the same hash and length")
                out.write(member.compress(b"\r\n\r\n") + member.flush())
    return records


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Archives of ``pages`` in ``folder``; the manifest: file, n_records."""
    told = decided(pages, min_bytes, chunk).hint("merge")
    same = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("n") == F.col("r_n")) & (F.col("h") == F.col("r_h"))
    response = F.col("response").isNull()
    rows = chunked(pages, chunk).join(told, same).where(response | (F.col("chunk") == 0))
    rows = rows.select("page_id", "url", "n", "record", "chunk", (F.col("last") | ~response).alias("last"), "payload_digest", "response", F.when(response, F.col("data")).alias("data"))
    rows = rows.sortWithinPartitions("page_id", "record", "chunk")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/pages-{task.partitionId():07d}.warc.gz"
        with system.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
            records = stream(out, chain([first], batches))
        system.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name.rpartition('/')[2]}"], "n_records": [records]})

    return written(rows.mapInArrow(write, "file string, n_records long"), "warc-manifest")[0]


class _Members:
    """Bytes of a file of gzip members, asked for in small pieces."""

    def __init__(self, source):
        self.source, self.raw, self.plain, self.inflate = source, b"", bytearray(), None

    def _more(self) -> bool:
        if self.inflate is None or self.inflate.eof:
            self.raw = (self.inflate.unused_data if self.inflate else self.raw) or self.source.read(READ)
            if not self.raw:
                return False
            self.inflate = zlib.decompressobj(31)
        elif not self.raw:
            self.raw = self.source.read(READ)
            if not self.raw:
                raise ValueError("the archive ends within a record")
        self.plain += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.plain[:end])
        del self.plain[: end + 2]
        return out

    def take(self, most: int) -> bytes:
        while not self.plain:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.plain[:most])
        del self.plain[:most]
        return out


def read_records(source, chunk: int = CHUNK):
    """Chunk rows (see ``CHUNKS``) of an open archive, with each chunk's bytes."""
    members = _Members(source)
    while (line := members.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while line := members.line():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        kind, _, number = fields["warc-record-id"].removeprefix("<urn:").rstrip(">").partition(":")
        page_id = int(number) if kind == "page" else None
        refers = fields.get("warc-refers-to")
        refers = int(refers.rpartition(":")[2].rstrip(">")) if refers else None
        declared, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
        left = int(fields["content-length"])
        while line := members.line():
            left -= len(line) + 2
        left -= 2
        sha, number, held = hashlib.sha1(), 0, b""
        while True:
            while left and len(held) < chunk:
                got = members.take(min(left, chunk - len(held)))
                held += got
                left -= len(got)
            sha.update(held)
            so_far = _bare(sha)
            if not left and refers is None and so_far != declared:
                raise ValueError(f"record {page_id} does not have its digest")
            yield (page_id, number, len(held), so_far, not left, fields["warc-type"], refers, n, declared), held
            if not left:
                break
            number, held = number + 1, b""


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The chunk rows of every archive; with ``payload`` each chunk's bytes as ``data``."""

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(file)
                with system.open_input_stream(at, compression=None) as source:
                    rows = []
                    for row, data in read_records(source):
                        rows.append((*row, data) if payload else row)
                        if len(rows) == (64 if payload else 4096):
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    files = manifest.select("file").repartition(max(1, manifest.count()))  # a task for each file
    return files.mapInArrow(read, CHUNKS + (", data binary" if payload else ""))


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in CHUNKS.split(", ")] + ["data"]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=False)], names[: len(cols)])


def op7_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), new_path(spark, "warc"))
    return read_archives(manifest).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
