"""Document files of a corpus: listing, metadata extraction, fixity manifests."""

from __future__ import annotations

import hashlib
import os
import urllib.parse
import uuid
import xml.etree.ElementTree as ET
from datetime import date, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MetadataError
from ..functions.text import filled

ALGORITHMS = ("sha256", "sha512")
STATE = ".fixity"
FILE = [T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType())]
EXTRACTED = "path string, file_type string, file_size long, title string, abstract string, doi string, authors array<string>, creator string, json string, error string"


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length and modification time of files, without reading their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def paper_files(files: DataFrame) -> DataFrame:
    """(paper_id, kind, path, length, modified) of files called <paper_id>.<kind>."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_extract(name, r"^(.*)\.([^.]+)$", 1).alias("paper_id"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), "path", "length", "modified")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def xml_fields(xml: str, jats: bool = False) -> dict:
    """Title, abstract, doi and authors: the text before the first child of the first such element."""
    root = ET.fromstring(xml)
    out: dict = {}
    for name in ("title", "abstract", "doi"):
        found = root.find(f".//{name}")
        if found is not None:
            out[name] = found.text or ""
    out["authors"] = [a.text for a in root.iter("author") if a.text]
    if jats:
        title, doi = root.find(".//article-title"), root.find('.//article-id[@pub-id-type="doi"]')
        out |= {"title": "".join(title.itertext()).strip() if title is not None else out.get("title"), "doi": doi.text if doi is not None else out.get("doi")}
        names = root.findall('.//contrib[@contrib-type="author"]/name')
        out["authors"] = [" ".join(filter(None, (n.findtext("given-names"), n.findtext("surname")))) for n in names] or out["authors"]
    return out


def pdf_fields(content: bytes) -> dict:
    """What a PDF states of title, author and creator, where PyMuPDF is installed; nothing where it is not or the file is broken."""
    try:
        import fitz
    except ImportError:
        return {}
    try:
        with fitz.open(stream=content, filetype="pdf") as pdf:
            stated = pdf.metadata or {}
    except Exception:  # the library's errors for broken files have no common type
        return {}
    author = stated.get("author")
    return {"title": stated.get("title") or None, "authors": [author] if author else None, "creator": stated.get("creator") or None}


def extract(files: DataFrame, jats: bool = False) -> DataFrame:
    """Metadata of XML, PDF and JSON files given as binaryFile rows; what can't be read has an error instead, and a PDF its path, type and size alone."""

    def run(batches):
        import json

        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content, length in zip(pdf["path"], pdf["content"], pdf["length"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                row = {"path": path, "file_type": kind, "file_size": int(length), "authors": None}
                try:
                    if kind == "xml":
                        row |= xml_fields(bytes(content).decode("utf-8").lstrip(), jats)
                    elif kind == "json":
                        row["json"] = json.dumps(json.loads(bytes(content)), ensure_ascii=False)
                    elif kind == "pdf":
                        row |= pdf_fields(bytes(content))
                    else:
                        row["error"] = f"unsupported file type: {kind}"
                except (ET.ParseError, UnicodeDecodeError, ValueError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXTRACTED.split(", ")]).astype(object)

    return files.select("path", "content", "length").mapInPandas(run, EXTRACTED)


def extract_file(spark: SparkSession, path: str, jats: bool = False) -> dict:
    """Metadata of one file; a missing, broken or unknown one raises MetadataError."""
    if not os.path.isfile(path):
        raise MetadataError(f"no file {path}")
    row = extract(spark.read.format("binaryFile").load(path), jats).first()
    if row.error:
        raise MetadataError(row.error)
    return {k: v for k, v in row.asDict().items() if v is not None}


def digest(content: Column, algorithm: str = "sha256") -> Column:
    return F.sha2(content, int(algorithm.removeprefix("sha")))


class Folder:
    """A directory on whatever file system the session knows its path by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._jvm, self.path = spark, spark.sparkContext._jvm, path.rstrip("/")
        fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = fs.makeQualified(self.at()).toString()
        # a local file system's own writer would leave a checksum file beside every tag file
        self.fs = fs.getRawFileSystem() if fs.getScheme() == "file" else fs

    def at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def replace(self, old: str, new: str) -> None:
        self.fs.delete(self.at(new), True)
        self.fs.rename(self.at(old), self.at(new))

    def write(self, name: str, text: str) -> None:
        """A small file, which appears whole."""
        temporary = f".{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.replace(temporary, name)

    def write_lines(self, name: str, lines: DataFrame) -> None:
        """A file of a column of lines, ascending; one task sorts and writes them, as the format has one file."""
        temporary = f".{uuid.uuid4().hex}"
        lines.coalesce(1).sortWithinPartitions(*lines.columns).write.text(f"{self.path}/{temporary}")
        parts = self.fs.globStatus(self.at(f"{temporary}/part-*"))
        if parts:
            self.fs.delete(self.at(name), True)
            self.fs.rename(parts[0].getPath(), self.at(name))
        else:
            self.write(name, "")
        self.fs.delete(self.at(temporary), True)

    def files(self, name: str) -> DataFrame:
        """(path, length, modified) of all files below, empty ones too, which the binary reader leaves out."""
        rows = listing(self.spark, f"{self.path}/{name}")
        found, empty = self.fs.listFiles(self.at(name), True), []
        while found.hasNext():
            status = found.next()
            if status.getLen() == 0:
                empty.append((status.getPath().toString(), 0, datetime.fromtimestamp(status.getModificationTime() / 1000)))
        return rows.unionByName(self.spark.createDataFrame(empty, "path string, length long, modified timestamp")) if empty else rows

    def relative(self, column: str = "path") -> Column:
        return F.substr(F.col(column), F.lit(len(self.root) + 2))


def _opened(path: str):
    """The file system of a path as the readers spell it, and the path within it."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    fs, inner = pa.fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/@"))
    return fs, urllib.parse.unquote(inner)


def hashed(files: DataFrame, algorithms: tuple[str, ...] = ALGORITHMS, chunk: int = 8 << 20) -> DataFrame:
    """Adds a digest for each algorithm to rows with a path: each file is streamed once, on the executors, whatever its size."""
    columns, at = files.columns, files.columns.index("path")

    def run(batches):
        for batch in batches:
            found: list[list[str]] = [[] for _ in algorithms]
            for path in batch.column(at).to_pylist():
                fs, inner = _opened(path)
                sums = [hashlib.new(a) for a in algorithms]
                with fs.open_input_stream(inner, compression=None) as stream:
                    while block := stream.read(chunk):
                        for s in sums:
                            s.update(block)
                for out, s in zip(found, sums, strict=True):
                    out.append(s.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.string()) for f in found)], [*columns, *algorithms])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, *(T.StructField(a, T.StringType()) for a in algorithms)]))


def write_metadata(papers: DataFrame, bag: str) -> int:
    """<paper_id>_metadata.json of each paper in a bag's payload, written by the executors: the paper's filled columns and open metadata; how many."""
    folder = f"{Folder(papers.sparkSession, bag).root}/data/metadata"

    def run(batches):
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = _opened(f"{folder}/{name.replace('/', '_')}_metadata.json")
                with fs.open_output_stream(inner) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["paper_id"])

    rows = papers.select("paper_id", F.to_json(F.struct(*papers.columns)).alias("text"))
    return rows.mapInArrow(run, "paper_id string").count()


def manifest(spark: SparkSession, bag: str, algorithms: tuple[str, ...] = ALGORITHMS) -> DataFrame:
    """(path, alg, digest, length) of every payload file; each file is read once."""
    folder = Folder(spark, bag)
    rows = hashed(folder.files("data"), algorithms).withColumn("path", folder.relative())
    digests = F.array(*(F.struct(F.lit(a).alias("alg"), F.col(a).alias("digest")) for a in algorithms))
    return rows.select("path", "length", F.explode(digests).alias("d")).select("path", "d.alg", "d.digest", "length")


def payload_oxum(rows: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Bytes and files of a payload as <bytes>.<files>."""
    each = rows.select(path, length).distinct()
    return each.agg(F.concat(F.coalesce(F.sum(length), F.lit(0)).cast("string"), F.lit("."), F.count("*").cast("string")).alias("payload_oxum"))


def fixity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, alg, state): missing, extra or changed files of a payload; none if it is as the manifest says."""
    e, a = expected.select("path", "alg", F.col("digest").alias("was")), actual.select("path", "alg", F.col("digest").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("was") != F.col("now"), "changed")
    return e.join(a, ["path", "alg"], "full").select("path", "alg", state.alias("state")).where(F.col("state").isNotNull())


DOCUMENTS = "data/documents"


class Bag:
    """A payload directory with manifests; opening one that exists changes nothing."""

    #: The folders of the format.
    FOLDERS = ["data/documents/pdf", "data/documents/xml", "data/documents/html", "data/semantic", "data/metadata", "data/keyphrases", "data/indices", "relations", "analysis", "provenance"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def create(self, info: dict[str, str] | None = None) -> Bag:
        for name in self.FOLDERS:
            self.folder.fs.mkdirs(self.folder.at(name))
        if not self.folder.fs.listFiles(self.folder.at("data"), True).hasNext():
            self.folder.write("data/keep", "")
        if not self.folder.exists("bagit.txt"):
            self.folder.write("bagit.txt", "BagIt-Version: 0.97\nTag-File-Character-Encoding: UTF-8\n")
            self.update(info)
        return self

    def state(self) -> DataFrame:
        """What the last update found: (path, length, modified) and digests."""
        schema = T.StructType([*FILE, *(T.StructField(a, T.StringType()) for a in ALGORITHMS)])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{STATE}") if self.folder.exists(STATE) else self.spark.createDataFrame([], schema)

    def update(self, info: dict[str, str] | None = None) -> dict[str, int]:
        """Write the manifests and bag-info; only files that are new, or of another length or time than at the
        last update, are read (``valid`` reads them all). How many files and bytes were."""
        found = self.folder.files("data").withColumn("path", self.folder.relative())
        known, same = self.state(), ["path", "length", "modified"]
        new = found.join(known, same, "left_anti")
        read = hashed(new.withColumn("path", F.concat(F.lit(self.folder.root + "/"), "path"))).withColumn("path", self.folder.relative())
        fresh = f".fixity-{uuid.uuid4().hex}"
        read.withColumn("_read", F.lit(True)).unionByName(known.join(found, same, "left_semi"), allowMissingColumns=True).write.parquet(f"{self.path}/{fresh}")
        rows = self.spark.read.parquet(f"{self.path}/{fresh}")
        for alg in ALGORITHMS:
            self.folder.write_lines(f"manifest-{alg}.txt", rows.select(F.concat_ws("  ", alg, "path").alias("value")))
        total = rows.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"), F.count("_read").alias("read"), F.coalesce(F.sum(F.when(F.col("_read"), F.col("length"))), F.lit(0)).alias("read_bytes")).first()
        tags = self.info() | (info or {}) | {"Bagging-Date": date.today().isoformat(), "Payload-Oxum": f"{total.bytes}.{total.files}"}
        self.folder.write("bag-info.txt", "".join(f"{k}: {v}\n" for k, v in tags.items()))
        names = ["bag-info.txt", "bagit.txt", *(f"manifest-{a}.txt" for a in ALGORITHMS)]
        own = hashed(self.spark.createDataFrame([(f"{self.folder.root}/{n}",) for n in names], "path string")).collect()
        for alg in ALGORITHMS:
            self.folder.write(f"tagmanifest-{alg}.txt", "".join(f"{r[alg]} {r.path.rsplit('/', 1)[1]}\n" for r in sorted(own, key=lambda r: r.path)))
        self.folder.replace(fresh, STATE)
        return {"files": total.read, "bytes": total.read_bytes}

    def expected(self) -> DataFrame:
        """The manifests as a table."""
        lines = self.spark.read.text([f"{self.path}/manifest-{a}.txt" for a in ("sha256", "sha512")], wholetext=False).select("value", F.regexp_extract(F.input_file_name(), r"manifest-(\w+)\.txt", 1).alias("alg"))
        return lines.where(filled(F.col("value"))).select(F.regexp_extract("value", r"^(\S+)\s+(.*)$", 2).alias("path"), "alg", F.regexp_extract("value", r"^(\S+)", 1).alias("digest"))

    def differences(self) -> DataFrame:
        return fixity(self.expected(), manifest(self.spark, self.path))

    def valid(self) -> bool:
        return self.folder.exists("manifest-sha256.txt") and self.differences().isEmpty()

    def info(self) -> dict[str, str]:
        if not self.folder.exists("bag-info.txt"):
            return {}
        lines = [r.value for r in self.spark.read.text(f"{self.path}/bag-info.txt").collect()]
        return dict(x.split(": ", 1) for x in lines if ": " in x)

    def full_texts(self) -> DataFrame:
        """(paper_id, kind, length) of the documents in the payload."""
        return paper_files(listing(self.spark, f"{self.path}/{DOCUMENTS}", "*.*")).select("paper_id", "kind", "length")

    def report(self) -> dict:
        return {"date": date.today().isoformat(), "path": self.path, "is_valid": self.valid(), "bag_info": self.info()}
