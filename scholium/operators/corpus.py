"""A corpus as versioned Parquet tables: add, get, list, search, statistics.

A version is a list of directories: a whole table and the additions since, each of which
overrides what came before it. Adding papers writes those papers alone; after ``ADDITIONS`` of
them, or when they have as many rows as ``SHARE`` of the table, the next write puts all together.
Every write makes a directory and then a pointer, a file that lists the version's directories, with the next
number; the highest number is the version in use. A pointer appears by one rename and none is
ever replaced, so a reader never sees half a version nor none, a crash leaves the version
before, and of two writers that started from the same version the later one is refused.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorpusError
from ..functions.metadata import flat_authors
from ..functions.text import contains_any_case
from ..schema import PAPERS

POINTER = "CURRENT-"
ADDITIONS = 16
SHARE = 0.1
GRACE = 3600


def upsert(existing: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """Rows of ``new``, and those of ``existing`` whose key is not among them."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _path(field: str) -> str | None:
    """The path of a key in open metadata: keys and numbers of list items with dots between; none can be written for a key with both kinds of quotes."""
    out = "$"
    for i, part in enumerate(field.split(".")):
        quote = "'" if '"' in part else '"'
        if quote in part:
            return None
        out += f"[{part}]" if i and part.isdigit() else f"[{quote}{part}{quote}]"
    return out


def open_text(field: str, column: str = "extra") -> Column:
    """What open metadata has under a path, as text: lists and records as JSON, null where there is nothing."""
    path = _path(field)
    if path is None:
        return F.lit(None).cast("string")
    return F.coalesce(F.try_variant_get(column, path, "string"), F.to_json(F.try_variant_get(column, path, "variant")))


def search(papers: DataFrame, query: str, field: str = "title") -> DataFrame:
    """Papers whose field contains the query in any case; lists are searched as joined text. What is no column is sought in open metadata; no paper has an unknown field."""
    if field not in papers.columns:
        return papers.where(contains_any_case(open_text(field), query)) if "extra" in papers.columns else papers.where(F.lit(False))
    column = F.array_join(field, ", ") if papers.schema[field].dataType.typeName() == "array" else F.col(field)
    return papers.where(contains_any_case(column, query))


def by_date(papers: DataFrame, start: str | None = None, end: str | None = None, field: str = "publication_date") -> DataFrame:
    """Papers within a range of ISO dates; either end may be open."""
    if start:
        papers = papers.where(F.col(field) >= start)
    return papers.where(F.col(field) <= end) if end else papers


def in_categories(papers: DataFrame, categories: list[str], field: str = "category") -> DataFrame:
    """Papers of any of the categories, or all papers if there are none."""
    some = papers.where(F.col(field).isin(categories))
    none = some.limit(1).agg((F.count("*") == 0).alias("_none"))
    rest = papers.crossJoin(F.broadcast(none)).where("_none").drop("_none")
    return some.unionByName(rest)


def get(papers: DataFrame, paper_id: str) -> DataFrame:
    found = papers.where(F.col("paper_id") == paper_id)
    return found


def statistics(papers: DataFrame, files: DataFrame) -> DataFrame:
    """One row: papers, size of their files in MB, first and last change."""
    count = papers.agg(F.count("*").alias("total_papers"))
    size = files.agg(F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 4).alias("corpus_size_mb"), F.min("modified").alias("creation_date"), F.max("modified").alias("last_updated"))
    return count.crossJoin(F.broadcast(size))


def unique(rows: DataFrame, key: str = "paper_id") -> DataFrame:
    """One row a key: for a batch that may hold a key several times, the largest row by all its columns."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.to_json(F.struct(*others))).alias("_row")).select(key, "_row.*")


class Corpus:
    """A directory of versions; the ``CURRENT-`` file of the highest number names the one in use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _number(self) -> int:
        """The number of the pointer in use, 0 if there is none."""
        names = [f.getPath().getName() for f in self._fs.globStatus(self._at(f"{POINTER}*")) or []]
        return max((int(n.removeprefix(POINTER)) for n in names), default=0)

    def _parts(self, number: int) -> list[str]:
        """The directories of a version, the oldest first."""
        return [r[0] for r in self.spark.read.text(str(self._at(f"{POINTER}{number:012d}"))).collect() if r[0]] if number else []

    def _read(self, number: int) -> DataFrame:
        parts = self._parts(number)
        if not parts:
            return self.spark.createDataFrame([], PAPERS)
        whole, *added = (self.spark.read.schema(PAPERS).parquet(f"{self.path}/{p}") for p in parts)
        if not added:
            return whole
        later = added[0].withColumn("_age", F.lit(0))
        for age, rows in enumerate(added[1:], 1):
            later = later.unionByName(rows.withColumn("_age", F.lit(age)))
        others = [c for c in whole.columns if c != "paper_id"]
        later = later.groupBy("paper_id").agg(F.max_by(F.struct(*others), "_age").alias("_row")).select("paper_id", "_row.*")
        return whole.join(later.select("paper_id"), "paper_id", "left_anti").unionByName(later)

    def papers(self) -> DataFrame:
        return self._read(self._number())

    def _point(self, version: str, number: int, before: list[str] = ()) -> None:
        """Make the directories ``before`` and ``version`` the version of a number that none has."""
        fresh = self._at(f".{version}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray("\n".join([*before, version]).encode()))
        stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._at(f"{POINTER}{number:012d}")), options)
        except Py4JJavaError as e:
            self._fs.delete(fresh, False)
            raise CorpusError(f"{self.path} was written by another since this write began") from e

    def _made(self, papers: DataFrame) -> str:
        """A directory with the papers in the corpus's columns; what has none becomes open metadata."""
        known = {f.name for f in PAPERS}
        others = [c for c in papers.columns if c not in known]
        if others:
            kept = [F.col("extra")] if "extra" in papers.columns else []
            papers = papers.withColumn("extra", F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in others), *kept)))
        version = f"v-{uuid.uuid4().hex}"
        papers.select(*((F.col(f.name) if f.name == "extra" else F.col(f.name).cast(f.dataType)).alias(f.name) if f.name in papers.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PAPERS)).write.parquet(f"{self.path}/{version}")
        return version

    def _rows(self, parts: list[str]) -> int:
        return self.spark.read.schema(PAPERS).parquet(*(f"{self.path}/{p}" for p in parts)).count() if parts else 0

    def write(self, papers: DataFrame, base: int | None = None) -> None:
        """Make ``papers`` the current version; refused if that is no longer number ``base``, by default the one of now."""
        base = self._number() if base is None else base
        self._point(self._made(papers), base + 1)

    def add(self, new: DataFrame) -> None:
        """Insert or overwrite by paper_id; within a batch one row of an id stays. Columns that papers lack are kept as open metadata."""
        base = self._number()
        parts = self._parts(base)
        version = self._made(unique(new))
        added = [*parts[1:], version]
        if parts and (len(added) > ADDITIONS or self._rows(added) > SHARE * self._rows(parts[:1])):
            rows = self.spark.read.schema(PAPERS).parquet(f"{self.path}/{version}")
            self._point(self._made(upsert(self._read(base), rows)), base + 1)
            self._fs.delete(self._at(version), True)
        else:
            self._point(version, base + 1, parts)

    def add_json(self, rows: DataFrame) -> None:
        """Papers of (paper_id, metadata), the latter a JSON object: its keys that have columns fill them, and all of it is kept as open metadata."""
        plain = [f for f in PAPERS if f.name not in ("paper_id", "extra")]
        known = F.from_json("metadata", T.StructType(plain))
        value = lambda name: flat_authors(known[name]) if name == "authors" else known[name]
        self.add(rows.select("paper_id", *(value(f.name).alias(f.name) for f in plain), F.parse_json("metadata").alias("extra")))

    def expire(self, keep: int = 10, grace: float = GRACE) -> int:
        """Delete all but the last ``keep`` pointers, and directories that none of those names and that are older than ``grace`` seconds; how many directories."""
        numbers = sorted(int(f.getPath().getName().removeprefix(POINTER)) for f in self._fs.globStatus(self._at(f"{POINTER}*")) or [])
        for number in numbers[:-keep]:
            self._fs.delete(self._at(f"{POINTER}{number:012d}"), False)
        named = {p for n in numbers[-keep:] for p in self._parts(n)}
        gone = [f for f in self._fs.globStatus(self._at("v-*")) or [] if f.getPath().getName() not in named and f.getModificationTime() <= (time.time() - grace) * 1000]
        for f in gone:
            self._fs.delete(f.getPath(), True)
        return len(gone)

    def list(self) -> DataFrame:
        return self.papers().select("paper_id")

    def get(self, paper_id: str) -> dict:
        row = get(self.papers(), paper_id).first()
        if row is None:
            raise CorpusError(f"no paper {paper_id}")
        found = row.asDict(recursive=True)
        extra = found["extra"].toPython() if found.get("extra") is not None else None
        more = extra if isinstance(extra, dict) else {}
        return more | {k: v for k, v in found.items() if v is not None or k not in more} | {"extra": extra}

    def search(self, query: str, field: str = "title") -> DataFrame:
        return search(self.papers(), query, field).select("paper_id")

    def statistics(self, files: DataFrame) -> DataFrame:
        return statistics(self.papers(), files)
