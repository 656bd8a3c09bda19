"""PMC ids of PubMed ids: a join with a table of known ids, and batched look-ups of the rest.

The table keeps what was asked, found or not, so a later run asks for new ids alone. Look-ups run on the executors, an id once however many papers have it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, filled

SCHEMA = "pmid string, pmcid string"
BATCH = 100
READERS = 2


def looked_up(wanted: DataFrame, lookup: Callable[[list[str]], dict[str, str]], batch: int = BATCH, readers: int = READERS) -> DataFrame:
    """(pmid, pmcid) of each wanted pmid, pmcid null where there is none; full batches but for each reader's last."""

    def ask(frames):
        waiting: list[str] = []

        def answers(some: list[str]):
            found = lookup(some)
            return pd.DataFrame({"pmid": some, "pmcid": [found.get(i) for i in some]}, dtype=object)

        for frame in frames:
            waiting += frame["pmid"].tolist()
            while len(waiting) >= batch:
                yield answers(waiting[:batch])
                waiting = waiting[batch:]
        if waiting:
            yield answers(waiting)

    return wanted.select("pmid").coalesce(readers).mapInPandas(ask, SCHEMA)


class IdMap:
    """Known ids as Parquet under ``path``; each addition is a directory that appears by one rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at())

    def known(self) -> DataFrame:
        parts = [p.getPath().toString() for p in self._fs.globStatus(self._at("part-*")) or []]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("pmid").agg(F.max("pmcid").alias("pmcid"))

    def resolve(self, papers: DataFrame, lookup: Callable[[list[str]], dict[str, str]], batch: int = BATCH, readers: int = READERS) -> DataFrame:
        """``papers`` with pmcid filled in where only pmid is there and the map, after asking for what it lacks, has one."""
        lacking = ~filled(F.col("pmcid")) & filled(F.col("pmid"))
        wanted = papers.where(lacking).select("pmid").distinct().join(self.known(), "pmid", "left_anti")
        fresh = f"new-{uuid.uuid4().hex}"
        looked_up(wanted, lookup, batch, readers).write.parquet(f"{self.path}/{fresh}")
        if self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{fresh}").isEmpty():
            self._fs.delete(self._at(fresh), True)
        else:
            self._fs.rename(self._at(fresh), self._at(f"part-{fresh}"))
        known = self.known().where("pmcid is not null").select(F.col("pmid").alias("_pmid"), F.col("pmcid").alias("_pmcid"))
        joined = papers.join(known, papers["pmid"] == known["_pmid"], "left")
        return joined.withColumn("pmcid", F.coalesce(blank_to_null(F.col("pmcid")), F.col("_pmcid"), F.col("pmcid"))).drop("_pmid", "_pmcid")
