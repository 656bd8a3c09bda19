"""Substring search of a corpus through trigrams.

The index is two Parquet tables under a path: ``grams`` (gram, block), sorted by gram, which is a number of its three code points, and
``texts`` (block, paper_id, text), sorted by block; a block is a share of the papers by a hash of the
id. A search reads the blocks that hold every trigram of the question, from the few pages with those grams, then
those blocks' texts, and checks them for the question itself: what it returns is what a scan returns. Questions of
fewer than three characters have no trigram and scan. Blocks, not papers, come to the driver, at most ``BLOCKS``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_any_case

BLOCKS = 4096
#: Rows of a page, the least that is read: many postings, few texts.
GRAMS, TEXTS = 16 << 10, 64
ALTERNATIVES = 256
PIECE = 4 << 20  # bytes of text whose trigrams are sorted at once, and the rest of the last text


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def codes(letters: np.ndarray) -> np.ndarray:
    """The trigrams of code points as one number each; a code point has 21 bits."""
    letters = letters.astype(np.int64)
    return letters[:-2] | letters[1:-1] << 21 | letters[2:] << 42


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _postings(batches):
    """(gram, block) of rows (block, text). Rows of a block that lie together, as the written texts do, give each trigram once."""
    now, held = None, np.empty(0, np.int64)

    def posted():
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), now, np.int32))], ["gram", "block"])

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)) // PIECE
        owner = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero((owner[1:] != owner[:-1]) | (sizes[1:] != sizes[:-1])) + 1).tolist(), len(owner)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if now is not None and owner[lo] != now:
                yield posted()
                held = np.empty(0, np.int64)
            now = int(owner[lo])
            texts = batch.column(1).slice(lo, hi - lo).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            found, inside = codes(_letters("".join(texts))), np.ones(int(ends[-1]), bool)
            last = np.r_[ends - 1, ends - 2]
            inside[last[last >= 0]] = False  # no trigram runs on into the next text
            held = np.union1d(held, found[inside[: len(found)]])
    if now is not None:
        yield posted()


def _any_of(column, values: list[int]):
    """One of few values as alternatives, each of which pages are judged by; a long list is judged by its ends."""
    if len(values) > ALTERNATIVES:
        return column.isin(values)
    return reduce(lambda a, b: a | b, (column == v for v in sorted(values)), F.lit(False))


class SearchIndex:
    """An index of one field of the papers under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, papers: DataFrame, field: str = "abstract", key: str = "paper_id", blocks: int = BLOCKS) -> SearchIndex:
        """Index anew; list fields as their joined text. Trigrams are taken from the written texts, whose blocks lie together, and made distinct by block before and after the shuffle."""
        text = F.array_join(field, ", ") if papers.schema[field].dataType.typeName() == "array" else F.col(field)
        block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")
        rows = papers.select(block.alias("block"), F.col(key).alias("paper_id"), text.alias("text")).where("text is not null")
        write = lambda rows, by, name, page: rows.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").option("parquet.block.size", 1 << 20).option("parquet.page.row.count.limit", page).parquet(f"{self.path}/{name}")
        write(rows, "block", "texts", TEXTS)
        texts = self.spark.read.schema(rows.schema).parquet(f"{self.path}/texts").select("block", F.lower("text").alias("text"))
        write(texts.mapInArrow(_postings, "gram long, block int").distinct(), "gram", "grams", GRAMS)
        return self

    def blocks(self, query: str) -> list[int] | None:
        """Blocks that hold every trigram of the question; None where it has none."""
        wanted = [int(codes(_letters(t))[0]) for t in trigrams(query.lower())]
        if not wanted:
            return None
        grams = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(wanted))
        return [r.block for r in grams.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).collect()]

    def search(self, query: str) -> DataFrame:
        """(paper_id) of the papers whose field contains the question in any case."""
        texts = self.spark.read.parquet(f"{self.path}/texts")
        blocks = self.blocks(query)
        if blocks is not None:
            texts = texts.where(_any_of(F.col("block"), blocks))
        return texts.where(contains_any_case(F.col("text"), query)).select("paper_id")
