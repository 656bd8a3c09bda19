"""Lexicons of any size: which of many terms each text contains, as substrings.

An automaton over all terms reads a text once, however many terms there are. The terms
are broadcast where they are at most ``BROADCAST_BYTES``; a larger lexicon is dealt into parts of that
size by a hash, each text meets each part, and what the parts found is put together.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written

BROADCAST_BYTES = 32 << 20


def _automaton(terms: list[str]):
    tree = ahocorasick.Automaton()
    for term in terms:
        tree.add_word(term, term)
    tree.make_automaton()
    return tree


def _found(tree, text: str | None) -> list[str]:
    return sorted({term for _, term in tree.iter(text)}) if text and len(tree) else []


def matches(docs: DataFrame, terms: DataFrame, key: str = "paper_id", text: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """(key, terms) of each row of ``docs``: the different terms that its text contains, ascending by code point. ``terms`` has a column term; empty and null ones count for nothing."""
    spark = docs.sparkSession
    lexicon, _ = written(terms.where("term <> ''").select("term").distinct(), "lexicon")
    size = lexicon.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("size")).first().size
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType
    made = T.StructType([T.StructField("key", kind), T.StructField("terms", T.ArrayType(T.StringType()))])
    names = T.StructType([T.StructField(key, kind), T.StructField("terms", T.ArrayType(T.StringType()))])

    def batch_of(keys, found):
        return pa.RecordBatch.from_arrays([keys, pa.array(found, pa.list_(pa.string()))], ["key", "terms"])

    if size <= most:
        shared = spark.sparkContext.broadcast([r.term for r in lexicon.collect()])

        def run(batches):
            tree = _automaton(shared.value)
            for batch in batches:
                yield batch_of(batch.column(0), [_found(tree, t) for t in batch.column(1).to_pylist()])

        return rows.mapInArrow(run, made).toDF(*names.names)

    parts = -(-size // most)
    rows, _ = written(rows.withColumn("row", F.monotonically_increasing_id()), "lexicon-rows")
    dealt = lexicon.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("long").alias("row"), F.col("term").alias("text"))
    asked = rows.select(F.explode(F.sequence(F.lit(0), F.lit(int(parts) - 1))).alias("part"), "row", "text")
    lined = dealt.unionByName(asked).repartitionById(int(parts), F.col("part")).sortWithinPartitions("part", F.col("row").asc_nulls_first())

    def search(batches):
        now, waiting, tree = None, [], None
        for batch in batches:
            numbers, found = [], []
            for part, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, waiting, tree = part, [], None
                if row is None:
                    waiting.append(text)
                    continue
                tree = tree or _automaton(waiting)
                if some := _found(tree, text):
                    numbers.append(row)
                    found.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["row", "terms"])

    some = lined.mapInArrow(search, "row long, terms array<string>").groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("terms"))).alias("terms"))
    return rows.join(some, "row", "left").select(F.col("key").alias(key), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
