"""Exact dedup by distributed most-significant-digit radix partitioning.

Texts are equal when identical after lower-casing A-Z. The first digit is the
length in bytes with the first ``HEAD`` bytes; each further round splits the
groups that still have several members by the next bytes, in widening digits.
A group of one row is finished, and so is a group whose bytes are at an end:
its members have been compared byte by byte, so equality needs no digest.

Only groups of two or more go on, so the rounds after the first touch no more
than the copies and what starts like them at the same length. A group is named
by its smallest row number, and rows find their group by joining the counted
groups, which are partly aggregated before the shuffle; a group that holds a
third of all rows is split by the engine's skew join or broadcast, never
gathered into one task.

Defined results: a null text counts as empty; a row with a null doc_id takes
part like any other and is its group's keeper only if no id is there; of rows
that repeat doc_id and text exactly one is kept; an empty table gives an empty
result; further columns are carried along untouched.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, fresh, remove, table, written

HEAD = 64
WIDTH = 1024
GROWTH = 16


def _digits(text_at: int, head: int):
    """Adds the digest that is reported, the length in bytes and the first bytes of each text."""

    def run(batches):
        for batch in batches:
            raw = batch.column(text_at)
            text = pc.ascii_lower(pc.fill_null(raw, "")).cast(pa.binary())
            values = text.to_pylist()
            sha = pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
            size = pa.array([len(v) for v in values], pa.int64())
            start = pa.array([v[:head] for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, sha, size, start], [*(f"c{i}" for i in range(batch.num_columns)), "sha", "size", "start"])

    return run


def numbered(docs: DataFrame, text: str = "text", head: int = HEAD) -> tuple[DataFrame, dict[str, str], str]:
    """``docs`` as a written table with a row number, digest, byte length and first bytes."""
    sha, size, start, rid = fresh(docs, "sha", "size", "start", "rid")
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    schema = T.StructType([*plain.schema.fields, T.StructField("sha", T.StringType()), T.StructField("size", T.LongType()), T.StructField("start", T.BinaryType())])
    out = plain.mapInArrow(_digits(docs.columns.index(text), head), schema).toDF(*docs.columns, sha, size, start)
    out, path = written(out.withColumn(rid, F.monotonically_increasing_id()), "exact-rows")
    return out, {"sha": sha, "size": size, "start": start, "rid": rid}, path


def classes(rows: DataFrame, at: dict[str, str], text: str = "text", head: int = HEAD, width: int = WIDTH, growth: int = GROWTH) -> DataFrame:
    """(rid, gid): the group of each row that has an equal; gid is the group's smallest row number."""
    spark = rows.sparkSession
    rid, size, start = (F.col(at[k]) for k in ("rid", "size", "start"))
    groups = rows.groupBy(size.alias("g_size"), start.alias("g_start")).agg(F.count("*").alias("g_n"), F.min(rid).alias("gid")).where("g_n > 1")
    groups, groups_path = written(groups.select("g_size", "g_start", "gid"), "exact-groups")
    binary = F.encode(ascii_lower(F.col(f"`{text}`")), "UTF-8")
    ended = F.col("g_size") <= head
    # the same plan at every size: were the groups broadcast while they are few, the shuffle of the texts would set in later
    live = rows.join(groups.hint("merge"), (size == F.col("g_size")) & (start == F.col("g_start"))).select(
        rid.alias("rid"), "gid", F.col("g_size").alias("size"), ended.alias("ended"), F.when(~ended, F.substring(binary, head + 1, 1 << 30)).alias("rest")
    )
    live, _ = written(live, "exact-live")
    remove(spark, groups_path)
    done, offset = [], head
    while True:
        done.append(live.where("ended").select("rid", "gid"))
        going = live.where("not ended")
        if going.isEmpty():
            break
        rest = F.col("rest")
        keyed = going.select("rid", F.col("gid").alias("parent"), "size", F.substring(rest, 1, width).alias("digit"), F.substring(rest, width + 1, 1 << 30).alias("rest"))
        split = keyed.groupBy("parent", "digit").agg(F.count("*").alias("n"), F.min("rid").alias("gid")).where("n > 1").select("parent", "digit", "gid")
        split, split_path = written(split, "exact-split")  # a table of its own, so that the join below can split a hot group
        offset += width
        ended = F.col("size") <= offset
        next_live = keyed.join(split, ["parent", "digit"]).select("rid", "gid", "size", ended.alias("ended"), F.when(~ended, F.col("rest")).alias("rest"))
        width *= growth
        live, _ = written(next_live, "exact-live")
        remove(spark, split_path)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def resolve(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and keep_id, group_size, kept, text_sha256; columns of those names give way."""
    rows, at, _ = numbered(docs, text)
    member = classes(rows, at, text)
    rid = F.col(at["rid"])
    ids = rows.select(rid.alias("rid"), F.col(f"`{key}`").alias("id"))
    member, _ = written(member, "exact-member")
    best = member.join(ids, "rid").groupBy("gid").agg(F.max(F.struct("id", "rid")).alias("best"), F.count("*").alias("n"))
    info = member.join(best, "gid").select(F.col("rid").alias("m_rid"), F.col("best.id").alias("m_id"), F.col("best.rid").alias("m_best"), F.col("n").alias("m_n"))
    info, _ = written(info, "exact-info")
    m_rid, m_id, m_best, m_n = fresh(rows, "m_rid", "m_id", "m_best", "m_n")
    joined = rows.join(info.toDF(m_rid, m_id, m_best, m_n), rid == F.col(m_rid), "left")
    alone = F.col(m_rid).isNull()
    new = {"keep_id": F.when(alone, F.col(f"`{key}`")).otherwise(F.col(m_id)), "group_size": F.coalesce(F.col(m_n), F.lit(1)).cast("long"), "kept": alone | (rid == F.col(m_best)), "text_sha256": F.col(at["sha"])}
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    flag = fresh(docs, "kept")[0]
    marked = docs if "kept" not in docs.columns else docs.withColumnRenamed("kept", flag)
    clash = [c for c in ("keep_id", "group_size", "text_sha256") if c in docs.columns]
    for c in clash:
        marked = marked.withColumnRenamed(c, f"{flag}_{c}")
    out = resolve(marked, key, text).where("kept")
    back = {flag: "kept"} | {f"{flag}_{c}": c for c in clash}
    return out.select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in marked.columns))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return resolve(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
