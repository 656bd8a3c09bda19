"""How far the sources of each language diverge: term counts by sorted runs, distances of all pairs, marking terms.

A text's terms are runs of letters (anything beyond ASCII counts as one). While
a task reads documents it combines what they repeat and sends sorted partial runs (lang, term, source, block of documents)
with occurrences and documents; the block stands for its documents, none of which is in two. They are
repartitioned by (lang, term) and sorted by (lang, term, source, block), and a scan of run lengths
gives each source's counts and each term's document frequency. So a term that every document holds
sends one row a block and source, not one a document.

Terms in ``LEAST`` documents of a language are kept. A second scan over the kept runs emits partial pairs
and terms: for each two sources that share a term, what their distance differs from
the case that either lacks it, summed up within the task; for each source, its best ``TOP`` terms in
the task. The terms that a source lacks need no rows: all have the same share, and the sums
over a source's own terms against another's share of a term it lacks follow from how many of its
terms have which count. All of it is exact in whole numbers.

Shares are parts of 1,000,000,000: 1 + floor(1e9 * (count + 5) / (N + 5 V)). What is returned has a row for every
ordered pair of a language's sources, as asked; what is held at once in a task is a term's sources
and at most ``HELD`` pairs, which are emitted early beyond that.

Defined results: null text, lang and source count as empty; a group without terms has the shares of
count 0; where no term is kept every distance is 0 and there are no term rows; rows that repeat are documents of their own;
an empty table gives none; further columns are left aside.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, table, written

LEAST = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
HELD = 1 << 20
BLOCK = 1 << 19
#: Every byte as it counts in a term: lower-cased letters and all beyond ASCII, else a space.
LETTERS = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
RUNS = "lang string, term string, source string, block long, n long, docs long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def _partial_runs(block: int):
    """Runs that a block of documents makes: (lang, term, source, block, occurrences, documents)."""

    def out(held: dict, number: int):
        for (lang, source), (total, docs) in held.items():
            if total:
                n = len(total)
                found = pa.array(list(total), pa.binary()).cast(pa.string())
                same = [pa.repeat(pa.scalar(x, t), n) for x, t in ((lang, pa.string()), (source, pa.string()), (number, pa.int64()))]
                counts = [pa.array(x, pa.int64()) for x in (list(total.values()), [docs[t] for t in total])]
                yield pa.RecordBatch.from_arrays([same[0], found, same[1], same[2], *counts], ["lang", "term", "source", "block", "n", "docs"])

    def run(batches):
        from pyspark import TaskContext

        held, size, number = {}, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, docs = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                size -= len(total)
                total.update(found)
                docs.update(set(found))
                size += len(total)
                if size >= block:
                    yield from out(held, number)
                    held, size, number = {}, 0, number + 1
        yield from out(held, number)

    return run


class _Edges:
    """Arrow batches of sorted rows cut at the ends of (lang, term) runs: a run that goes on is kept for the next batch."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []

    def whole(self, batch: pa.RecordBatch) -> pa.Table:
        """The rows of the runs that ended; ``batch`` has rows."""
        key = lambda i: (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
        last = batch.num_rows - 1
        low, high, end = 0, last, key(last)
        while low < high:  # the first row of the last run
            at = (low + high) // 2
            if key(at) == end:
                high = at
            else:
                low = at + 1
        if not low and self.held and end == (self.held[-1].column(0)[-1].as_py(), self.held[-1].column(1)[-1].as_py()):
            self.held.append(batch)
            return pa.Table.from_batches([], batch.schema)
        done = pa.Table.from_batches([*self.held, batch.slice(0, low)], batch.schema).combine_chunks()
        self.held = [batch.slice(low)]
        return done

    def rest(self) -> pa.Table | None:
        return pa.Table.from_batches(self.held).combine_chunks() if self.held else None


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
        for c in columns:
            code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _scan(batches):
    """Sorted partial runs in; (lang, term, source, n, docs of the term in its lang, 1 for a term's first source) out."""
    edges = _Edges()

    def counted(now: pa.Table):
        lang, term, source = (now.column(i).combine_chunks() for i in range(3))
        n, docs = (now.column(i).to_numpy() for i in (4, 5))
        each = _changes(lang, term, source)
        if not len(each):
            return
        whole = _changes(lang, term)
        df = np.add.reduceat(docs, whole)
        of = np.searchsorted(whole, each, side="right") - 1
        first = pa.array(each)
        new = [np.add.reduceat(n, each), df[of], np.isin(each, whole).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([lang.take(first), term.take(first), source.take(first), *map(pa.array, new)], ["lang", "term", "source", "n", "docs", "lead"])

    for batch in batches:
        if batch.num_rows:
            yield from counted(edges.whole(batch))
    if (rest := edges.rest()) is not None:
        yield from counted(rest)


def _sorted_runs(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term", *order)


def term_runs(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, term, source, n, docs, lead): occurrences by source, and the term's documents in the whole language."""
    partial = docs.mapInArrow(_partial_runs(block), RUNS)
    return _sorted_runs(partial, "source", "block").mapInArrow(_scan, "lang string, term string, source string, n long, docs long, lead long")


def share(n, total, terms, div=lambda a, b: a // b):
    """1 + floor(1e9 (n + 5) / (total + 5 terms)) by long division, so that nothing leaves 64 bits; for numbers, arrays and, with ``div``, columns."""
    whole, left, out = total + PRIOR * terms, n + PRIOR, 0
    for _ in range(3):
        out = out * 1000 + div(left * 1000, whole)
        left = left * 1000 % whole
    return out + 1


def _column_share(n, total, terms):
    return share(n, total, terms, lambda a, b: F.call_function("div", a, b))


class _Pairs:
    """Sums for pairs of sources of one language, at most HELD at once."""

    def __init__(self, lang: str):
        self.lang, self.at, self.side = lang, {}, int(HELD**0.5)
        self.sums, self.both = (np.zeros((64, 64), np.int64) for _ in range(2))

    @staticmethod
    def less(p: np.ndarray, p0: np.ndarray, q: np.ndarray, q0: np.ndarray) -> np.ndarray:
        """What a shared term's distance differs from the two that would count if either lacked it."""
        return np.abs(p[:, None] - q[None, :]) - np.abs(p[:, None] - q0[None, :]) - np.abs(p0[:, None] - q[None, :])

    def add(self, sources: list[str], p: np.ndarray, p0: np.ndarray):
        """Sources ascending. Yields what has to go now."""
        new = [s for s in sources if s not in self.at]
        if len(self.at) + len(new) > self.side:
            yield from self.out()
            new = sources
        if len(sources) > self.side:
            for i in range(0, len(sources), self.side):
                for j in range(i, len(sources), self.side):
                    a, b = slice(i, i + self.side), slice(j, j + self.side)
                    yield from self.rows(sources[a], sources[b], self.less(p[a], p0[a], p[b], p0[b]), np.ones((len(p[a]), len(p[b])), np.int64))
            return
        for s in new:
            self.at[s] = len(self.at)
        while len(self.at) > len(self.sums):
            self.sums, self.both = (np.pad(m, (0, len(m))) for m in (self.sums, self.both))
        where = np.array([self.at[s] for s in sources])
        grid = np.ix_(where, where)
        self.sums[grid] += self.less(p, p0, p, p0)
        self.both[grid] += 1

    def rows(self, left: list[str], right: list[str], sums: np.ndarray, both: np.ndarray):
        """A row for each pair that shares a term, the smaller source first (each pair is there both ways)."""
        for i, a in enumerate(left):
            some = [j for j in np.flatnonzero(both[i]).tolist() if right[j] > a]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(some)), pa.array([self.lang] * len(some)), pa.array([a] * len(some)), pa.array([right[j] for j in some]), pa.array(sums[i, some]), pa.array(both[i, some])], PART)

    def out(self):
        names = list(self.at)
        yield from self.rows(names, names, self.sums, self.both)
        self.at = {}
        self.sums, self.both = (np.zeros((64, 64), np.int64) for _ in range(2))


PART = ["part", "lang", "source", "item", "value", "both"]


def _partial_audit(batches):
    """Kept runs in, sorted; partial pairs and all terms that mark a source out."""
    edges, pairs = _Edges(), None

    def audited(now: pa.Table):
        nonlocal pairs
        if not now.num_rows:
            return
        lang, term, source = (now.column(i).combine_chunks() for i in range(3))
        n, p, p0, lang_total, kept = (now.column(i).to_numpy() for i in range(3, 8))
        whole = _changes(lang, term)
        size = np.diff(np.r_[whole, len(n)])
        q = share(np.repeat(np.add.reduceat(n, whole), size), lang_total, kept)
        mark = np.flatnonzero(p > q)
        if len(mark):
            at = pa.array(mark)
            yield pa.RecordBatch.from_arrays([pa.array(["term"] * len(mark)), lang.take(at), source.take(at), term.take(at), pa.array((p - q)[mark]), pa.array(np.ones(len(mark), np.int64))], PART)
        names, langs = source.to_pylist(), lang.take(pa.array(whole)).to_pylist()
        for start, k, here in zip(whole.tolist(), size.tolist(), langs, strict=True):
            if pairs is None or pairs.lang != here:
                if pairs is not None:
                    yield from pairs.out()
                pairs = _Pairs(here)
            if k > 1:
                part = slice(start, start + k)
                yield from pairs.add(names[part], p[part], p0[part])

    for batch in batches:
        if batch.num_rows:
            yield from audited(edges.whole(batch))
    if (rest := edges.rest()) is not None:
        yield from audited(rest)
    if pairs is not None:
        yield from pairs.out()


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to every other of its language, and the terms that mark it."""
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))))
    kept, _ = written(term_runs(rows, block).where(F.col("docs") >= least).select("lang", "term", "source", "n", "lead"), "audit-kept")

    langs = kept.groupBy("lang").agg(F.sum("lead").alias("kept"), F.sum("n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("total", "own", "kept", "lang_total")))
    none = F.when(F.col("kept") > 0, _column_share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(0).cast("long"))
    groups, _ = written(groups.withColumn("p0", none), "audit-groups")

    shares = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", _column_share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "p0", "lang_total", "kept")
    shares, shares_path = written(shares, "audit-shares")
    parts = _sorted_runs(shares, "source").mapInArrow(_partial_audit, "part string, lang string, source string, item string, value long, both long")
    parts, _ = written(parts, "audit-parts")

    counts = shares.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("times")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("counts"))
    counts, _ = written(groups.join(counts, ["lang", "source"], "left"), "audit-counts")
    remove(spark, shares_path)
    side = lambda x: counts.select("lang", "kept", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "own", "p0", "counts")))
    against = lambda counts, p0: F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda sum, c: sum + F.abs(c["p"] - F.col(p0)) * c["times"]), F.lit(0))
    both = side("a").join(side("b").drop("kept"), "lang").where("source_a < source_b")
    shared = parts.where("part = 'pair'").groupBy("lang", F.col("source").alias("source_a"), F.col("item").alias("source_b")).agg(F.sum("value").alias("less"), F.sum("both").alias("both"))
    both = both.join(shared, ["lang", "source_a", "source_b"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("less", "both")})
    apart = against("counts_a", "p0_b") + against("counts_b", "p0_a") + F.col("less") + (F.col("kept") - F.col("own_a") - F.col("own_b") + F.col("both")) * F.abs(F.col("p0_a") - F.col("p0_b"))
    ends = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("ends")
    pairs = both.select("lang", apart.cast("long").alias("value"), ends).select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by))
    marking = parts.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.unionByName(marking)


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = """
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
o as (select lang, source, doc, unnest(ts) as t from d),
k as (select lang, t from o group by 1, 2 having count(distinct doc) >= 30),
v as (select lang, count(*) as v from k group by 1),
c as (select lang, source, t, count(*) as n from o join k using (lang, t) group by 1, 2, 3),
g as (select distinct lang, source from d),
gn as (select lang, source, coalesce(sum(n), 0)::bigint as total from g left join c using (lang, source) group by 1, 2),
p as (select lang, source, t, coalesce(n, 0) as n, 1 + 1000000000 * (coalesce(n, 0) + 5) // (total + 5 * v) as p from gn join v using (lang) join k using (lang) left join c using (lang, source, t)),
l as (select lang, t, 1 + 1000000000 * (sum(n)::bigint + 5) // ((sum(sum(n)) over (partition by lang))::bigint + 5 * any_value(v)) as q from c join v using (lang) group by 1, 2),
pairs as (select a.lang, a.source, b.source as item, coalesce(x.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by 1, 2, 3) x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, t as item, (p - q)::bigint as value from p join l using (lang, t) where n > 0 and p > q),
everything as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms)
select lang, source, part, item, value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from everything) where part = 'pair' or rank <= 50
"""
