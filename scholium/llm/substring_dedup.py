"""Substring dedup by level-wise doubling of word windows.

Words are runs of anything but ASCII white space. A window of ``WINDOW`` words
is judged by a chain of lengths, each twice the one before (13 words: 7, 13;
50 words: 7, 13, 25, 50). At every length but the last only one window in each window of
the next length counts, the one with the smallest hash: the same words choose
alike wherever they stand, so a quarter of the positions speaks for all. Those
that occur in one document alone are done with; the windows of the next
length whose chosen part is repeated go on, until none are left or the asked length is
reached. Longer windows could not remove a word more, so the chain ends there.

At the last length the windows that chose the same part, neighbours in one
run, are judged together first: a run whose every window stands in a smaller
document alike goes at once, and only the smallest document of each different
run has its windows judged one by one. Within copies and shared passages, which are most
of what is repeated, that spares all but one occurrence.

Counts and smallest ids are aggregated before each shuffle and joined back, so
that the engine can split a passage which a third of all documents share; what
returns to a document is bounded by its own length. The first levels' keys
are 48 bits of a hash and only filter; what is removed is decided by
the 64 bits of the chosen part with the 64 bits of the window.

Defined results: a null text has no words; a document with fewer words than the window keeps all; a
null id comes after all others; rows with the same id do not remove each other's
words; equal rows have equal results; an empty table gives none; other
columns are carried along, and those called like a new one give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, remove, table, written

WINDOW = 13
SHORTEST = 7
SLICE = 1 << 18
LAST = (1 << 63) - 1


def chain(window: int, shortest: int = SHORTEST) -> list[int]:
    """The lengths, each at most twice the one before, that end in ``window``."""
    out = [window]
    while out[0] > shortest and (half := -(-out[0] // 2)) >= min(shortest, window):
        out.insert(0, half)
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of a pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b << np.uint64(31) | b >> np.uint64(33))
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _shifted(h: np.ndarray, by: int, how) -> np.ndarray:
    """how(h[p], h[p + by]); places too near the end keep what they have."""
    if not by or by >= len(h):
        return h.copy()
    out = h.copy()
    out[:-by] = how(h[:-by], h[by:])
    return out


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of the words from each place on, by doubling; what runs over an end of the array means nothing."""
    h, have = words, 1
    while have * 2 <= length:
        h, have = _shifted(h, have, _mixed), have * 2
    return _shifted(h, length - have, _mixed) if have < length else h


def chosen(h: np.ndarray, among: int) -> np.ndarray:
    """For each place the first of the ``among`` places from there on with the smallest hash."""
    least, have = h, 1
    while have * 2 <= among:
        least, have = _shifted(least, have, np.minimum), have * 2
    least = _shifted(least, among - have, np.minimum)
    at = np.arange(len(h))
    out = at.copy()
    for j in range(among - 1, -1, -1):
        ahead = np.minimum(at + j, len(h) - 1)
        out = np.where(h[ahead] == least, ahead, out)
    return out


class Words:
    """Several texts' words as hashes in one array, with each word's distance to its text's end."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = pc.list_flatten(split)
        parents = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        real = pc.not_equal(pc.binary_length(flat), 0)
        coded = flat.filter(real).dictionary_encode()
        self.text = parents[real.to_numpy(zero_copy_only=False)]
        different = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        self.hash = different[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64)
        self.count = np.bincount(self.text, minlength=len(texts))
        self.start = np.cumsum(self.count) - self.count
        self.left = (self.start + self.count)[self.text] - np.arange(len(self.text))


def _within(values: np.ndarray, owner: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Whether each value is in its owner's list."""
    out = np.zeros(len(values), bool)
    edges = np.searchsorted(owner, np.arange(len(lists) + 1))
    for i, known in enumerate(lists):
        if len(known):
            out[edges[i] : edges[i + 1]] = np.isin(values[edges[i] : edges[i + 1]], known)
    return out


def _key(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(16)).astype(np.int64)


def _alive(words: Words, lengths: list[int], level: int, known: list[np.ndarray] | None) -> np.ndarray:
    """Places whose window of this level's length has a repeated choice, and is within its text."""
    fits = words.left >= lengths[level]
    if known is None:
        return fits
    part = window_hashes(words.hash, lengths[level - 1])
    pick = chosen(part, lengths[level] - lengths[level - 1] + 1)
    return fits & _within(_key(part[pick]), words.text, known)


def _filter_rows(words: Words, lengths: list[int], level: int, known):
    """(text, key) of the different choices that this level's windows make, for the windows of the next length that may still be repeated."""
    length, following = lengths[level], lengths[level + 1]
    alive = _alive(words, lengths, level, known)
    h = window_hashes(words.hash, length)
    among = following - length + 1
    every = alive & (words.left >= following)
    for j in range(1, among):
        every &= np.r_[alive[j:], np.zeros(min(j, len(alive)), bool)] if j < len(alive) else False
    at = np.unique(chosen(h, among)[every])
    pairs = np.unique(np.rec.fromarrays([words.text[at], _key(h[at])], names="t,k"))
    return pairs.t, pairs.k


def _runs(words: Words, lengths: list[int], known):
    """Runs of windows of the last length that chose the same part: (text, part, signature, first word, windows' hashes, edges)."""
    level = len(lengths) - 1
    alive = _alive(words, lengths, level, known)
    h = window_hashes(words.hash, lengths[-1])
    if level:
        part = window_hashes(words.hash, lengths[-2])
        pick = chosen(part, lengths[-1] - lengths[-2] + 1)
    else:
        part, pick = h, np.arange(len(h))
    at = np.flatnonzero(alive)
    new = np.r_[True, (pick[at[1:]] != pick[at[:-1]]) | (at[1:] != at[:-1] + 1)] if len(at) else np.zeros(0, bool)
    edges = np.r_[np.flatnonzero(new), len(at)]
    first = at[edges[:-1]]
    place = (np.arange(len(at)) - np.repeat(edges[:-1], np.diff(edges))).astype(np.uint64)
    salted = _mixed(h[at] + place, h[at] ^ (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    signature = np.add.reduceat(salted, edges[:-1]) if len(first) else np.empty(0, np.uint64)
    signature = _mixed(signature, np.diff(edges).astype(np.uint64))
    return words.text[first], part[pick[first]].view(np.int64), signature.view(np.int64), first - words.start[words.text[first]], h[at].view(np.int64), edges


def _slices(batch: pa.RecordBatch, text_at: int):
    """Parts of a batch of about SLICE bytes of text, or one row that is longer."""
    size = pc.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > SLICE * 8:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.int64) if v is not None else np.empty(0, np.int64) for v in (x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column)]


def _filtering(lengths: list[int], level: int):
    def run(batches):
        for batch in batches:
            for part in _slices(batch, 1):
                words = Words(part.column(1))
                text, key = _filter_rows(words, lengths, level, _lists(part.column(2)) if level else None)
                rid = part.column(0).to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(key, pa.int64())], ["rid", "key"])

    return run


def _judging(lengths: list[int]):
    def run(batches):
        for batch in batches:
            for part in _slices(batch, 1):
                words = Words(part.column(1))
                text, piece, signature, first, hashes, edges = _runs(words, lengths, _lists(part.column(2)) if len(lengths) > 1 else None)
                rid, key = (part.column(i).to_numpy(zero_copy_only=False)[text] for i in (0, 3))
                values = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(hashes, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(signature), pa.array(key, pa.int64()), pa.array(rid, pa.int64()), pa.array(first, pa.int32()), values], ["part", "run", "id", "rid", "first", "windows"])

    return run


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, rid, text): the same for equal rows, wherever and whenever they are read."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST))
    return docs.select(ident.alias("id"), F.xxhash64(ident, whole).alias("rid"), whole.alias("text"))


def removed_windows(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rid, first, n): the n windows from word ``first`` on stand in a document with a smaller id too."""
    spark = docs.sparkSession
    rows = _keyed(docs, key, text)
    lengths, known, paths = chain(window), None, []

    def joined():
        if known is None:
            return rows.select("rid", "text", F.lit(None).cast("array<long>").alias("known"), "id")
        return rows.join(known, "rid").select("rid", "text", "known", "id")

    for level in range(len(lengths) - 1):
        keys = joined().mapInArrow(_filtering(lengths, level), "rid long, key long")
        if level == 0:
            keys, path = written(keys, "repeat-keys")
            paths.append(path)
        repeated = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        repeated, path = written(repeated, "repeat-found")
        paths.append(path)
        release(spark)
        known = keys.join(repeated, "key").groupBy("rid").agg(F.collect_list("key").alias("known"))
        if level + 2 < len(lengths):
            known, again = written(known, "repeat-known")
    found = joined().mapInArrow(_judging(lengths), "part long, run long, id long, rid long, first int, windows array<long>")
    found, found_path = written(found, "repeat-runs")
    keys = repeated = known = None
    for path in paths:
        remove(spark, path)
    release(spark)

    # tables of their own, so that the joins below can split a hot run
    least, least_path = written(found.groupBy("part", "run").agg(F.min("id").alias("least")), "repeat-least")
    marked = found.join(least, ["part", "run"]).withColumn("whole", F.col("id") > F.col("least"))
    marked = marked.select("part", "id", "rid", "first", "whole", F.size("windows").alias("n"), F.when(~F.col("whole"), F.col("windows")).alias("windows"))
    marked, _ = written(marked, "repeat-marked")
    for path in (found_path, least_path):
        remove(spark, path)
    release(spark)

    single = marked.where("not whole").select("part", "id", "rid", "first", F.posexplode("windows").alias("at", "hash"))
    least, _ = written(single.groupBy("part", "hash").agg(F.min("id").alias("least")), "repeat-least")
    single = single.join(least, ["part", "hash"]).where("id > least").select("id", "rid", (F.col("first") + F.col("at")).alias("first"), F.lit(1).alias("n"))
    return marked.where("whole").select("id", "rid", "first", "n").unionByName(single)


def _cutting(window: int, text_at: int, spans_at: int):
    """Adds the words kept, joined by a space, their counts and the removed ranges of words."""

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(text_at), batch.column(spans_at)
            n_words, n_removed, kept, ranges = [], [], [], []
            for text, span in zip(texts, spans, strict=True):
                words = (text.as_py() or "").encode().split()
                gone = []
                if span.is_valid and len(span):
                    some = span.values
                    first, n = (some.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + n - 1 + window, -1)
                    cover = np.r_[False, np.cumsum(step[:-1]) > 0, False]
                    turns = np.flatnonzero(cover[1:] != cover[:-1]).tolist()
                    gone = list(zip(turns[::2], turns[1::2], strict=True))
                left, parts = 0, []
                for begin, end in gone:
                    parts += words[left:begin]
                    left = end
                n_words.append(len(words))
                n_removed.append(sum(e - b for b, e in gone))
                kept.append(b" ".join(parts + words[left:]).decode())
                ranges.append([{"begin": b, "end": e} for b, e in gone])
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(ranges, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
            old = [c for i, c in enumerate(batch.columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays([*old, *new], [f"c{i}" for i in range(len(old))] + ["n_words", "n_removed", "kept_text", "removed"])

    return run


NEW = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))]


def deduplicated(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_words, n_removed, kept_text and removed (ranges of words, ends exclusive)."""
    spark = docs.sparkSession
    gone = removed_windows(docs, window, key, text).groupBy("id", "rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    gone, _ = written(gone.select(F.col("id").alias("g_id"), F.col("rid").alias("g_rid"), "spans"), "repeat-gone")
    release(spark)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    at = docs.columns.index(text)
    whole = F.coalesce(F.col(f"c{at}"), F.lit(""))
    ident = F.coalesce(F.col(f"c{docs.columns.index(key)}").cast("long"), F.lit(LAST))
    both = plain.join(gone, (ident == F.col("g_id")) & (F.xxhash64(ident, whole) == F.col("g_rid")), "left").select(*plain.columns, "spans")
    out = both.mapInArrow(_cutting(window, at, len(plain.columns)), T.StructType([*plain.schema.fields, *NEW]))
    names = {f.name for f in NEW}
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in names), *(f.name for f in NEW))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
