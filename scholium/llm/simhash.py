"""SimHash near-duplicates by a segment-popcount embedding and a grid join.

A fingerprint is cut into segments of ``SEGMENT`` bits, and each segment is
replaced by its number of set bits. The Manhattan distance of two such vectors
is a lower bound of the fingerprints' Hamming distance, so links at ``BITS``
or fewer differing bits are found among vectors at Manhattan distance BITS or
less. The segments form ``GROUPS`` groups, of which a linked pair differs in BITS at most, so
it has the same counts throughout some GROUPS - BITS of them. Each such choice of groups
is a grid, whose cells are the counts of its groups: a fingerprint is entered in one cell of
each of the 70 grids, and every linked pair meets in a cell. There the range condition of the
join is the Manhattan distance of all their counts; those within it are verified by their exact Hamming distance. Two random fingerprints share a cell with a probability
of 1 in 90,000.

Copies share a fingerprint and enter the grids once. A cell emits links that
join what is not yet joined in it, at most one less than it has members. A cell
of more than ``TILE`` members is dealt anew in tiles of pairs of its blocks,
so no task takes an unbounded group. Components come from the link table.

Defined results: a null or empty text, or one of white space, has fingerprint zero,
which links like any other; a row with a null doc_id gets its fingerprint but
no component; repeated rows share a component; an empty table gives none. ``deduplicated``
goes by rows: of each component the row of the smallest doc_id stays, any with one before those without.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, written
from .components import components

WORDS = 4
BITS = 4
SEED = 42
SEGMENT = 2
GROUPS = 8
TILE = 8192
SMALL = 8
CHUNK = 1 << 21


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text's word shingles."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    width = min(words, len(found))
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(stops), 1 << 16):
        part = range(at, min(at + (1 << 16), len(stops)))
        h = np.fromiter((digest(joined[starts[i] : stops[i]], seed) for i in part), dtype="<u8", count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


def embed(fps: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Set bits of each segment, a row for each fingerprint."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), -1, segment).sum(axis=2, dtype=np.int64)


def unary(fps: np.ndarray) -> np.ndarray:
    """Each two-bit segment's count in unary: as many bits differ in two of these as is the Manhattan distance of their counts."""
    low = np.uint64(0x5555555555555555)
    a, b = fps & low, (fps >> np.uint64(1)) & low
    return a | b | (a & b) << np.uint64(1)


def cells(fps: np.ndarray, segment: int = SEGMENT, groups: int = GROUPS, bits: int = BITS) -> np.ndarray:
    """The cell of each fingerprint in each grid, a row for each fingerprint."""
    counts = embed(fps, segment)
    parts = np.array_split(np.arange(counts.shape[1]), groups)
    code = np.column_stack([counts[:, p] @ (segment + 1) ** np.arange(len(p)) for p in parts])
    width = (segment + 1) ** max(map(len, parts))
    chosen = np.array(list(combinations(range(groups), groups - bits)))
    place = width ** np.arange(groups - bits)
    if len(chosen) * int(place[-1]) * width > 1 << 62:
        raise ValueError("these groups' cells need more than 62 bits")
    return code[:, chosen] @ place + np.arange(len(chosen)) * (int(place[-1]) * width)


class Joined:
    """Labels of a cell's members, and the links that joined them."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def meet(self, i: int, others: np.ndarray) -> None:
        mine = self.label[i]
        roots, first = np.unique(self.label[others], return_index=True)
        for root, at in zip(roots, first, strict=True):
            if root != mine:
                self.links.append((i, int(others[at])))
        self.label[np.isin(self.label, roots)] = mine


def _block_links(fps: np.ndarray, rows: np.ndarray, own: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links between ``rows`` and ``own`` (positions in fps) that join what was apart."""
    joined, counts = Joined(len(fps)), unary(fps)
    step = max(1, CHUNK // max(1, len(own)))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        near = np.bitwise_count(counts[part][:, None] ^ counts[own][None, :]) <= bits
        i, j = np.nonzero(near)
        near[i, j] = np.bitwise_count(fps[part[i]] ^ fps[own[j]]) <= bits
        for k in np.flatnonzero(near.any(axis=1)):
            others = own[near[k]]
            joined.meet(int(part[k]), others[others != part[k]])
    return joined.links


def _cell_links(cell: np.ndarray, fps: np.ndarray, reps: np.ndarray, bits: int):
    """Links of rows sorted by cell: pairs of small cells at once, larger cells by blocks."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    a, b = [], []
    small = (sizes <= SMALL) & (sizes > 1)
    if small.any():
        counts = unary(fps)
        s, z = starts[small], sizes[small]
        rows = np.repeat(s, z) + (np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z))
        n = np.repeat(s + z, z) - rows - 1
        edges = np.r_[0, np.cumsum(n)]
        begin = 0
        while begin < len(rows):
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + CHUNK, side="right")) - 1)
            m = n[begin:end]
            left = np.repeat(rows[begin:end], m)
            right = left + 1 + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
            near = np.bitwise_count(counts[left] ^ counts[right]) <= bits
            left, right = left[near], right[near]
            near = np.bitwise_count(fps[left] ^ fps[right]) <= bits
            a.append(reps[left[near]])
            b.append(reps[right[near]])
            begin = end
    for s, z in zip(*(x[sizes > SMALL].tolist() for x in (starts, sizes)), strict=True):
        for i, j in _block_links(fps[s : s + z], np.arange(z), np.arange(z), bits):
            a.append(reps[[s + i]])
            b.append(reps[[s + j]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


FOUND = "a long, b long, cell long, fp long, rep long, block int"


def _batch(a=(), b=(), cell=(), fp=(), rep=(), block=()) -> pa.RecordBatch:
    n = max(len(a), len(cell))
    cols = [(a, pa.int64()), (b, pa.int64()), (cell, pa.int64()), (fp, pa.int64()), (rep, pa.int64()), (block, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) if len(c) else pa.nulls(n, t) for c, t in cols], [x.split()[0] for x in FOUND.split(", ")])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _grid(bits: int, tile: int):
    """Links of each cell; members of a cell of more than ``tile`` come back with a block number instead."""

    def run(batches):
        held, hot, seen = None, None, 0
        for batch in batches:
            now = _columns(batch)
            if hot is not None:
                n = int((now[0] == hot).sum())
                if n:
                    yield _batch(cell=now[0][:n], fp=now[1][:n], rep=now[2][:n], block=((seen + np.arange(n)) // tile).astype(np.int32))
                    seen += n
                    now = [c[n:] for c in now]
                if not len(now[0]):
                    continue
                hot = None
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if cut:
                a, b = _cell_links(now[0][:cut], now[1][:cut].view(np.uint64), now[2][:cut], bits)
                yield _batch(a=a, b=b)
            held = [c[cut:] for c in now]
            if len(held[0]) > tile:
                hot, seen = int(held[0][0]), len(held[0])
                yield _batch(cell=held[0], fp=held[1], rep=held[2], block=(np.arange(seen) // tile).astype(np.int32))
                held = None
        if held is not None and len(held[0]):
            a, b = _cell_links(held[0], held[1].view(np.uint64), held[2], bits)
            yield _batch(a=a, b=b)

    return run


def _tiles(bits: int):
    """Links between the two blocks of each tile, or within its one block, rows sorted by tile and side."""

    def links(rows):
        fps, reps, side = rows[1].view(np.uint64), rows[2], rows[3]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = _block_links(fps, left, right if len(right) else left, bits)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i, j = (np.array(x) for x in zip(*found, strict=True))
        return reps[i], reps[j]

    def run(batches):
        held = None
        for batch in batches:
            now = _columns(batch)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            edges = np.r_[np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]]), len(now[0])]
            for s, e in zip(edges[:-2], edges[1:-1], strict=True):
                a, b = links([c[s:e] for c in now])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held = [c[edges[-2] :] for c in now]
        if held is not None and len(held[0]):
            a, b = links(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def linked(distinct: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between representatives that connect every pair of ``distinct`` (fp, rep) at ``bits`` or fewer."""

    def enter(batches):
        for batch in batches:
            fp, rep = _columns(batch)
            for at in range(0, len(fp), 4096):
                own = cells(fp[at : at + 4096].view(np.uint64), bits=bits)
                many = own.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(fp[at : at + 4096], many)), pa.array(np.repeat(rep[at : at + 4096], many))], ["cell", "fp", "rep"])

    entered = distinct.select("fp", "rep").mapInArrow(enter, "cell long, fp long, rep long")
    dealt = entered.repartition(F.col("cell")).sortWithinPartitions("cell", "fp")
    found, _ = written(dealt.mapInArrow(_grid(bits, tile), FOUND), "simhash-found")
    links = found.where("a is not null").select("a", "b")
    hot = found.where("cell is not null")
    if hot.isEmpty():
        return links
    most = hot.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
    members = hot.join(most, "cell")
    others = F.expr("sequence(0, blocks - 1)")
    tiles = members.select("fp", "rep", "cell", "block", F.explode(others).alias("other")).select(
        F.struct("cell", F.least("block", "other"), F.greatest("block", "other")).alias("t"), "fp", "rep", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).cast("byte").alias("side")
    )
    tiles = tiles.select(F.xxhash64("t").alias("tile"), "fp", "rep", "side").repartition(F.col("tile")).sortWithinPartitions("tile", "side")
    return links.unionByName(tiles.mapInArrow(_tiles(bits), "a long, b long"))


def resolve(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps, _ = written(fingerprints(docs, key, text, words), "fingerprints")
    distinct, _ = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = components(linked(distinct, bits, tile))
    named = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each component, that of the smallest doc_id."""
    row, drop = fresh(docs, "row", "drop")
    rows, _ = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    found = resolve(rows, row, text).select(F.col("doc_id").alias("n"), "component_id")
    member = found.join(rows.select(F.col(row).alias("n"), F.col(f"`{key}`").alias("id")), "n")
    member, _ = written(member.select("component_id", F.struct(F.col("id").isNull().alias("none"), "id", "n").alias("rank")), "simhash-members")
    best = member.groupBy("component_id").agg(F.min("rank").alias("best"), F.count("*").alias("many")).where("many > 1").select("component_id", "best")
    gone, _ = written(member.join(best, "component_id").where("rank.n <> best.n").select(F.col("rank.n").alias(drop)), "simhash-gone")
    return rows.join(gone.hint("merge"), F.col(row) == F.col(drop), "left_anti").drop(row)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = resolve(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
