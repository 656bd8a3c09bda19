import random

import numpy as np
import pytest
import xxhash

from scholium.llm import simhash


def plain_fingerprint(text, words=4):
    """The definition, bit by bit."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """doc_id -> smallest doc_id reachable, by comparing every pair."""
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c", "Ünï Gross x y z w", "a b c d e f g h " * 40, "x\x0by\x0cz q\rw e"])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_components_match_all_pairs(spark, tile):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)] + [0]
    fps = {}
    for i in range(600):
        f = rng.choice(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            f ^= 1 << rng.randrange(64)
        fps[i] = f
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    distinct = spark.createDataFrame(rows, "rep long, fp long").groupBy("fp").agg({"rep": "min"}).toDF("fp", "rep")
    links = simhash.linked(distinct, tile=tile)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    first = {r.fp: r.rep for r in distinct.collect()}
    got = {i: roots.get(first[f], first[f]) for i, f in rows}
    assert got == plain_components(fps)


def test_grid_meets_every_close_pair():
    rng = random.Random(1)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        own = simhash.cells(np.array([a, b], dtype=np.uint64))
        assert own.shape == (2, 70) and (own[0] == own[1]).any()
        assert len(set(own[0].tolist())) == 70  # no two grids share a cell


def test_dedup_goes_by_rows(spark):
    """Rows that share a doc_id, or have none, are judged by their own texts."""
    words = [f"w{i}" for i in range(300)]
    near = " ".join([*words[:150], "changed", *words[151:]])
    clean = " ".join(f"v{i}" for i in range(300))
    assert (plain_fingerprint(near) ^ plain_fingerprint(" ".join(words))).bit_count() <= 4
    rows = [(1, " ".join(words)), (5, near), (5, clean), (None, near), (None, clean + " end of it all"), (None, "alone here"), (None, "alone here")]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, " ".join(words)), (5, clean), (None, "alone here")] + ([(None, rows[4][1])] if (plain_fingerprint(clean) ^ plain_fingerprint(rows[4][1])).bit_count() > 4 else []), key=str)


def test_edge_rows(spark):
    rows = [(1, "a b c d e", "x"), (2, "A B c d e", "y"), (3, None, "z"), (4, "", None), (None, "a b c d e", "n"), (1, "a b c d e", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.resolve(docs).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3)]
    assert simhash.deduplicated(docs).columns == docs.columns
    assert simhash.resolve(docs.limit(0)).count() == 0


def test_query_matches_all_pairs(spark):
    got = {r.doc_id: r for r in simhash.op8_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = {d: plain_fingerprint(t or "") for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == plain_components(fps)


def test_unary_counts_give_the_manhattan_distance():
    fps = np.random.default_rng(5).integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = fps[:2000], fps[2000:]
    counts = simhash.unary(a) ^ simhash.unary(b)
    assert (np.bitwise_count(counts) == np.abs(simhash.embed(a) - simhash.embed(b)).sum(axis=1)).all()
    assert (np.bitwise_count(counts) <= np.bitwise_count(a ^ b)).all()
