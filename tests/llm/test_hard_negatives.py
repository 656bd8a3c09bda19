import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm import hard_negatives as H

DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def plainly(rows, every=50, positives=5, negatives=3):
    """By the definition; rows as (vec_id, vector, label) with labels as they count."""
    use = set()
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = tuple(math.floor(256 * t) for t in v)
        if sum(t * t for t in x) < 1 << 55:
            use.add((i, x, label))
    out = []
    for i, x, label in use:
        if i % every:
            continue
        scores = sorted({(-sum(a * b for a, b in zip(x, y, strict=True)), j, other == label) for j, y, other in use if j != i and len(y) == len(x)}, key=lambda r: r[:2])
        for ps, j, same in [r for r in scores if r[2]][:positives]:
            fit = [(-s, k) for s, k, same in scores if not same and 50 * -ps <= 100 * -s <= 95 * -ps][:negatives]
            out += [(i, j, rank, k, -ps, s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def got(spark, rows, every=50, **options):
    frame = H.usable(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(tuple(r) for r in H.mined(frame, frame.where(F.col("vec_id") % every == 0), **options).collect())


def clustered(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, [float(t) for t in scale * (centres[i % 6] + 0.4 * rng.normal(size=dim))], int(rng.integers(0, 3)) if i % 4 == 0 else i % 6 % 3) for i in range(n)]


@pytest.mark.parametrize("dim, scale, shard, leaf", [(2, 1, 100, 8), (8, 0.02, 1000, 16), (8, 20_000, 150, 8), (5, 1e5, 90, 4), (16, 0.3, 64, 128)])
def test_equals_the_definition(spark, dim, scale, shard, leaf):
    rows = clustered(400, dim, dim, scale)
    want = plainly(rows, 7)
    assert got(spark, rows, 7, shard=shard, leaf=leaf) == want and want


def test_ties_repeats_and_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5], 1) for i in range(0, 120)] + [(1000 + i, [0.7, 0.3], 2) for i in range(9)] + [(2000 + i, [0.0, 0.0], 3) for i in range(3)]
    rows += [(50, [1.0, 0.5], 1), (3000, None, 1), (3050, [], 1), (3100, [1.0, None], 1), (3150, [nan, 1.0], 1), (3200, [1.0, inf], 2), (None, [1.0, 1.0], 2), (3250, [1.0, 1.0], None), (3300, [1e30, 1.0], 1), (3350, [1.0], 1), (3351, [1.0], 1), (3352, [0.9], 2), (150, [-1.0, -0.5], 4), (151, [1.0, 0.5], 4), (1000, [0.7, 0.31], 2)]
    want = plainly(rows)
    assert got(spark, rows, shard=20, leaf=4) == want and {r[0] for r in want} >= {0, 50, 100, 3350}


def test_empty_and_lone(spark):
    assert got(spark, []) == [] and got(spark, [(0, [1.0], 1)]) == [] and got(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_extra_columns_are_left_aside(spark):
    frame = spark.createDataFrame([(0, [1.0], 1, "a", 2)], SCHEMA + ", x string, dim int")
    assert H.usable(frame).columns == ["vec_id", "label", "x", "dim"]


def test_pairs_of_nodes_are_left_out_for_whole_groups():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 1000
    x = np.round(np.concatenate([c + 30 * rng.normal(size=(100, 16)) for c in centres])).astype(np.int64)
    label, ids = np.repeat(np.arange(40) % 4, 100), np.arange(4000)
    tree = H.Tree(x, label, 32)
    pick = np.arange(0, 4000, 10)
    q = H.Questions(pick, ids[pick], x[pick], label[pick], np.full(400, H.LEAST + 1), np.full(400, H.MOST_SCORE), True, 5, 8)
    done = H.search(q, tree, ids[tree.order])
    scores = x[pick] @ x.T
    for row in range(400):
        i = q.number[row]
        s = scores[i // 10]
        best = sorted((-int(s[j]), int(j)) for j in ids if label[j] == label[i] and j != i)[:5]
        assert [(-int(a), int(b)) for a, b in zip(q.score[row], q.found[row], strict=True)] == best
    leaves = sum(n[2] < 0 for n in tree.nodes) * sum(n[2] < 0 for n in q.tree.nodes)
    assert done["scored"] < leaves / 5 and done["left_out"] > 0


def test_trees_hold_their_rows():
    rng = random.Random(2)
    x = np.array([[rng.randrange(-9, 9) for _ in range(3)] for _ in range(500)], np.int64)
    label = np.array([rng.randrange(5) for _ in range(500)])
    tree = H.Tree(x, label, 10)
    assert sorted(tree.order.tolist()) == list(range(500)) and tree.nodes[tree.root][:2] == (0, 500)
    for i, (a, b, left, right) in enumerate(tree.nodes):
        far = np.sqrt(((tree.x[a:b] - tree.centre[i]) ** 2).sum(axis=1))
        assert far.max() <= tree.radius[i] + 1e-9 and tree.low[i] == tree.label[a:b].min() and tree.high[i] == tree.label[a:b].max()
        assert (left < 0 and b - a <= 10) or (tree.nodes[left][0], tree.nodes[left][1], tree.nodes[right][1]) == (a, tree.nodes[right][0], b)


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    have = sorted(tuple(r) for r in H.op11_hard_negatives(spark, DIR).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert have == plainly(rows) and have
