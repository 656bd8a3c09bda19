import pytest
import math
import random

import numpy as np

from scholium.llm import toxicity

BAD = ["vileword", "nastyone", "grimthing"]


def corpus(n, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = [f"word{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}" for _ in range(rng.randrange(20, 60))]
        grade = rng.choice([0, 0, 0, 0, 1, 2, 3])
        for _ in range(3 * grade):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ish"]))
        docs.append((i, " ".join(words), grade))
    return docs


def model_of(spark, docs, binary):
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    return toxicity.trained(frame, spark.createDataFrame([(i, int(g > 0) if binary else g) for i, _, g in docs], "doc_id long, toxic int"))


def test_held_out_accuracy(spark):
    model = model_of(spark, corpus(600, 1), True)
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:]))
    held = corpus(400, 2)
    got = np.array([model.above(np.array([model.latent(toxicity.words(t))]))[0] for _, t, _ in held])
    truth = np.array([g for *_, g in held])
    assert ((got[:, 0] >= 0.5) == (truth > 0)).mean() > 0.98
    severity = got.sum(axis=1)
    means = [severity[truth == g].mean() for g in range(4)]
    assert means == sorted(means)


def test_given_grades_are_used(spark):
    model = model_of(spark, corpus(800, 3), False)
    held = corpus(300, 4)
    grade = [int((model.above(np.array([model.latent(toxicity.words(t))]))[0] >= 0.5).sum()) for _, t, _ in held]
    assert np.abs(np.array(grade) - np.array([g for *_, g in held])).mean() < 0.2


def test_operator_and_edges(spark):
    docs = corpus(500, 5)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in docs] + [(None, None, "x", 1), (900, "", "x", 1), (901, "VileWord " * 3000, "x", 1), (901, "VileWord " * 3000, "x", 1)], "doc_id long, text string, toxic string, grade int")
    labels = spark.createDataFrame([(i, int(g > 0)) for i, _, g in docs] + [(None, 1), (3, None), (12345, 1)], "doc_id long, toxic int")
    model = toxicity.trained(frame, labels)
    got = toxicity.scored(frame, model).collect()
    assert len(got) == 504
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].toxic == (g > 0) for i, _, g in docs]) > 0.98
    assert by[901].toxic and not by[900].toxic and not by[None].toxic
    kept = toxicity.rejected_removed(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(not r.toxic for r in got)
    none = toxicity.trained(frame, labels.where("toxic = 0"))
    assert not any(r.toxic for r in toxicity.scored(frame, none).collect())
    assert toxicity.scored(frame.limit(0), toxicity.trained(frame.limit(0), labels)).count() == 0


def test_no_marking_feature_is_left_out(spark):
    """Toxic rows that hold a third of many marking words each are told by as many features as mark them."""
    rng = random.Random(6)
    bad = ["".join(rng.choices("bcdfghjkl", k=3) + rng.choices("mnpqrstvw", k=4)) for _ in range(900)]

    def row(i, toxic):
        clean = [f"word{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}" for _ in range(30)]
        return i, " ".join(clean + (rng.sample(bad, 300) if toxic else [])), int(toxic)

    docs = [row(i, i % 2) for i in range(600)]
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int")
    rows = toxicity.sample(frame, labels)
    marks = toxicity.marking(rows)
    assert set(bad) <= set(marks)
    model = toxicity.fit(toxicity.marked(rows, marks), marks)
    assert len(model.weights) > 900
    held = [row(i, i % 2) for i in range(200)]
    assert [model.latent(toxicity.words(t)) > model.thresholds[0] for _, t, _ in held] == [t == 1 for *_, t in held]


def test_query_on_labelled_rows(spark):
    got = {r.doc_id: r.toxic for r in toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").collect()}
    truth = [(r.doc_id, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()]
    assert np.mean([got[d] == (t == 1) for d, t in truth if d in got]) > 0.98


def _loss(weights, thresholds, rows, penalty):
    """Penalised negative log likelihood of cumulative links, row by row."""
    total = 0.0
    for grade, found, _ in rows:
        z = sum(weights[f] * math.log2(1 + n) for f, n in found.items())
        above = [1.0, *(1 / (1 + math.exp(-(z - t))) for t in thresholds), 0.0]
        total -= math.log(max(above[grade] - above[grade + 1], 1e-12))
    return total + penalty / 2 * sum(w * w for w in weights.values())


def test_fit_is_the_likelihoods_maximum():
    """No step in any single weight or threshold lowers the loss that plain arithmetic gives; a plain search does no better."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        n = rng.integers(0, 4, 3)
        z = 1.2 * math.log2(1 + n[0]) - 0.8 * math.log2(1 + n[1]) + rng.logistic()
        rows.append((int((z > 0.5) + (z > 2.0)), {f: int(k) for f, k in zip("abc", n) if k}, 0))
    marks = dict.fromkeys("abc", 1.0)
    model = toxicity.fit(rows, marks)
    weights, thresholds = dict(model.weights), model.thresholds.tolist()
    assert set(weights) == {"a", "b", "c"} and thresholds == sorted(thresholds) and len(thresholds) == 2
    best = _loss(weights, thresholds, rows, toxicity.PENALTY)
    point = [weights[f] for f in "abc"] + thresholds
    at = lambda p: _loss(dict(zip("abc", p[:3])), p[3:], rows, toxicity.PENALTY)
    for i in range(5):
        for step in (0.05, -0.05):
            assert at([x + step * (j == i) for j, x in enumerate(point)]) > best - 1e-6
    search, step = [0.0, 0.0, 0.0, 0.5, 1.5], 0.5
    while step > 1e-4:
        moved = min(([x + d * (j == i) for j, x in enumerate(search)] for i in range(5) for d in (step, -step)), key=at)
        if at(moved) < at(search):
            search = moved
        else:
            step /= 2
    assert abs(at(search) - best) < 0.02
    above = model.above(np.array([0.3]))[0]
    assert above.tolist() == pytest.approx([1 / (1 + math.exp(t - 0.3)) for t in thresholds]) and above[0] > above[1]
