import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from scholium.llm import segmentation as seg

MODEL = seg.Lattice(seg.vocabulary())
TEXTS = ["", " ", "a", "the cat", " two  spaces ", "line\nbreak\t\u0000 é ☃ 漢字 🎈", "x" * 300, "wörd " * 50]


def every(text):
    """All segmentations of a text with their probabilities."""
    parts = seg._parts(text)
    out = {(): 0.0}
    for p in parts:
        own = {}

        def walk(i, path, log):
            if i == len(p):
                own[path] = log
                return
            for j in range(i + 1, len(p) + 1):
                if p[i:j] in MODEL.pieces:
                    k, cost = MODEL.pieces[p[i:j]]
                    walk(j, (*path, k), log + cost)
                elif j == i + 1:
                    b = p[i].encode()
                    walk(j, (*path, *(MODEL.byte_ids[x] for x in b)), log + MODEL.byte_cost * len(b))

        walk(0, (), 0.0)
        out = {a + b: x + y for a, x in out.items() for b, y in own.items()}
    total = math.log(sum(math.exp(v) for v in out.values()))
    return {k: v - total for k, v in out.items()}


@pytest.mark.parametrize("text", TEXTS)
def test_samples_are_distinct_and_decode(text):
    found = seg.sample(MODEL, [text], seg.row_keys([1]), 5)[0]
    assert len({r[0] for r in found}) == len(found) >= 1
    assert all(MODEL.decode(r[0]) == text for r in found)
    scores = [r[2] for r in found]
    assert scores == sorted(scores, reverse=True)
    sp = sentencepiece.SentencePieceProcessor(model_file=seg.vocabulary())
    for raw, *_ in found:
        assert sp.decode(np.frombuffer(raw, "<u2").tolist()) == text or "\u0000" in text or text != text.strip()


def test_small_lattices_are_whole():
    want = every("the")
    found = seg.sample(MODEL, ["the"], seg.row_keys([1]), 1000)[0]
    got = {tuple(np.frombuffer(r[0], "<u2").tolist()): r[1] for r in found}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(r[3] == 0.0 for r in found)


def test_distribution_without_replacement():
    """Orders of the first two samples follow sampling without replacement; inclusion weights are unbiased."""
    want = {k: math.exp(v) for k, v in every("cat").items()}
    n = 6000
    firsts, pairs, weights = Counter(), Counter(), Counter()
    for at in range(0, n, 500):
        for found in seg.sample(MODEL, ["cat"] * 500, seg.row_keys(list(range(at, at + 500)), 3), 2):
            a, b = (tuple(np.frombuffer(r[0], "<u2").tolist()) for r in found)
            firsts[a] += 1
            pairs[a, b] += 1
            for k, r in zip((a, b), found):
                weights[k] += math.exp(r[1] - r[3])
    for k, p in want.items():
        assert abs(firsts[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        assert abs(weights[k] / n - p) < 0.15 * p + 0.02
        for j, q in want.items():
            if j != k:
                e = p * q / (1 - p)
                assert abs(pairs[k, j] / n - e) < 5 * math.sqrt(e / n) + 1e-3


def test_batches_do_not_matter():
    keys = seg.row_keys(list(range(len(TEXTS))))
    together = seg.sample(MODEL, TEXTS, keys, 3)
    assert together == [seg.sample(MODEL, [t], keys[i : i + 1], 3)[0] for i, t in enumerate(TEXTS)]
    small = seg.Lattice(seg.vocabulary(), nodes=10)
    assert together == [seg.sample(small, [t], keys[i : i + 1], 3)[0] for i, t in enumerate(TEXTS)]


def test_operator(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (1, " ", "y")], "doc_id long, text string, ids string")
    rows = seg.encoded(docs, 3)
    back = seg.decoded(rows).collect()
    assert all(r.text == (TEXTS[r.doc_id] if r.doc_id is not None else "") for r in back)
    assert seg.encoded(docs.limit(0)).count() == 0


def test_query(spark):
    got = seg.op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts) and all(r.decoded for r in got)
    by = Counter(r.doc_id for r in got)
    assert all(n == seg.SAMPLES for d, n in by.items() if texts[d])


def _plain(part):
    """Backward sums of one part, node by node in the log domain: each node's share of mass by piece length."""
    n = len(part)
    beta, out = [0.0] * (n + 1), []
    for i in range(n - 1, -1, -1):
        found = {j - i: MODEL.pieces[part[i:j]][1] + beta[j] for j in range(i + 1, min(n, i + MODEL.longest) + 1) if part[i:j] in MODEL.pieces}
        if 1 not in found:
            found[1] = MODEL.byte_cost * len(part[i].encode()) + beta[i + 1]
        top = max(found.values())
        beta[i] = top + math.log(sum(math.exp(v - top) for v in found.values()))
        out.append({k: v - beta[i] for k, v in sorted(found.items())})
    return out[::-1]


@pytest.mark.parametrize("n", [2049, 16384, 16385, 40000])
def test_long_parts_have_the_same_distribution(n):
    rng = np.random.default_rng(n)
    part = seg.MARK + "".join(rng.choice(list("etaonishr0123é漢"), n - 1))
    model = seg.Lattice(seg.vocabulary())
    start = int(model.parts([part[1:]])[0][0])
    t = model.view()
    for i, want in enumerate(_plain(part)):
        lo, hi = t.firsts[start + i], t.firsts[start + i + 1]
        assert hi - lo == len(want)
        assert all(abs(a - min(b, 0.0)) < 1e-6 for a, b in zip(t.logs[lo:hi], want.values()))
        ends = [start + i + k if i + k < n else -1 for k in want]
        assert t.targets[lo:hi].tolist() == ends


def test_a_hash_alone_makes_no_piece():
    """Where hashes of other strings agree with pieces', the letters still tell."""
    model = seg.Lattice(seg.vocabulary())
    hashes, ids, costs, letters = model.by_length[2]
    at = int(np.flatnonzero(ids == model.pieces["th"][0])[0])
    wrong = letters.copy()
    wrong[at] = [ord("q"), ord("z")]
    model.by_length[2] = hashes, ids, costs, wrong
    logs, _ = model._found("th", np.array([2, 1]))
    assert np.isinf(logs[0, 1])


def test_unbroken_text_takes_time_in_proportion():
    import time

    text = "".join(np.random.default_rng(1).choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 1_000_000))
    model = seg.Lattice(seg.vocabulary())
    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        found = seg.sample(model, [text[:n]], seg.row_keys([1]), 2)[0]
        took.append(time.process_time() - began)
        assert len(found) == 2 and all(model.decode(r[0]) == text[:n] for r in found)
    assert took[1] < 20 * took[0] + 5 and took[1] < 120


def test_bounds_are_computed_while_they_can_be_best():
    """Of a long path a few bounds do, and the best of them is the best of all."""
    text = " ".join("".join(w) for w in np.random.default_rng(5).choice(list("etaonishrdlu"), (4000, 6)))
    keys = seg.row_keys(list(range(6)))
    starts = MODEL.parts([text])[0]
    tables = MODEL.view()
    for key in keys:
        edges, at = tables.draw(starts, seg.mixed(key + np.arange(len(starts), dtype=np.uint64)))
        for begin, barred in ((0, set()), (3, {int(edges[3])}), (len(edges) - 1, set())):
            leaf = seg.Leaf(tables, edges, at, 0.5, begin, barred, key)
            best = leaf.best()
            assert begin or leaf.stop < len(edges) / 4
            while leaf.stop < len(edges):
                seg.extend([leaf])
            assert leaf.best() == best and len(leaf.bounds) == len(edges) - begin


def test_places_of_hashes():
    for hashes in (np.arange(1, 3000), np.array([0]), np.random.default_rng(1).integers(0, 1 << 63, 20_000)):
        hashes = np.unique(hashes).astype(np.uint64)
        sought = np.r_[hashes[::-1], hashes + np.uint64(5), np.uint64(2**64 - 1)]
        hit, place = seg.Places(hashes).find(sought)
        assert hit.tolist() == np.isin(sought, hashes).tolist() and (hashes[place[hit]] == sought[hit]).all()
