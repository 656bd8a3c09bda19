import hashlib
import random

import numpy as np
import pytest

from scholium.llm import substring_dedup as S

DIR = "/root/testdata/sf0.001"


def plainly(rows, window=13):
    """{(id, text): (n_words, n_removed, kept)} by the definition."""
    order = lambda i: S.LAST if i is None else i
    words = [(order(i), (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, i), i)
    out = {}
    for (raw, t), (i, w) in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out[raw, t] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def check(spark, rows, window=13):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [((r.doc_id, r.text), (r.n_words, r.n_removed, r.kept_text)) for r in S.deduplicated(frame, window).collect()]
    assert len(got) == len(rows) and dict(got) == plainly(rows, window)


def test_chain():
    assert S.chain(13) == [7, 13] and S.chain(50) == [7, 13, 25, 50] and S.chain(7) == [7] and S.chain(5) == [5] and S.chain(1) == [1]


def test_hashes_and_choices_depend_on_the_window_alone():
    words = np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.uint64)
    both = np.r_[words, words]
    for n in (1, 2, 3, 7, 13):
        h = S.window_hashes(both, n)
        assert (h[: 41 - n] == h[40 : 81 - n]).all() and len(set(h[: 41 - n].tolist())) == 41 - n
        pick = S.chosen(h, 5)
        inner = np.arange(80 - n - 5)
        assert all(pick[p] == p + int(h[p : p + 5].argmin()) for p in inner)


@pytest.mark.parametrize("window", [1, 5, 7, 13, 20, 50])
def test_equals_the_definition(spark, window):
    rng = random.Random(window)
    common = [[f"w{rng.randrange(9)}" for _ in range(rng.choice([12, 13, 14, 40, 120]))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(5)):
            text += rng.choice(common) if rng.random() < 0.6 else [f"u{rng.randrange(4000)}" for _ in range(rng.randrange(30))]
        rows.append((rng.randrange(1000) * 100 + i, rng.choice([" ", "\n", " \t\r\n"]).join(text)))
    check(spark, rows, window)


def test_nulls_repeats_ties_and_runs_of_one_word(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text), (None, text), (None, text + " more"), (3, text), (3, text + " end"), (9, ""), (8, None), (7, "one"), (6, " ".join(["la"] * 200)), (4, " ".join(["la"] * 90)), (2, "é x " * 14), (1, "é x " * 13), (10, text.upper())]
    check(spark, rows)
    frame = spark.createDataFrame([(3, text), (3, text), (4, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.deduplicated(frame).collect()) == [(3, 0), (3, 0), (4, 30)]


def test_long_text_and_many_copies(spark):
    rng = random.Random(3)
    long = " ".join(f"v{rng.randrange(50_000)}" for _ in range(60_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, long), (2, f"start {long[:200_000]} end")] + [(10 + i, f"x{i} {passage} y{i}") for i in range(700)]
    check(spark, rows)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans string, n_words string, id int")
    assert S.deduplicated(empty).count() == 0
    some = spark.createDataFrame([(1, "a " * 20, "s", "n", 4), (2, "a " * 20, "t", "n", 5)], empty.schema)
    out = S.deduplicated(some)
    assert out.columns == ["doc_id", "text", "spans", "id", "n_words", "n_removed", "kept_text", "removed"]
    assert [(r.spans, r.id, r.n_removed, [tuple(x) for x in r.removed]) for r in out.orderBy("doc_id").collect()] == [("s", 4, 0, []), ("t", 5, 20, [(0, 20)])]


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, gone, kept) in plainly(rows).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.op13_substring_dedup(spark, DIR).collect()}
    assert got == want and sum(r[1] for r in got.values()) > 0
