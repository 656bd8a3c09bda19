import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholium.llm import source_audit as A

DIR = "/root/testdata/sf0.001"
FOUND = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least=30, top=50):
    """Rows of (lang, source, text) by the definition."""
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = FOUND.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        q = shares(whole)
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in sources if x != s), key=lambda r: (-r[0], r[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]), key=lambda r: (-r[0], r[1].encode()))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def made(n, seed, langs=3, sources=7, vocabulary=40):
    rng = random.Random(seed)
    words = [rng.choice(["é", "x", "Ab", "ß日", "O"]) + "".join(rng.choice("abcDEFö") for _ in range(rng.randrange(1, 5))) for _ in range(vocabulary)]
    return [(rng.choice([None, "", "en", "de"][:langs]), rng.choice([None, *(f"s{i}" for i in range(sources))]), None if rng.random() < 0.05 else rng.choice([" ", ", ", "-1_"]).join(rng.choice(words[: rng.choice([5, 40])]) for _ in range(rng.randrange(25)))) for _ in range(n)]


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    return sorted(tuple(r) for r in A.audit(frame, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least, top, block", [(1, 50, 1 << 19), (5, 3, 20), (30, 50, 1)])
def test_equals_the_definition(spark, least, top, block):
    rows = made(300, least)
    want = plainly(rows, least, top)
    assert got(spark, rows, least=least, top=top, block=block) == want and any(r[2] == "term" for r in want)


def test_no_kept_term_and_lone_groups(spark):
    rows = [("en", "a", "one two"), ("en", "b", None), ("en", "c", ""), ("de", "a", "wort"), (None, None, None)]
    assert got(spark, rows) == plainly(rows) == [("en", s, "pair", x, 0, r) for s in "abc" for r, x in enumerate(sorted({"a", "b", "c"} - {s}), 1)]


def test_ties_repeats_long_terms_and_texts(spark):
    long = "ab" * 50_000
    rows = [("en", s, f"tie tied {long} {s}") for s in ("a", "b", "c") for _ in range(31)] + [("en", "a", "word " * 100_000)] * 30
    assert got(spark, rows) == plainly(rows)


def test_pairs_go_early_when_there_are_many_sources(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD", 16)
    held = A._Pairs("en")
    rng = np.random.default_rng(1)
    want, have = defaultdict(int), defaultdict(int)
    for _ in range(60):
        names = sorted(f"s{i}" for i in rng.choice(12, rng.integers(1, 12), replace=False))
        p, p0 = (rng.integers(1, 100, len(names)) for _ in range(2))
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                want[a, names[j]] += abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p[j] - p0[i])
        for b in held.add(names, p, p0):
            for r in b.to_pylist():
                have[r["source"], r["item"]] += r["value"]
    for b in held.out():
        for r in b.to_pylist():
            have[r["source"], r["item"]] += r["value"]
    assert have == want


def test_shares_are_exact():
    for n, total, v in ((0, 0, 1), (3, 10, 2), (9 * 10**14, 9 * 10**15, 10**6), (0, 9 * 10**15, 3)):
        assert A.share(n, total, v) == 1 + 10**9 * (n + 5) // (total + 5 * v) == A.share(np.array([n]), np.array([total]), np.array([v]))[0]


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string, item string, value string, rank int")
    out = A.audit(empty)
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]
    some = spark.createDataFrame([("en", "a", "x", "i", "v", 1), ("en", "b", "x", "i", "v", 1)], empty.schema)
    assert A.audit(some, least=1).where("part = 'pair'").count() == 2


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("lang", "source", "text").collect()]
    have = sorted(tuple(r) for r in A.op12_source_audit(spark, DIR).collect())
    assert have == plainly(rows) and any(r[2] == "term" for r in have)


def test_runs_longer_than_a_batch():
    schema = A.pa.schema([("lang", A.pa.string()), ("term", A.pa.string()), ("source", A.pa.string()), ("block", A.pa.int64()), ("n", A.pa.int64()), ("docs", A.pa.int64())])
    rows = [("en", "a", "x", 0, 1, 1)] + [("en", "b", f"s{i // 5}", i, 2, 1) for i in range(25)] + [("en", "c", "x", 0, 3, 2)]
    for size in (1, 2, 3, 7, 100):
        batches = [A.pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
        out = [tuple(r.values()) for b in A._scan(iter(batches)) for r in b.to_pylist()]
        assert out == [("en", "a", "x", 1, 1, 1)] + [("en", "b", f"s{i}", 10, 25, int(i == 0)) for i in range(5)] + [("en", "c", "x", 3, 2, 1)]
