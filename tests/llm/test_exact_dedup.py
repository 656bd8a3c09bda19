import hashlib
import random

from pyspark.sql import functions as F

from scholium.llm import exact_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    out = []
    for t, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        kept = False
        for d in sorted(ids, key=lambda d: d is None):
            mine = d == best and not kept
            kept |= mine
            out.append((d, best, len(ids), mine, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in exact_dedup.resolve(frame).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_all_lengths_and_late_differences(spark):
    rng = random.Random(1)
    base = ["", "a", "é" * 33, "x" * 63, "x" * 64, "x" * 65, "y" * 1087, "y" * 1088, "y" * 1089, "z" * 20_000]
    texts = base * 2 + [t.upper() for t in base] + [t[:-1] + "!" for t in base if t] + [None]
    texts += [("w" * 18_000)[:k] + rng.choice("pq") + ("w" * 18_000)[k + 1 :] for k in (0, 63, 64, 1087, 1088, 17_471, 17_472, 17_999) for _ in range(3)]
    rows = list(enumerate(texts)) + [(None, "a"), (1, "a"), (1, "a"), (1, "other"), (None, "lonely")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(d, t, "e", True) for d, t in rows], "doc_id long, text string, keep_id string, kept boolean")
    assert rows_of(frame) == plain(rows)
    kept = exact_dedup.deduplicated(frame)
    assert kept.columns == frame.columns and {r.keep_id for r in kept.collect()} == {"e"}
    assert kept.count() == sum(r[3] for r in plain(rows))


def test_small_digits(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abA") for _ in range(rng.randrange(9)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    numbered, at, _ = exact_dedup.numbered(frame, head=1)
    member = exact_dedup.classes(numbered, at, head=1, width=1, growth=2)
    got = member.join(numbered, F.col("rid") == F.col(at["rid"])).groupBy("gid").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    assert sorted(r.ids for r in got) == sorted(g for g in groups.values() if len(g) > 1)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.resolve(frame).count() == 0 and exact_dedup.deduplicated(frame).count() == 0
