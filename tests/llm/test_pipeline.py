"""The pipeline's stages against plain definitions, on planted documents."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scholium.llm import simhash, toxicity

BAD = ["vileword", "nastyone", "grimthing", "foulterm"]


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"{'bcdfgklm'[a]}{'aeiou'[b]}{'nprst'[c]}{'aeiou'[d]}" for a, b, c, d in rng.integers(0, [8, 5, 5, 5], (n, 4))]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, labels = [], []
    for i in range(300):
        text = words(60, i)
        if i % 5 == 0:
            for k in range(6):
                text.insert(5 * k, BAD[(i + k) % 4])
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 0, int(i % 5 == 0)))
    clean = words(400, 999)
    docs += [(1000 + i, " ".join(clean), "en", "s", 0) for i in range(8)] + [(1100, " ".join(clean).upper(), "en", "s", 0)]
    near = words(500, 1234)
    for i in range(5):
        changed = list(near)
        changed[10 + 60 * i] = "changed"
        docs.append((1200 + i, " ".join(changed), "en", "s", 0))
    docs += [(1300, "Write to some.one@mail.org or call +1 (337) 555-7349 today, please.", "en", "s", 0), (1301, None, "en", "s", None), (1302, "", None, None, 0), (1303, " ".join(words(3000, 77)), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{planted}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]

    rows = {d: t for d, t in rows.items() if model.above(np.array([model.latent(toxicity.words(t))]))[0, 0] < 0.5}
    assert not {i for i in range(300) if i % 5 == 0} & set(rows) and {i for i in range(300) if i % 5} <= set(rows)
    first = stage["toxicity"](spark, docs, planted)
    assert first.columns == docs.columns and {r.doc_id: r.text for r in first.collect()} == rows

    best = {}
    for d, t in rows.items():
        best[lower(t)] = max(d, best.get(lower(t), d))
    rows = {d: rows[d] for d in best.values()}
    second = stage["exact_dedup"](spark, first, planted)
    assert second.columns == docs.columns and {r.doc_id: r.text for r in second.collect()} == rows
    assert 1100 in rows and 1000 not in rows and 1302 in rows and 1301 not in rows

    fps = {d: simhash.fingerprint(t or "") for d, t in rows.items()}
    root = {d: d for d in rows}
    for _ in rows:
        before = dict(root)
        for a in rows:
            for b in rows:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    rows = {d: t for d, t in rows.items() if root[d] == d}
    third = stage["simhash_near_dedup"](spark, second, planted)
    assert third.columns == docs.columns and {r.doc_id: r.text for r in third.collect()} == rows
    assert len(rows.keys() & set(range(1200, 1205))) < 5

    rows[1300] = "Write to [EMAIL] or call [PHONE] today, please."
    fourth = stage["pii"](spark, third, planted)
    assert fourth.columns == docs.columns and {r.doc_id: r.text for r in fourth.collect()} == rows
    assert {r.doc_id: r.n_chars for r in fourth.where("doc_id = 1300").collect()} == {1300: len(rows[1300])}

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    packed = corpus_pipeline.run(spark, planted).collect()
    assert {r.doc_id for r in packed} == set(rows)
    for d, text in rows.items():
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in packed if r.doc_id == d)
        assert sum(x[2] for x in own) == len(ids)
        assert all(crc == zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, crc in own)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
