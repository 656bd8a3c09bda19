import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scholium.llm import packing, token_files
from scholium.llm.tokens import Encoder

ODD = ["", " ", "a  b", " a", "b ", "x\n\ny <|endoftext|> z", "don't stop é ̈x", "tab\there \n q", "\x1ca\x1d b c  ", "Σας ΟΔΟΣ é İ 中文字 ½ 3²", "a\tb", "\n", "word.\nThen, e-mail@x.org! 'tis 12,5% of***", "x" * 5000]


def _encoded(enc, texts):
    ids, counts = enc.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]]


@pytest.mark.parametrize("name,joined", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_units_equal_whole_texts(name, joined):
    rng = random.Random(3)
    alphabet = ["a", "Be", " ", "  ", "\n", ".", ",", "'s", "é", "́", "9", "***", "\t", " ", "Ж", "-", "\r\n"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(2000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    enc = Encoder(public_tokenizers.path(name), joined, 50)
    for some in (texts, texts[::-1], texts[:1]):
        assert _encoded(enc, some) == [plain.encode(t, add_special_tokens=False).ids for t in some]
    assert _encoded(enc, [None, "a"])[0] == [] == _encoded(enc, [""])[0] and _encoded(enc, []) == []


@pytest.mark.parametrize("ids", [[5], [0, 0, 0], list(range(5000)), [1] * 99 + [2**32 - 1], [7, 2**31, 8]])
@pytest.mark.parametrize("percentile", [0.0, 0.9, 1.0])
def test_block_round_trip(ids, percentile):
    ids = np.asarray(ids, "<u4")
    assert (token_files.unpack_block(token_files.pack_block(ids, percentile)) == ids).all()


def test_shard_round_trip():
    rng = np.random.default_rng(2)
    docs = [(None, np.asarray([2], "<u4"))] + [(i, rng.integers(0, 49000, rng.integers(1, 9000)).astype("<u4")) for i in range(30)]
    out = io.BytesIO()
    writer = token_files.ShardWriter(out)
    for d, ids in docs[:5]:
        writer.add([d], ids, [len(ids)])
    writer.add([d for d, _ in docs[5:]], np.concatenate([x for _, x in docs[5:]]), [len(x) for _, x in docs[5:]])
    writer.close()
    got = list(token_files.read_shard(out, len(out.getvalue())))
    assert [d for d, _, _ in got] == [d for d, _ in docs]
    assert all((a == b[1]).all() for (_, _, a), b in zip(got, docs))
    assert [s for _, s, _ in got] == np.cumsum([0] + [len(x) for _, x in docs])[:-1].tolist()


def _expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("per_shard", [2, 1000])
def test_token_files(spark, tmp_path, per_shard):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(-5, None), (None, "null id")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string")
    got = token_files.read_shards(token_files.write_shards(docs, f"file://{tmp_path}/s", per_shard=per_shard)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_expected(rows), key=str)
    assert token_files.read_shards(token_files.write_shards(docs.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_query_token_files(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = token_files.op6_token_files(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == _expected(rows)


def _check_packing(rows, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(docs) == set(texts)
    for d, text in texts.items():
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for i, p in enumerate(sorted(docs[d], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (i, at)
            assert p.length == 1024 or i == 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for b in bins.values():
        end = 0
        for off, n in sorted(b):
            assert off == end
            end += n
        assert end <= 1024
    return len(bins), -(-sum(r.length for r in rows) // 1024)


def test_query_packing(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    made, least = _check_packing(packing.op9_best_fit_packing(spark, "/root/testdata/sf0.01").collect(), texts)
    assert made <= 1.005 * least + 1


def test_packing_edges(spark):
    texts = {i: t for i, t in enumerate(ODD)} | {100: None, 101: "a " * 1023, 102: "a " * 1022 + "a", 103: "word " * 5000}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, piece int")
    _check_packing(packing.pack_documents(docs).collect(), texts)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (6, 5, 7, 5, 3)] == [(0, 0), (1, 0), (2, 0), (1, 5), (2, 7)]


def _slow(lengths, capacity, limit, ahead):
    """The packer by its definition, from a plain list of open bins, that touched last at its end; and how often one closed."""
    opened, made, closed, out = [], 0, 0, [None] * len(lengths)
    for at in range(0, len(lengths), ahead):
        for i in sorted(range(at, min(at + ahead, len(lengths))), key=lambda i: -lengths[i]):
            fits = [(free, -p) for p, (_, free) in enumerate(opened) if free >= lengths[i]]
            if fits:
                b, free = opened.pop(-min(fits)[1])
            else:
                if len(opened) == limit:
                    opened.pop(-min((free, -p) for p, (_, free) in enumerate(opened))[1])
                    closed += 1
                b, free, made = made, capacity, made + 1
            out[i] = (b, capacity - free)
            if free > lengths[i]:
                opened.append((b, free - lengths[i]))
    return out, closed


@pytest.mark.parametrize("low,high,ahead", [(300, 1024, packing.AHEAD), (500, 900, packing.AHEAD), (400, 1024, 1), (1, 1024, 7)])
def test_bins_equal_the_definition(low, high, ahead):
    lengths = np.random.default_rng(low).integers(low, high, 4000).tolist()
    bins = packing.Bins()
    assert bins.limit == packing.OPEN
    got = [x for at in range(0, len(lengths), ahead) for x in packing.placed(lengths[at : at + ahead], bins)]
    wanted, closed = _slow(lengths, packing.CAPACITY, packing.OPEN, ahead)
    assert got == wanted
    assert closed > 0


LITERAL = ["one doc.<|endoftext|>Next doc", "<|endoftext|>", "a <|endoftext|> b", "x\n<|startoftext|>\ny", "<|ENDOFTEXT|> it,<|endoftext|>'s"]


@pytest.mark.parametrize("name,joined", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_literal_special_tokens_equal_the_plain_call(name, joined):
    rng = random.Random(4)
    alphabet = ["a", "Be", " ", "  ", "\n", ".", "'s", "é", "9", "\t", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]
    texts = LITERAL + ["".join(rng.choices(alphabet, k=rng.randrange(1, 20))) for _ in range(3000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    got = _encoded(Encoder(public_tokenizers.path(name), joined, 50, special=True), texts)
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_queries_take_literal_special_tokens(spark, tmp_path):
    spark.createDataFrame(list(enumerate(LITERAL)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    words, bytewise = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    files = sorted(map(tuple, token_files.op6_token_files(spark, str(tmp_path)).collect()))
    pieces = {r.doc_id: r for r in packing.op9_best_fit_packing(spark, str(tmp_path)).collect()}
    for (doc_id, at, n, crc), text in zip(files, LITERAL, strict=True):
        ids = np.asarray(words.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (at, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += n
        ids = np.asarray(bytewise.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (pieces[doc_id].length, pieces[doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
