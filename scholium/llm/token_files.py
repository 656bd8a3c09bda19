"""Token ids in binary shard files of patched frame-of-reference blocks.

A shard holds the documents of one doc_id range in ascending order, its ids as
blocks of ``BLOCK``: the block's minimum is subtracted, the rest is packed at
the width that ``PERCENTILE`` of them need, and the others go to the block's
exception list with their positions. The footer indexes where blocks start and
how many ids each document has, so a reader seeks to any block or document.

Layout, little-endian: ``MAGIC``; blocks (u32 minimum, u32 ids, u32 exceptions,
u8 width, packed bits, u32 positions, u32 values); footer (u64 block starts,
i64 doc_ids, u8 null flags, u64 ids of each document); u64 footer start, u64
blocks, u64 documents, ``MAGIC``.

The engine's range partitioning deals whole texts to the shards, a task each, by
doc_id and then the place of reading, so rows without doc_id or with one that
recurs are spread as well. A task encodes and writes as it reads: block by block into a
file of its attempt, which it renames when complete, so a lost executor's task
can be run again. A reader also holds one block and one document at most. Where
a shard's ids start follows from sums over blocks of ``SUMMED`` shards and within them.

Defined results: the query takes a special token written out in a text for that
token, as the library does (``special``); a null or empty text is the end id alone; null doc_ids come
first; rows that repeat a doc_id stay, in the order of reading; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, table, written
from .tokens import encoder, ended, slices

MAGIC = b"PFORIDS1"
BLOCK = 4096
PERCENTILE = 0.98
END = 2
DOCS = 8192
SUMMED = 1024
_HEAD = struct.Struct("<IIIB")
_TAIL = struct.Struct("<QQQ8s")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block: minimum, width, packed differences, exceptions."""
    low = int(ids.min())
    rest = (ids - low).astype("<u4")
    width = int(np.partition(rest, k := int(percentile * (len(rest) - 1)))[k]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    values = rest[odd]
    rest[odd] = 0
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return _HEAD.pack(low, len(ids), len(odd), width) + packed + odd.astype("<u4").tobytes() + values.tobytes()


def unpack_block(raw: bytes) -> np.ndarray:
    low, n, odd, width = _HEAD.unpack_from(raw)
    at = _HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    out = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    if odd:
        out[np.frombuffer(raw, "<u4", odd, at + size)] = np.frombuffer(raw, "<u4", odd, at + size + 4 * odd)
    return out + np.uint32(low)


class ShardWriter:
    """Streams documents into a shard: at most one block of ids waits."""

    def __init__(self, out, block: int = BLOCK, percentile: float = PERCENTILE):
        self.out, self.block, self.percentile = out, block, percentile
        self.at, self.held, self.waiting = len(MAGIC), [], 0
        self.starts, self.docs, self.counts, self.tokens = [], [], [], 0
        out.write(MAGIC)

    def add(self, docs: list[int | None], ids: np.ndarray, counts: list[int]) -> None:
        """Documents with their ids one after another."""
        self.docs += docs
        self.counts += counts
        self.tokens += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.held)
            full = len(ids) // self.block * self.block
            for a in range(0, full, self.block):
                self._put(ids[a : a + self.block])
            self.held, self.waiting = [ids[full:].copy()], len(ids) - full

    def _put(self, ids: np.ndarray) -> None:
        raw = pack_block(ids, self.percentile)
        self.starts.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.waiting:
            self._put(np.concatenate(self.held))
        footer = np.asarray(self.starts, "<u8").tobytes() + np.asarray([d or 0 for d in self.docs], "<i8").tobytes()
        footer += bytes(d is None for d in self.docs) + np.asarray(self.counts, "<u8").tobytes()
        self.out.write(footer + _TAIL.pack(self.at, len(self.starts), len(self.docs), MAGIC))


def read_shard(source, size: int):
    """(doc_id, start in the shard, ids) of each document of an open random-access file."""
    source.seek(size - _TAIL.size)
    at, blocks, docs, magic = _TAIL.unpack(source.read(_TAIL.size))
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    source.seek(at)
    raw = source.read(size - _TAIL.size - at)
    starts = np.frombuffer(raw, "<u8", blocks).tolist() + [at]
    ids = np.frombuffer(raw, "<i8", docs, 8 * blocks).tolist()
    null = raw[8 * (blocks + docs) : 8 * (blocks + docs) + docs]
    counts = np.frombuffer(raw, "<u8", docs, 8 * (blocks + docs) + docs).tolist()
    held, have, block, start = [], 0, 0, 0
    for doc_id, absent, n in zip(ids, null, counts, strict=True):
        while have < n:
            source.seek(starts[block])
            got = unpack_block(source.read(starts[block + 1] - starts[block]))
            held.append(got)
            have += len(got)
            block += 1
        joined = held[0] if len(held) == 1 else np.concatenate(held) if held else np.empty(0, "<u4")
        yield None if absent else doc_id, start, joined[:n]
        held, have, start = [joined[n:]], have - n, start + n


def write_shards(docs: DataFrame, folder: str, path: str | None = None, key: str = "doc_id", text: str = "text", per_shard: int = DOCS, end: int = END, special: bool = False) -> DataFrame:
    """Encode ``docs`` and write its shards to ``folder``; the manifest: shard, file, n_docs, n_tokens."""
    path = path or vocabulary()
    pairs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("place"))
    shards = max(1, -(-docs.count() // per_shard))
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task, enc = TaskContext.get(), encoder(path, False, special)
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        writer = out = None
        name = f"{root}/shard-{task.partitionId():07d}.pfor"
        for batch in batches:
            for a, b in slices(batch.column(1)):
                if writer is None:
                    out = system.open_output_stream(f"{name}.{task.taskAttemptId()}")
                    writer = ShardWriter(out)
                ids, edges = ended(*enc.encode(batch.column(1).slice(a, b - a)), end)
                writer.add(batch.column(0).slice(a, b - a).to_pylist(), ids, np.diff(edges).tolist())
        if writer is not None:
            writer.close()
            out.close()
            system.move(f"{name}.{task.taskAttemptId()}", name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "file": [f"{folder}/{name.rpartition('/')[2]}"], "n_docs": [len(writer.docs)], "n_tokens": [writer.tokens]})

    dealt = pairs.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(dealt.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long"), "token-manifest")[0]


def _based(manifest: DataFrame) -> DataFrame:
    """(file, base): the ids of all shards before each; one task sums but a row for each ``SUMMED`` shards."""
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("file", "shard", "n_tokens", F.floor(F.col("shard") / SUMMED).alias("many"))
    sums = shards.groupBy("many").agg(F.sum("n_tokens").alias("n_tokens")).select("many", before(Window.orderBy("many")).alias("held"))
    return shards.withColumn("within", before(Window.partitionBy("many").orderBy("shard"))).join(sums, "many").select("file", (F.col("held") + F.col("within")).alias("base"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the manifest's files: doc_id, start, n_tokens, ids_crc32."""
    based = _based(manifest).repartition(max(1, manifest.count()))  # a task for each file

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(file)
                with system.open_input_file(at) as source:
                    rows = []
                    for doc_id, start, ids in read_shard(source, source.size()):
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return based.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), new_path(spark, "token-shards"), special=True))
