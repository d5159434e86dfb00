r"""Sorted-string-table shards of token ids, written and read by Spark.

A shard is a file of sections, each ended by a newline byte (Spark's text writer, which
commits the files, ends rows so): data blocks, a Bloom filter, a block index and a footer of
fixed size.  Numbers are little-endian; keys are big-endian, so that bytes order as keys do.

* Key: ``\0`` for null, else ``\1`` and the integer plus 2**63 in 8 bytes.
* Block: entries of ascending keys, each ``shared, rest, value`` (LEB128 lengths), the rest of
  the key and the value.  ``shared`` bytes are those of the key before; a block's first
  key is whole.  Value: the width of an id in bytes (2 or 4), then the ids.
* Bloom filter: u32 number of hashes, then the bits.
* Block index: per block the first key in 9 bytes (null padded by zeros), u64 offset,
  u32 length, u32 entries, u64 tokens before it.
* Footer: see ``FOOTER``; the last 4 bytes before the newline are the magic number.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollhouse.llm import words as W
from tollhouse.llm.common import shared_dir, split_count, stored

#: Offset and length of the Bloom filter and of the index, entries, tokens, shard number, magic.
FOOTER = struct.Struct("<QIQIQQQ4s")
INDEX = struct.Struct("<9sQIIQ")
MAGIC = b"TSS1"
BLOCK_BYTES = 64 << 10
#: Text bytes a shard, about.
SHARD_BYTES = 32 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
_MASK = (1 << 64) - 1


def key_bytes(key: int | None) -> bytes:
    """Order-keeping bytes of a key."""
    return b"\0" if key is None else b"\1" + struct.pack(">Q", key + (1 << 63))


def key_value(raw: bytes) -> int | None:
    """The key of its bytes."""
    return None if raw[:1] == b"\0" else struct.unpack(">Q", raw[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a = zlib.crc32(key) * 0x9E3779B97F4A7C15 & _MASK
    b = (a ^ a >> 29) * 0xBF58476D1CE4E5B9 & _MASK | 1
    return [(a + i * b & _MASK) % bits for i in range(BLOOM_HASHES)]


class Builder:
    """Sections of one shard, for entries given in ascending order of keys."""

    def __init__(self, number: int, block_bytes: int = BLOCK_BYTES):
        self.number, self.block_bytes = number, block_bytes
        self.at = self.entries = self.tokens = 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.first, self.last, self.inside, self.before = [], b"", b"", 0, self.tokens
        self.size = 0

    def add(self, key: int | None, ids: bytes) -> bytes | None:
        """Takes ids as little-endian 32-bit integers; returns a block that became full."""
        raw = key_bytes(key)
        shared = 0
        if self.inside:
            while shared < min(len(raw), len(self.last)) and raw[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = raw
        wide = np.frombuffer(ids, dtype="<u4")
        value = b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids
        entry = _varint(shared) + _varint(len(raw) - shared) + _varint(len(value)) + raw[shared:] + value
        if not self.keys or self.keys[-1] != raw:
            self.keys.append(raw)
        self.block.append(entry)
        self.last, self.size = raw, self.size + len(entry)
        self.inside += 1
        self.entries += 1
        self.tokens += len(wide)
        return self.flush() if self.size >= self.block_bytes else None

    def flush(self) -> bytes | None:
        """The block so far, if any."""
        if not self.inside:
            return None
        block = b"".join(self.block)
        self.index.append(INDEX.pack(self.first, self.at, len(block), self.inside, self.before))
        self.at += len(block) + 1
        self._fresh()
        return block

    def end(self) -> Iterator[bytes]:
        """Last block, Bloom filter, index and footer."""
        if block := self.flush():
            yield block
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 64) * 64)
        filled = np.zeros(bits, dtype=bool)
        for k in self.keys:
            filled[_bloom_places(k, bits)] = True
        bloom = struct.pack("<I", BLOOM_HASHES) + np.packbits(filled, bitorder="little").tobytes()
        index = b"".join(self.index)
        yield bloom
        yield index
        yield FOOTER.pack(self.at, len(bloom), self.at + len(bloom) + 1, len(index), self.entries, self.tokens, self.number, MAGIC)


class Shard:
    """Lookup and scan in the bytes of one shard."""

    def __init__(self, raw: bytes):
        self.raw = raw
        bloom_at, bloom_n, index_at, index_n, self.entries, self.tokens, self.number, magic = FOOTER.unpack_from(raw, len(raw) - FOOTER.size - 1)
        if magic != MAGIC:
            raise ValueError("not a shard of sorted token ids")
        self.bloom = raw[bloom_at + 4 : bloom_at + bloom_n]
        self.blocks = [INDEX.unpack_from(raw, index_at + i) for i in range(0, index_n, INDEX.size)]
        self.firsts = [b[0] for b in self.blocks]

    def block(self, number: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, tokens of the shard before it, ids) of a block's entries."""
        _, at, length, _, start = self.blocks[number]
        end, key = at + length, b""
        while at < end:
            shared, at = _read_varint(self.raw, at)
            rest, at = _read_varint(self.raw, at)
            size, at = _read_varint(self.raw, at)
            key = key[:shared] + self.raw[at : at + rest]
            at += rest
            ids = np.frombuffer(self.raw, dtype=f"<u{self.raw[at]}", count=(size - 1) // self.raw[at], offset=at + 1)
            at += size
            yield key_value(key), start, ids
            start += len(ids)

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All entries in order of keys."""
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, key: int | None) -> list[np.ndarray]:
        """Ids of every entry of a key: Bloom filter, binary search in the index, then the block."""
        raw = key_bytes(key)
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(raw, bits)):
            return []
        padded = raw.ljust(9, b"\0")
        low, high = max(0, bisect_left(self.firsts, padded) - 1), bisect_right(self.firsts, padded)
        return [ids for b in range(low, high) for k, _, ids in self.block(b) if k == key]


def write_sstable(docs: DataFrame, out: str, path: str, key_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of every whole text, then ``end_id``, as shards of ascending ranges of keys below ``out``.

    Null and empty texts hold ``end_id`` alone.  Null keys come first; rows with equal keys
    are all kept, in any order among themselves, and may lie in neighbouring shards.  Other
    columns are ignored.  An empty table gives shards without entries or no shards.
    """
    rows = docs.select(F.col(f"`{key_col}`").cast("long").alias("__key"), F.col(f"`{text_col}`").alias("__text"))
    total = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    shards = max(split_count(docs), -(-total // shard_bytes))
    end = np.array([end_id], dtype="<u4").tobytes()

    def build(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        memo = W.library_memo(path, W.spaced_chunks)
        shard = Builder(TaskContext.get().partitionId())
        for batch in batches:
            for a, b in W.slices(batch["__text"]):
                ids, bounds = memo.batch(batch["__text"].slice(a, b - a))
                raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
                keys = batch["__key"].slice(a, b - a).to_pylist()
                full = [x for k, i, j in zip(keys, at, at[1:], strict=False) if (x := shard.add(k, raw[i:j] + end)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary())], ["section"])
        for x in shard.end():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["section"])

    # A key of very many rows is dealt to several shards by the second column.
    spread = rows.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id()))
    sections = spread.repartitionByRange(shards, F.col("__key").asc_nulls_first(), "__spread").sortWithinPartitions(F.col("__key").asc_nulls_first()).drop("__spread").mapInArrow(build, "section binary")
    sections.select(F.col("section").cast("string").alias("value")).write.option("lineSep", "\n").text(out)


def read_sstable(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """One row per entry of the shards below ``out``: shard, key, start (ids of the shard before it), n_tokens, ids_crc32 and ids.

    The ids are little-endian unsigned 32-bit integers; without them the column is left out.
    """
    fields = "shard long, key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        for batch in batches:
            for raw in batch["content"]:
                shard = Shard(raw.as_py())
                rows: list[tuple] = []
                for key, start, ids in shard.scan():
                    spelled = ids.astype("<u4").tobytes()
                    rows.append((shard.number, key, start, len(ids), zlib.crc32(spelled), spelled)[: 5 + with_ids])
                    if len(rows) == 5000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in fields.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("content").mapInArrow(read, fields)


def manifest_sstable(spark: SparkSession, out: str) -> DataFrame:
    """(path, low, high, n) of each shard below ``out``: its least and greatest key (null keys count as least) and entries; written beside the shards once."""
    where = f"{out}/_manifest"
    schema = "path string, low long, high long, nulls boolean, n long"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                keys = [key for key, *_ in Shard(raw.as_py()).scan()]
                some = [k for k in keys if k is not None]
                rows.append({"path": path, "low": min(some, default=None), "high": max(some, default=None), "nulls": len(some) < len(keys), "n": len(keys)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.bool_()), ("n", pa.int64())]))

    folder = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")):
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("path", "content").mapInArrow(read, schema)
        found.coalesce(1).write.mode("overwrite").parquet(where)
    return spark.read.schema(schema).parquet(where)


def lookup_sstable(spark: SparkSession, out: str, keys: list[int | None]) -> DataFrame:
    """(key, ids) of the entries with the given keys: the manifest names the shards that may hold them, and only those are read and searched.

    A shard is searched by its Bloom filter, its sparse index and one block a key.  Null asks
    for the entries without a key; keys that no entry has give no row; no keys, no rows.
    """
    asked = sorted({k for k in keys if k is not None})
    wanted = spark.createDataFrame([(k,) for k in asked], "key long")
    manifest = manifest_sstable(spark, out)
    held = manifest.join(F.broadcast(wanted), F.col("key").between(F.col("low"), F.col("high")), "left_semi")
    if None in keys:
        held = held.unionByName(manifest.filter("nulls")).distinct()
    # At most a few shards a key.
    paths = [r.path for r in held.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "key long, ids binary")
    every = asked + [None] * (None in keys)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"]:
                shard = Shard(raw.as_py())
                rows = [(k, ids.astype("<u4").tobytes()) for k in every for ids in shard.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["key", "ids"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(find, "key long, ids binary")


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to shards and read back, with its place among all ids."""
    out = shared_dir(spark, "sstable")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_sstable(docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    entries = stored(read_sstable(spark, out, with_ids=False), "sstable-entries")
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Wd.orderBy("shard")) - F.col("n")).alias("before"))
    return entries.join(before, "shard").select(F.col("key").alias("doc_id"), (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
