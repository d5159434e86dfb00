"""Harmonic packing of documents into sequences of fixed capacity.

A piece of length r belongs to class k where capacity/(k+1) < r <= capacity/k, and every
sequence of class k takes exactly k pieces.  Each worker fills the sequences of each class
by itself.  A document is cut so that its pieces nearly fill their classes.  What a worker
has left over, fewer than k pieces a class, is numbered through all workers and fills
sequences of the same class; what is then left, fewer than k pieces a class in all, a number
that does not grow with the input, is dealt to groups of some ``TOGETHER`` pieces, each packed
by first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollhouse.llm import words as W
from tollhouse.llm.common import stored

CAPACITY = 2048
#: A piece is cut on if k such pieces would leave more than this share of a sequence empty.
SLACK = 1 / 32
#: Pieces of the last rest that one task packs by first fit.
TOGETHER = 4_096
_SECOND, _THIRD = 1 << 61, 1 << 62


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``length`` tokens."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest * k >= capacity * (1 - slack):
            out.append((rest, k))
            break
        head = capacity // (k + 1)
        out.append((head, k + 1))
        rest -= head
    return out


def _fields(key: T.StructField, with_ids: bool) -> list[T.StructField]:
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "__class", "__worker", "__index"]
    fields = [key, *(T.StructField(n, T.LongType(), True) for n in longs)]
    return [*fields, T.StructField("ids", T.BinaryType(), True)] if with_ids else fields


def harmonic_pack(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, slack: float = SLACK, with_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, its ids.

    A document is its ids followed by ``end_id``.  Null and empty texts are documents of
    that one id.  Null and repeated keys are kept: every row is packed.  Other columns are
    ignored.  An empty table gives no rows.  Pieces of equal length are told apart by ids,
    place and key; which of equal ones comes first changes nothing.  The ids are little-endian unsigned 32-bit.
    """
    given = docs.select(F.col(f"`{key_col}`").alias(key_col), F.col(f"`{text_col}`").alias("__text"))
    fields = _fields(given.schema.fields[0], with_ids)
    names = [f.name for f in fields]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        memo = W.library_memo(path, W.bare_chunks)
        worker = TaskContext.get().partitionId()
        serial = 0
        open_bins: dict[int, list[tuple]] = {}
        arrow = pa.schema([pa.field(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in fields[1:]])
        for batch in batches:
            for a, b in W.slices(batch["__text"]):
                ids, bounds = memo.batch(batch["__text"].slice(a, b - a))
                raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
                keys = batch[key_col].slice(a, b - a).to_pylist()
                done: list[tuple] = []
                for key, i, j in zip(keys, at, at[1:], strict=False):
                    whole = raw[i:j] + end
                    n, start = len(whole) // 4, 0
                    for length, k in cuts(n, capacity, slack):
                        piece = whole[4 * start : 4 * (start + length)]
                        row = [key, start, length, zlib.crc32(piece), n, None, None, k, worker, None]
                        kept = open_bins.setdefault(k, [])
                        kept.append([*row, piece] if with_ids else row)
                        if len(kept) == k:
                            offset = 0
                            for x in kept:
                                x[5], x[6] = worker << 32 | serial, offset
                                offset += x[2]
                            serial += 1
                            done += kept
                            kept.clear()
                        start += length
                yield _batch(done, batch.schema.field(key_col), arrow, names)
        rest = [[*x[:9], i, *x[10:]] for kept in open_bins.values() for i, x in enumerate(kept)]
        if rest:
            yield _batch(rest, batch.schema.field(key_col), arrow, names)

    pieces = stored(given.mapInArrow(run, T.StructType(fields)), "packing")
    full = pieces.filter("sequence_id IS NOT NULL").drop("__class", "__worker", "__index")
    return full.unionByName(_left_over(pieces.filter("sequence_id IS NULL"), key_col, capacity))


def _batch(rows: list, key: pa.Field, arrow: pa.Schema, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], key.type), *(pa.array(c, f.type) for c, f in zip(columns[1:], arrow, strict=True))], names)


def _left_over(rest: DataFrame, key_col: str, capacity: int) -> DataFrame:
    counts = rest.groupBy("__class", "__worker").agg(F.count("*").alias("__n"))
    before = Wd.partitionBy("__class").orderBy("__worker")
    counts = counts.withColumn("__before", F.sum("__n").over(before) - F.col("__n")).withColumn("__all", F.sum("__n").over(Wd.partitionBy("__class")))
    numbered = (
        rest.join(counts.drop("__n"), ["__class", "__worker"])
        .withColumn("__at", F.col("__before") + F.col("__index"))
        .withColumn("__bin", F.expr("__at div __class"))
    )
    inside = Wd.partitionBy("__class", "__bin").orderBy("__at").rowsBetween(Wd.unboundedPreceding, -1)
    full = F.col("__bin") < F.expr("__all div __class")
    second = (
        numbered.filter(full)
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
        .withColumn("sequence_id", F.lit(_SECOND) + F.col("__class") * (1 << 40) + F.col("__bin"))
    )
    columns = [c for c in rest.columns if c not in ("__class", "__worker", "__index")]
    last = numbered.filter(~full)
    groups = -(-last.count() // TOGETHER) or 1
    last = last.select(*columns, F.pmod(F.xxhash64("__class", "__worker", "__index"), F.lit(groups)).alias("__group"))

    made = last.drop("__group").schema

    def first_fit(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        group, used, first = None, [], 0  # sequences before ``first`` are full
        for batch in batches:
            where, offset = [], []
            for own, n in zip(batch["__group"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if own != group:
                    group, used, first = own, [], 0
                b = next((b for b in range(first, len(used)) if used[b] + n <= capacity), len(used))
                if b == len(used):
                    used.append(0)
                where.append(_THIRD + (own << 32) + b)
                offset.append(used[b])
                used[b] += n
                while first < len(used) and used[first] == capacity:
                    first += 1
            given = {"sequence_id": pa.array(where, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_arrays([given[c] if c in given else batch[c] for c in made.names], made.names)

    order = [F.desc("length"), F.desc("ids_crc32"), F.desc("start"), F.desc(f"`{key_col}`")]
    third = last.repartition("__group").sortWithinPartitions("__group", *order).mapInArrow(first_fit, made)
    return second.select(*columns).unionByName(third)


def op5_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
