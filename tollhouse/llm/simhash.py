"""SimHash fingerprints of word shingles and their components at a small Hamming radius.

Equal fingerprints collapse first.  Of two within the radius r, at least two of r + 2 segments
of the 64 bits agree, so every pair of segments is a key and fingerprints meet in buckets
of equal keys.  A bucket of very many fingerprints is keyed once more by pairs of segments of the
bits that its key leaves open, until those bits alone bound it.

Buckets are compared bit-sliced: bit b of all fingerprints of a block of buckets is one
vector, a plane.  A plane and the same plane moved by a lag differ where fingerprints that
far apart differ in bit b, and carry-save counters (ones, twos, ... as vectors too) add these
differences for all of them at once.  A lag is abandoned as soon as every pair of it is beyond
the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollhouse.llm.common import Steps, text_bytes
from tollhouse.llm.components import connected_components

BITS, SEED, WIDTH, RADIUS = 64, 42, 3, 2
#: Shingles whose bits are counted at once.
PIECE = 1 << 14
#: Fingerprints of a bucket that are compared without a further key.
BUCKET = 2048
#: A bucket whose key leaves so many bits open is never divided: it holds 2 ** FREE of them at most.
FREE = 16
#: Fingerprints of a block of buckets (a larger bucket is a block of its own).
BLOCK = 1 << 15
#: Large buckets' keys up to which they are broadcast (16 bytes each); beyond, they are joined.
BROADCAST_KEYS = 500_000
#: Links of a block that wait before they are merged.
WAITING = 1 << 18


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits: each is set where over half of the shingles' XXH64 have it; 0 without words."""
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    begins, ends = begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for a in range(0, len(begins), PIECE):
        piece = [hashed(joined[i:j], SEED) for i, j in zip(begins[a : a + PIECE], ends[a : a + PIECE], strict=True)]
        bits = np.unpackbits(np.array(piece, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(begins), bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``out``, the fingerprint of each whole text as a long (its bits as a signed number).

    A-Z are lowered, words are runs of bytes other than space and 0x09-0x0D, shingles count as often
    as they occur; fewer words than ``width`` are one shingle.  Texts that are null, empty or
    without words have 0.  A column named ``out`` is replaced.
    """
    at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c != out]
    schema = docs.drop(out).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(at)), np.uint64, b.num_rows).view(np.int64)
            names = [*[b.schema.names[i] for i in kept], out]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(found)], names=names)

    return docs.mapInArrow(run, schema)


def masks(open_bits: int, radius: int) -> list[int]:
    """Of r + 2 segments of the set bits of ``open_bits``, every pair as a mask."""
    bits = [1 << b for b in range(BITS) if open_bits >> b & 1]
    segments = [sum(int(x) for x in part) for part in np.array_split(np.array(bits, dtype=object), radius + 2)]
    return [a | b for a, b in itertools.combinations(segments, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes(values: np.ndarray, bits: list[int]) -> list[np.ndarray]:
    """Bit planes of 64-bit ``values``: vectors of 64-bit words, the i-th bit that of the i-th value; a zero word follows."""
    words = -(-len(values) // 64) + 1
    found = []
    for b in bits:
        packed = np.zeros(words * 8, np.uint8)
        own = np.packbits((values >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little")
        packed[: len(own)] = own
        found.append(packed.view("<u8"))
    return found


def _moved(plane: np.ndarray, lag: int, words: int) -> np.ndarray:
    """The first ``words`` words of a plane whose bits have moved down by ``lag``."""
    skip, bits = divmod(lag, 64)
    own = np.zeros(words + 1, np.uint64)
    rest = plane[skip : skip + words + 1]
    own[: len(rest)] = rest
    return own[:words] if not bits else (own[:words] >> np.uint64(bits)) | (own[1:] << np.uint64(64 - bits))


def close_pairs(values: np.ndarray, sizes: np.ndarray, bits: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one bucket that differ in ``radius`` of ``bits`` at most, lag by lag.

    ``values`` are those of buckets of ``sizes``, one after another, the largest first.
    """
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(values)) - 1
    vertical, depth = planes(values, bits), radius.bit_length()
    for lag in range(1, int(sizes[0])):
        n = int(sizes[sizes > lag].sum())  # later buckets are too small for this lag
        words = -(-n // 64)
        packed = np.zeros(words * 8, np.uint8)
        own = np.packbits(left[:n] >= lag, bitorder="little")
        packed[: len(own)] = own
        alive = packed.view("<u8").copy()
        counters = [np.zeros(words, np.uint64) for _ in range(depth)]
        for i, plane in enumerate(vertical):
            carry = plane[:words] ^ _moved(plane, lag, words)
            for c in counters:
                carry, c[:] = c & carry, c ^ carry
            # A carry out of the last counter is beyond any radius; so is a sum above it.
            alive &= ~(carry | _above(counters, radius))
            if i % 4 == 3 and not alive.any():
                break
        else:
            at = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
            if len(at):
                yield at, at + lag


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where vertical counters hold more than ``radius``."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same = same & counters[i]
        else:
            more, same = more | (same & counters[i]), same & ~counters[i]
    return more


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of places (the least place of each group) after the pairs a, b are joined."""
    while True:
        x, y = labels[a], labels[b]
        open_pairs = x != y
        if not open_pairs.any():
            return labels
        a, b, x, y = a[open_pairs], b[open_pairs], x[open_pairs], y[open_pairs]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while True:
            again = labels[labels]
            if np.array_equal(again, labels):
                break
            labels = again


def linked(values: np.ndarray, sizes: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a value and the first of its group) that join all values of a bucket that close pairs connect."""
    order = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    sizes = sizes[order]
    at = np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))
    values, labels = values[at], np.arange(len(values))
    firsts, seconds, waiting = [], [], 0
    for a, b in close_pairs(values, sizes, bits, radius):
        firsts.append(a)
        seconds.append(b)
        waiting += len(a)
        if waiting > WAITING:
            labels = merged(labels, np.concatenate(firsts), np.concatenate(seconds))
            firsts, seconds, waiting = [], [], 0
    if waiting:
        labels = merged(labels, np.concatenate(firsts), np.concatenate(seconds))
    own = labels != np.arange(len(values))
    return values[own], values[labels[own]]


def _compared(keyed: DataFrame, radius: int) -> DataFrame:
    """Links a, b of fingerprints (mask, value, fp): buckets are sorted together and streamed in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def blocks(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts = np.concatenate([[0], cuts])
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            some = sizes > 1
            starts, sizes = starts[some], sizes[some]
            of_mask = rows[starts, 0]
            for mask in np.unique(of_mask):
                own = np.flatnonzero(of_mask == mask)
                total = np.cumsum(sizes[own])
                for part in np.unique(total // BLOCK):
                    buckets = own[total // BLOCK == part]
                    n = sizes[buckets]
                    at = np.repeat(starts[buckets] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    bits = [b for b in range(BITS) if not int(mask) >> b & 1]
                    a, b = linked(rows[at, 2].view(np.uint64), n, bits, radius)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        waiting = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))
            waiting += b.num_rows
            if waiting < BLOCK:
                continue
            rows = np.concatenate(held)
            # The last bucket may go on in the next batch.
            same = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from blocks(rows[:last])
                held, waiting = [rows[last:]], len(rows) - last
            else:
                held = [rows]
        if held:
            yield from blocks(np.concatenate(held))

    parted = keyed.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return parted.select("mask", "value", "fp").mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` which lie within ``radius`` bits, directly or over others.

    Within a bucket a group of close fingerprints gets a link of each to one of them, not all
    its pairs.  A table that is empty or has one row gives none.
    """
    steps = Steps(prints.sparkSession)
    level = {m: m for m in masks((1 << BITS) - 1, radius)}
    keyed = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in level])).alias("mask"))
    found = None
    while True:
        keyed = keyed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        final = all(BITS - m.bit_count() <= FREE for m in level)
        if final:
            links = _compared(keyed, radius)
            return links if found is None else found.unionByName(links)
        sizes = keyed.groupBy("mask", "value").count()
        large = steps.store(sizes.filter(F.col("count") > BUCKET).select("mask", "value"), f"large-{len(level)}")
        n = large.count()
        few = F.broadcast(large) if n <= BROADCAST_KEYS else large
        small = _compared(keyed.join(few, ["mask", "value"], "left_anti") if n else keyed, radius)
        found = small if found is None else found.unionByName(small)
        if not n:
            return found
        below = {m: [m | x for x in masks((1 << BITS) - 1 & ~m, radius)] for m in level}
        longer = F.create_map(*[x for m, more in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in more]))])
        keyed = keyed.join(few, ["mask", "value"], "left_semi").select("fp", F.explode(longer[F.col("mask")]).alias("mask"))
        level = {y: y for more in below.values() for y in more}


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(``id_col``, fp, component_id) of every row: the smallest id that links of ``radius`` bits or fewer reach.

    Equal fingerprints are linked, those of texts without words (0) too.  Null ids are kept
    and are never the smallest; a component of null ids alone has a null one.  An
    empty table gives no rows.
    """
    steps = Steps(docs.sparkSession)
    rows = steps.store(add_fingerprint(docs.select(id_col, text_col), text_col, "fp").select(id_col, "fp"), "prints")
    prints = steps.store(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    groups = connected_components(near_links(prints.select("fp"), radius))
    named = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = steps.store(named.join(least, "component").select("fp", "component_id"), "found")
    steps.drop("distinct")
    # Copies of one text share a fingerprint; adaptive execution splits its rows of this join.
    return rows.join(found, "fp")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and its component at two bits or fewer."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
