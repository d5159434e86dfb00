"""Removal of every byte string of a threshold length that occurs again, by depth-limited radix sorting.

Suffixes are ordered only through ``threshold`` bytes; suffixes equal so far are exactly the
repeated windows.  The digits of a window are taken from the most significant one on:

1. Its anchor: the k-gram of smallest hash in it, the leftmost one.  Equal windows have equal
   anchors at equal places.  Windows whose anchor occurs nowhere else are done; of a corpus
   without repeats nothing else is read.
2. All windows of an anchor lie within its context, the bytes around it.  Members of an
   anchor's group whose contexts are equal agree in all windows and count once from there on.
3. While a group has more than ``GROUP`` different contexts, its windows are halved by where
   the anchor stands in them; each half is grouped anew by the bytes that all its windows
   share, and equal halves are settled as before.  A pass only counts and joins by hash.
4. Groups within the bound compare all their windows in one task: hashes order them, and
   neighbours of equal hashes are compared by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollhouse.llm import words as W
from tollhouse.llm.common import Steps, deleted, shared_dir, split_count, stored
from tollhouse.llm.shingles import flat_bytes, mix, powers

THRESHOLD = 400
GRAM = 32
#: Different contexts that one task compares.
GROUP = 256
#: Rows of one anchor, or copies of one context, that a task of a shuffle may meet; above 2^16 times as many members, a 2^16th of those.
OFTEN = 10_000
#: Copies of one text that a task of a shuffle may meet; above 2^16 times as many rows, a 2^16th of those.
COMMON = 1_000
#: Pairs of contexts that are compared byte by byte at once.
PAIRS = 2048
#: Bytes that are searched for anchors at once.
PIECE = 1 << 22
_PLACE = np.uint64((1 << 27) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on (a power of two), by doubling."""
    h = raw.astype(np.uint64) + np.uint64(1)
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < GRAM and len(h) > step:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor & (1 << 64) - 1
        step *= 2
    return mix(h) if step == GRAM else h[:0]


def anchors(raw: np.ndarray, bounds: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows within one text each, and their hashes.

    Long texts are read in pieces that share ``threshold - 1`` bytes, so each window lies whole in one.
    """
    if len(raw) <= max(PIECE, 2 * threshold):
        return _piece_anchors(raw, bounds, threshold)
    size = max(PIECE, 2 * threshold)
    places, hashes = [], []
    for a in range(0, len(raw) - threshold + 1, size - threshold + 1):
        b = min(a + size, len(raw))
        place, h = _piece_anchors(raw[a:b], np.clip(bounds, a, b) - a, threshold)
        places.append(place + a)
        hashes.append(h)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _piece_anchors(raw: np.ndarray, bounds: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    width = threshold - GRAM + 1
    hashes = gram_hashes(raw)
    if len(hashes) < width:
        return np.empty(0, np.int64), hashes[:0]
    keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(keyed) // width) * width, ~np.uint64(0))
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keyed) - width + 1
    lowest = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    inside = np.zeros(n + 1, dtype=np.int32)
    long = np.diff(bounds) >= threshold
    inside[bounds[:-1][long]] += 1
    inside[np.minimum(bounds[1:][long] - threshold + 1, n)] -= 1
    place = (lowest[np.cumsum(inside[:n]) > 0] & _PLACE).astype(np.int64)
    place = place[np.concatenate([[True], np.diff(place) > 0])] if len(place) else place
    return place, hashes[place]


def text_id(text: Column) -> Column:
    """First hash of a text."""
    return F.xxhash64(text)


def _anchor_rows(texts: DataFrame, threshold: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        for batch in batches:
            for a, b in W.slices(batch["text"], 1_000_000):
                part = batch.slice(a, b - a)
                raw, bounds = flat_bytes(part["text"])
                place, hashes = anchors(raw, bounds, threshold)
                of = np.searchsorted(bounds, place, side="right") - 1
                tid = part["tid"].to_numpy(zero_copy_only=False)[of]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(tid), pa.array((place - bounds[of]).astype(np.int32))], ["h", "tid", "at"])

    return texts.select("tid", "text").mapInArrow(run, "h long, tid long, at int")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _members(found: DataFrame, threshold: int) -> DataFrame:
    """A row per anchor occurrence: its group, the hash of its context, and the context where it is the task's first of its kind."""
    left = threshold - GRAM

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        seen: set[tuple[int, int]] = set()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        names = ["key", "kind", "tid", "at", "before", "after", "context"]
        for batch in batches:
            rows: list[tuple] = []
            for tid, text, places in zip(batch["tid"].to_pylist(), batch["text"], batch["places"].to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for p in places:
                    h, at = p["h"], p["at"]
                    start = max(0, at - left)
                    context = raw[start : at + threshold]
                    before, after = at - start, len(context) - (at - start)
                    kind = _signed(xxhash.xxh3_64_intdigest(context, before))
                    fresh = (h, kind) not in seen
                    if fresh:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add((h, kind))
                    rows.append((h, kind, tid, at, before, after, context if fresh else None))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return found.mapInArrow(run, "key long, kind long, tid long, at int, before int, after int, context binary")


def _halved(groups: DataFrame, threshold: int) -> DataFrame:
    """Each row twice, for the windows in which the anchor stands early or late, where it has such windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        for batch in batches:
            rows: list[dict] = []
            for x in batch.to_pylist():
                middle = (x["low"] + x["high"]) // 2
                for low, high in ((x["low"], middle), (middle + 1, x["high"])):
                    b, a, c = x["before"], x["after"], x["context"]
                    if low > high or b < low or a < threshold - high or b + a < threshold:
                        continue
                    shared = c[b - low : b + threshold - high]
                    most_b, most_a = min(b, high), min(a, threshold - low)
                    whole = c[b - most_b : b + most_a]
                    key = xxhash.xxh3_64_intdigest(shared, (x["key"] ^ low << 20 ^ high << 40) & (1 << 64) - 1)
                    rows.append(x | {"key": _signed(key), "kind": _signed(xxhash.xxh3_64_intdigest(whole, most_b)), "low": low, "high": high})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return groups.mapInArrow(run, groups.schema)


def _agree(a: np.ndarray, b: np.ndarray, starts: np.ndarray, threshold: int) -> np.ndarray:
    """For each pair of rows and each start: whether the ``threshold`` bytes from there on are the same."""
    out = np.empty((len(a), len(starts)), dtype=bool)
    for i in range(0, len(a), PAIRS):
        same = a[i : i + PAIRS] == b[i : i + PAIRS]
        sums = np.zeros((len(same), same.shape[1] + 1), dtype=np.int32)
        np.cumsum(same, axis=1, out=sums[:, 1:])
        out[i : i + PAIRS] = sums[:, starts + threshold] - sums[:, starts] == threshold
    return out


def window_hashes(table: np.ndarray, starts: np.ndarray, threshold: int) -> np.ndarray:
    """Hashes by which windows are ordered; whether they are equal is decided by their bytes."""
    size = table.shape[1]
    sums = np.zeros((len(table), size + 1), dtype=np.uint64)
    np.cumsum(table * powers(size)[:size], axis=1, out=sums[:, 1:])
    return sums[:, starts + threshold] - sums[:, starts]


def _repeated(table: np.ndarray, valid: np.ndarray, starts: np.ndarray, threshold: int) -> np.ndarray:
    """Which rows' windows, for each start, are those of another row too: neighbours in the order of hashes, compared by their bytes."""
    n = len(table)
    hashes = window_hashes(table, starts, threshold)
    hashes[~valid] = mix(np.arange(np.count_nonzero(~valid), dtype=np.uint64) + np.uint64(1 << 40))
    order = np.argsort(hashes, axis=0, kind="stable")
    ordered = np.take_along_axis(hashes, order, axis=0)
    row, column = np.nonzero(ordered[1:] == ordered[:-1])
    one, two = order[row, column], order[row + 1, column]
    pairs, of = np.unique(one * n + two, return_inverse=True)
    equal = _agree(table[pairs // n], table[pairs % n], starts, threshold)[of, column] & valid[one, column] & valid[two, column]
    again = np.zeros_like(valid)
    again[one, column] = True
    again[two, column] = True
    for k in np.unique(column[~equal]).tolist():
        # Different windows of one hash: this start's are told by their bytes alone.
        whole = [table[i, starts[k] : starts[k] + threshold].tobytes() if valid[i, k] else None for i in range(n)]
        counts = Counter(whole)
        again[:, k] = [w is not None and counts[w] > 1 for w in whole]
    return again


def _windows(rows: list[dict], threshold: int) -> list[tuple[int, int, int, int]]:
    """(own key, own kind, from, to) of repeated stretches around the anchors of one group, for members not settled before."""
    left = threshold - GRAM
    low, high = rows[0]["low"], rows[0]["high"]
    n, size = len(rows), left + threshold
    table = np.zeros((n, size), dtype=np.uint8)
    before = np.array([r["before"] for r in rows])
    after = np.array([r["after"] for r in rows])
    for i, r in enumerate(rows):
        table[i, left - r["before"] : left + r["after"]] = np.frombuffer(r["context"], dtype=np.uint8)
    x = np.arange(low, high + 1)
    valid = (before[:, None] >= x) & (after[:, None] >= threshold - x)
    if n == 2:
        again = np.broadcast_to(_agree(table[:1], table[1:], left - x, threshold) & valid.all(axis=0), valid.shape)
    else:
        again = _repeated(table, valid, left - x, threshold)
    out = []
    for i in np.flatnonzero(again.any(axis=1)).tolist():
        if rows[i]["copies"] > 1:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], again[i].view(np.int8), [0]])))
        for a, b in zip((edges[::2] + low).tolist(), (edges[1::2] + low - 1).tolist(), strict=True):
            out.append((rows[i]["own_key"], rows[i]["own_kind"], -b, threshold - a))
    return out


def _compared(groups: DataFrame, threshold: int) -> DataFrame:
    """Repeated stretches of groups within the bound."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        held: list[dict] = []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "kind", "from", "to"])

        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if held and held[0]["key"] != row["key"]:
                    found += _windows(held, threshold)
                    held = []
                held.append(row)
            yield batch_of(found)
        if held:
            yield batch_of(_windows(held, threshold))

    n = split_count(groups)
    return groups.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "key long, kind long, from int, to int")


def _spans(texts: DataFrame, threshold: int) -> DataFrame:
    """(tid, from, to) of repeated bytes of different texts, overlapping."""
    steps = Steps(texts.sparkSession)
    places = steps.store(_anchor_rows(texts, threshold), "anchors")
    again = steps.store(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    # Anchors of very many rows, of which there are 65,535 at most, need no shuffle of their rows.
    many = max(OFTEN, (again.agg(F.sum("n")).first()[0] or 0) >> 16)
    hot_anchors = F.broadcast(again.filter(F.col("n") > many).select("h"))
    met = places.join(hot_anchors, "h", "left_anti").join(again.filter(F.col("n") <= many).select("h"), "h")
    met = met.unionByName(places.join(hot_anchors, "h", "left_semi"))
    shared = met.groupBy("tid").agg(F.collect_list(F.struct("h", "at")).alias("places"))
    members = steps.store(_members(texts.join(shared, "tid").select("tid", "text", "places"), threshold), "members")
    steps.drop("anchors", "again")
    kinds = steps.store(members.groupBy("key", "kind").agg(F.count("*").alias("copies")), "kinds")
    # Contexts of very many copies, of which there are 65,535 at most, need no shuffle of their members.
    often = max(OFTEN, (kinds.agg(F.sum("copies")).first()[0] or 0) >> 16)
    hot = F.broadcast(kinds.filter(F.col("copies") > often).select("key", "kind"))
    slim = members.drop("context").filter(F.col("before") + F.col("after") >= threshold)
    cold = slim.join(hot, ["key", "kind"], "left_anti")
    rare = cold.join(kinds.filter((F.col("copies") > 1) & (F.col("copies") <= often)).drop("copies"), ["key", "kind"])
    whole = slim.join(hot, ["key", "kind"], "left_semi").unionByName(rare)
    spans = whole.select("tid", (F.col("at") - F.col("before")).alias("from"), (F.col("at") + F.col("after")).alias("to"))

    left = threshold - GRAM
    contexts = members.filter("context IS NOT NULL").dropDuplicates(["key", "kind"]).join(kinds, ["key", "kind"])
    rows = contexts.select("key", "kind", F.col("key").alias("own_key"), F.col("kind").alias("own_kind"), "copies", F.lit(0).alias("low"), F.lit(left).alias("high"), "before", "after", "context")
    levels: list[DataFrame] = []
    for depth in range(2 + left.bit_length()):
        classes = steps.store(rows.groupBy("key", "kind").agg(F.sum("copies").alias("all"), F.min(F.struct("own_key", "own_kind")).alias("one")), "classes")
        of_key = classes.groupBy("key").agg(F.count("*").alias("different"), F.min("all").alias("fewest"))
        if depth:
            met = rows.filter("copies = 1").drop("context").join(classes.filter("`all` > 1").drop("one"), ["key", "kind"])
            met = met.select("own_key", "own_kind", (-F.least("high", "before")).alias("from"), F.least(threshold - F.col("low"), F.col("after")).alias("to")).filter(F.col("to") - F.col("from") >= threshold)
            met = met.select(F.col("own_key").alias("key"), F.col("own_kind").alias("kind"), "from", "to")
        # Which classes are compared is settled before their contexts move.
        of_key = steps.store(of_key.filter("different > 1"), "keys")
        many_kinds = of_key.filter(F.col("different") > often)
        met_keys = of_key.filter("fewest = 1").select("key", "different")
        wanted = classes.join(F.broadcast(many_kinds.select("key")), "key", "left_anti").join(met_keys.filter(F.col("different") <= often), "key")
        wanted = wanted.unionByName(classes.join(F.broadcast(many_kinds.filter("fewest = 1").select("key", "different")), "key"))
        ones = rows.join(wanted, ["key", "kind"]).filter((F.col("own_key") == F.col("one.own_key")) & (F.col("own_kind") == F.col("one.own_kind")))
        ones = steps.store(ones.withColumn("copies", F.col("all")).drop("all", "one"), "groups")
        small = _compared(ones.filter(F.col("different") <= GROUP).drop("different"), threshold)
        levels.append(steps.store(small.unionByName(met) if depth else small, f"found-{depth}"))
        large = ones.filter(F.col("different") > GROUP).drop("different")
        if large.isEmpty():
            break
        rows = steps.store(_halved(large, threshold), "halves")
    steps.drop("groups", "halves", "classes", "keys")
    found = reduce(DataFrame.unionByName, levels)
    single = cold.join(kinds.filter("copies = 1"), ["key", "kind"]).select("key", "kind", "tid", "at")
    return spans.unionByName(found.join(single, ["key", "kind"]).select("tid", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to")))


def _kept(rows: DataFrame, names: list[str], threshold: int, with_text: bool, decoded: bool) -> DataFrame:
    """The columns ``names`` and what is left of each text; ``__spans`` lists what repeats, ``__copies`` how often the whole text occurs."""
    kind, made = ("string", pa.string()) if decoded else ("binary", pa.binary())
    schema = rows.select(*names).schema.add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    schema = schema.add("kept", kind) if with_text else schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        for batch in batches:
            for a, b in W.slices(batch["__text"]):
                part = batch.slice(a, b - a)
                removed, counts, digests, left = [], [], [], []
                for text, copies, n, spans in zip(part["__text"].to_pylist(), part["__copies"].to_pylist(), part["n_bytes"].to_pylist(), part["__spans"].to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    if copies > 1:
                        kept, merged = raw if n < threshold else b"", [[0, n]] * (n >= threshold)
                    else:
                        merged = []
                        for s in sorted((s["from"], s["to"]) for s in spans or ()):
                            if merged and s[0] <= merged[-1][1]:
                                merged[-1][1] = max(merged[-1][1], s[1])
                            else:
                                merged.append([*s])
                        ends = [0, *(e for _, e in merged)]
                        kept = b"".join(raw[e:s] for e, (s, _) in zip(ends, [*merged, (len(raw), 0)], strict=True)) if merged else raw
                    removed.append(n - len(kept))
                    counts.append(len(merged))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept.decode("utf-8", "ignore") if decoded else kept)
                columns = [*(part[n] for n in names), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(left, made)] if with_text else columns, [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _texts(own: DataFrame, text: Column, parts: int) -> tuple[DataFrame, DataFrame]:
    """``own`` and its different texts (tid, text, copies), stored in buckets; no two texts share an id.

    Where the first hash of different texts is equal, which the second one tells, those take
    an id of both hashes, until none meet.
    """
    spark = own.sparkSession
    while True:
        name, path = f"texts_{uuid.uuid4().hex}", shared_dir(spark, "texts")
        other = [F.min("__other").alias("low"), F.max("__other").alias("high")]
        texts = own.select(F.col("__tid").alias("tid"), "__other", text.alias("text")).groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies"), *other)
        texts.write.bucketBy(parts, "tid").option("path", path).option("compression", "zstd").saveAsTable(name)
        met = spark.table(name).filter("low <> high").select(F.col("tid").alias("__met"))
        n_met = met.count()
        if not n_met:
            return own, spark.table(name).drop("low", "high")
        # Some pairs at 10^10 texts.
        met = stored(met, "met")
        own = own.join(F.broadcast(met) if n_met <= 100_000 else met, F.col("__tid") == F.col("__met"), "left")
        own = own.withColumn("__tid", F.when(F.col("__met").isNull(), F.col("__tid")).otherwise(F.xxhash64("__tid", "__other"))).drop("__met")
        spark.sql(f"DROP TABLE {name}")
        deleted(spark, path)


def remove_repeats(docs: DataFrame, text_col: str = "text", threshold: int = THRESHOLD, with_text: bool = True, decoded: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, the kept bytes as ``kept``.

    ``decoded`` gives them as text, without characters of which only some bytes are kept; null stays null.

    The column of the text itself is left out.  A byte is removed if a string of ``threshold`` bytes that covers it starts anywhere else
    too, in its own text or another's.  Texts are UTF-8; null is empty.  Texts shorter than
    the threshold lose nothing; repeated rows of longer texts lose everything.  Columns of
    the new names are replaced, all others pass through.  Texts are told apart by two 64-bit hashes.
    """
    if threshold < 2 * GRAM:
        raise ValueError(f"the threshold is {2 * GRAM} bytes at least")
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.drop(*new).withColumns({"__tid": text_id(text), "__other": F.xxhash64(F.lit(1), text), "n_bytes": F.octet_length(text).cast("long")})
    own, texts = _texts(own, text, split_count(docs))
    spans = _spans(texts, threshold).groupBy("tid").agg(F.collect_set(F.struct("from", "to")).alias("__spans"))
    # From here on a text moves no more: rows join the one in its bucket, and rows of repeated texts need none, or a short one.
    names = [c for c in own.columns if c not in (text_col, "__tid", "__other")]
    rows = own.select("__tid", *[F.col(f"`{c}`") for c in names], F.when(F.col("n_bytes") < threshold, text).alias("__text"), F.col(f"`{text_col}`").isNull().alias("__null"))
    # Rows of texts of very many copies, of which there are 65,535 at most, need no text of a bucket and are dealt evenly.
    many = max(COMMON, (texts.agg(F.sum("copies")).first()[0] or 0) >> 16)
    common = texts.filter(F.col("copies") > many).select(F.col("tid").alias("__tid"), F.col("copies").alias("__common"))
    rows = rows.join(F.broadcast(common), "__tid", "left")
    rows = rows.withColumn("__tid", F.when(F.col("__common").isNull(), F.col("__tid")).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    rows = rows.join(texts.filter("copies > 1").select(F.col("tid").alias("__tid"), F.col("copies").alias("__copies")), "__tid", "left")
    rows = rows.withColumn("__copies", F.coalesce("__common", "__copies")).drop("__common")
    several = rows.filter("__copies > 1").withColumn("__spans", F.lit(None).cast("array<struct<from:int,to:int>>"))
    single = rows.filter("__copies IS NULL").drop("__text", "__copies").join(texts.filter("copies = 1").select(F.col("tid").alias("__tid"), F.col("text").alias("__text"), F.col("copies").alias("__copies")), "__tid")
    single = single.join(spans.withColumnRenamed("tid", "__tid"), "__tid", "left")
    columns = [*names, "__null"]
    done = _kept(single.select(*columns, "__text", "__copies", "__spans").unionByName(several.select(*columns, "__text", "__copies", "__spans")), columns, threshold, with_text, decoded)
    if not with_text:
        return done.drop("__null")
    return done.withColumn("kept", F.when(~F.col("__null"), F.col("kept")) if decoded else F.col("kept")).drop("__null")


def op7_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 400 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
