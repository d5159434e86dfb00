"""Exact self-join of documents on the Jaccard similarity of their word shingles.

Adaptive multi-match prefixes.  All documents order their shingles alike, frequent ones
last.  If two sets of sizes m <= n reach similarity t, they share O >= t/(1+t)*(m+n) shingles,
and the first m-O+l and n-O+l of them share l at least, for every l.  Each document chooses
its l from 1 to ``LEVELS`` by estimated cost: the postings that it would read plus the
candidates, at most postings / l, that it would verify, times its size.

* Documents with equal sets form one class beforehand; a class counts once.  Its node is the
  number of a row, so no hash of a set stands for it.
* A posting is shuffled by shingle with its node, place and size alone; those of shingles
  that no other document has go before anything else is attached.
* Before all candidates are formed, each class is compared with a few classes that share its
  shingles, and classes so linked are labelled by component.  Candidates are then formed
  only between components: large families of near copies take linear work, and no link
  between components is lost.
* Shingles listed as frequent are counted by partial sums, and their postings are dealt to
  blocks of ``HOT``, each with a pivot of its own; candidates are formed of a block and the
  others.  A shingle that is not listed has a 65,536th of all at most.
* Candidates are verified on their whole sets, made anew from texts that move compressed, to
  the candidate's partner; partners of many candidates are split.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollhouse.llm import words as W
from tollhouse.llm.common import Steps
from tollhouse.llm.components import connected_components
from tollhouse.llm.shingles import mix, text_shingles

LEVELS = 4
#: Shingles known as frequent: a bounded list (1 MB) that decides order only, never results.
FREQUENT = 1 << 17
#: Shingles counted together in a task before the counts are shuffled.
CHUNK_SHINGLES = 2_000_000
#: A comparison of one shingle against reading one posting.
VERIFY_COST = 1 / 8
#: Rounds of comparisons with a few classes at most; another one runs while there are more candidates a posting than
#: ``MANY`` and the last one found more than this share of all links so far.  They save work and decide no result.
ROUNDS, MANY, LEAST_GAIN = 4, 4, 0.05
#: Columns of a set's parity bits.
SKETCH = ("p0", "p1", "p2", "p3")
#: Characters of text handled at once in a task.
SLICE = 500_000
#: Postings of shingles that more documents have carry the sets' parity bits.
SKETCHED = 32
#: Candidates of one partner that are compared with it in one task.
TOGETHER = 256
#: Up to so many ids (some 50 bytes each) or labels (16 bytes) are broadcast; beyond, a shuffle join does.
BROADCAST_IDS = 500_000
#: Postings of one shingle that meet in one task; those of listed shingles that have more are dealt to blocks.
HOT = 10_000
#: Different sets that a task remembers, so that copies that it meets again give no postings.
REMEMBERED = 300_000


def _counts(docs: DataFrame, width: int) -> DataFrame:
    """(shingle, documents) of shingles that repeat within a task's documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n >= 3], n[n >= 3]
            if len(found) > FREQUENT // 2:
                top = np.argpartition(n, len(n) - FREQUENT // 2)[-(FREQUENT // 2) :]
                found, n = found[top], n[top]
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for a, b in W.slices(batch["text"], SLICE):
                held.append(text_shingles(batch["text"].slice(a, b - a), width)[0])
                size += len(held[-1])
                if size >= CHUNK_SHINGLES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _sets(docs: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """node, doc_id, row hash, set size, set hashes, parity bits and the prefix in the common order, null where the task gave it before."""
    order = np.argsort(frequent)
    listed, place = frequent[order], order

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b in W.slices(batch["text"], SLICE):
                part = batch.slice(a, b - a)
                flat, bounds = text_shingles(part["text"], width)
                mixed = mix(flat ^ np.uint64(0xD6E8FEB86659FD93))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (flat, mixed)]
                ones, twos = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                n = np.diff(bounds)
                sketch = _sketches(flat, bounds)
                rank = np.zeros(len(flat), dtype=np.int64)
                if len(listed) and len(flat):
                    at = np.minimum(np.searchsorted(listed, flat), len(listed) - 1)
                    hit = listed[at] == flat
                    rank[hit] = len(listed) - place[at[hit]]
                prefixes = []
                for i, j, key in zip(bounds.tolist(), bounds[1:].tolist(), zip(ones.tolist(), twos.tolist(), strict=True), strict=False):
                    if key in met:
                        prefixes.append(None)
                        continue
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met.add(key)
                    size = j - i
                    take = min(size, size - -(-num * size // den) + LEVELS)
                    r = rank[i:j]
                    own = flat[i:j] if not r.any() else flat[i:j][np.argsort(r, kind="stable")]
                    prefixes.append(own[:take].view(np.int64))
                missing = np.array([p is None for p in prefixes] + [False], dtype=bool)
                ends = np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in prefixes])])
                values = pa.array(np.concatenate([*(p for p in prefixes if p is not None), np.empty(0, np.int64)]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=missing), values)
                columns = [part["node"], part["doc_id"], part["row"], pa.array(n), pa.array(ones.view(np.int64)), pa.array(twos.view(np.int64)), *map(pa.array, sketch), lists]
                yield pa.RecordBatch.from_arrays(columns, ["node", "doc_id", "row", "n", "h1", "h2", *SKETCH, "prefix"])

    fields = f"node long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, n long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in SKETCH) + ", prefix array<long>"
    return docs.select(F.monotonically_increasing_id().alias("node"), "doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, fields)


def _sketches(flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Per set, 256 parity bits in four columns: two sketches differ in no more bits than the sets differ in shingles."""
    out = [np.zeros(len(bounds) - 1, dtype=np.int64) for _ in SKETCH]
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        bit = np.uint64(1) << (flat >> np.uint64(56) & np.uint64(63))
        word = flat >> np.uint64(62)
        for i, column in enumerate(out):
            column[some] = np.bitwise_xor.reduceat(np.where(word == i, bit, np.uint64(0)), bounds[some]).view(np.int64)
    return out


def _differ(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return reduce(add, [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in SKETCH])


def _moved(docs: DataFrame, moves: DataFrame, few: bool) -> DataFrame:
    """(b, part, own, node, text) for each of ``moves`` (node, b, part, own, doc_id, row), the text compressed."""
    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64("text"))
    ids = moves.select("node", "b", "part", "own", F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
    texts = rows.join(F.broadcast(ids) if few else ids, rows.doc_id.eqNullSafe(F.col("__id")) & (rows.row == F.col("__row"))).select("b", "part", "own", "node", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        pack = zstandard.ZstdCompressor().compress
        met: set[tuple] = set()
        for batch in batches:
            # The very row that stands for a class may be repeated.
            keys = list(zip(*(batch[c].to_pylist() for c in ("b", "part", "own", "node")), strict=True))
            fresh = [k not in met and not met.add(k) for k in keys]
            met = met if len(met) < REMEMBERED else set()
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for a, b in W.slices(batch["text"], SLICE):
                part = batch.slice(a, b - a)
                packed = pa.array([pack(t.as_py().encode("utf-8", "surrogatepass")) for t in part["text"]], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("b", "part", "own", "node")), packed], ["b", "part", "own", "node", "packed"])

    return texts.mapInArrow(run, "b long, part int, own boolean, node long, packed binary")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, steps: Steps, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity."""
    pairs = steps.store(pairs, "pairs")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    moves = dealt.select(F.col("a").alias("node"), "b", "part", F.lit(False).alias("own"))
    moves = moves.unionByName(dealt.select(F.col("b").alias("node"), "b", "part", F.lit(True).alias("own")).distinct())
    moves = steps.store(moves.join(classes.select("node", "own.doc_id", "own.row"), "node"), "moves")
    moved = _moved(docs, moves, moves.count() <= BROADCAST_IDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        W.release()
        unpack = zstandard.ZstdDecompressor().decompress
        key, own, last = None, np.empty(0, np.uint64), None
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for b, part, is_own, node, packed in zip(*(batch[c].to_pylist() for c in ("b", "part", "own", "node")), batch["packed"], strict=True):
                # Another task may have met the same row.
                if last == (b, part, is_own, node):
                    continue
                last = (b, part, is_own, node)
                flat = text_shingles(pa.array([unpack(packed.as_py()).decode("utf-8", "surrogatepass")], pa.large_string()), width)[0]
                if is_own:
                    key, own = (b, part), flat
                    continue
                if key != (b, part):
                    raise RuntimeError("a candidate came without its partner")
                shared = len(np.intersect1d(own, flat, assume_unique=True))
                if shared * den >= (len(own) + len(flat) - shared) * num:
                    found[0].append(node)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return moved.repartition("b", "part").sortWithinPartitions("b", "part", F.desc("own"), "node").mapInArrow(run, "a long, b long")


def _tried(marked: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """A pair for each class: of the pivots of its shingles, in another component, the one that most of them name, twice at least."""
    # Few rarer shingles before a common one: a text that others were made from, rather than one of its altered copies.
    order = Window.partitionBy("shingle", _block()).orderBy("at", F.xxhash64("node", F.lit(turn)), "node")
    own = F.struct("node", "n", "at", "component", *SKETCH)
    near = marked.withColumn("p", F.first(own).over(order)).filter("component <> p.component").filter((F.col("n") * den >= F.col("p.n") * num) & (F.col("p.n") * den >= F.col("n") * num))
    shared = F.ceil((F.col("n") + F.col("p.n")) * num / (num + den))
    near = near.filter((F.col("at") <= F.col("n") - shared + LEVELS - 1) & (F.col("p.at") <= F.col("p.n") - shared + LEVELS - 1))
    near = near.filter(_differ("", "p.") <= F.col("n") + F.col("p.n") - 2 * shared)
    named = near.groupBy("node", F.col("p.node").alias("b")).agg(F.count("*").alias("same")).filter("same > 1")
    return named.groupBy("node").agg(F.max(F.struct("same", "b")).alias("p")).select(F.col("node").alias("a"), "p.b")


def _block(of: str = "") -> Column:
    """The block of its shingle's postings in which a posting is."""
    return F.pmod(F.xxhash64(f"{of}node"), F.col(f"{of}blocks")).cast("int")


def _postings(rows: DataFrame, classes: DataFrame, listed: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n, at, shingle, all, blocks, level, parity bits) of the shingles that several rows have.

    ``all`` counts the shingle's postings, ``level`` is the class's chosen l.
    """
    # Sets of n and n+1 shingles reach n/(n+1) at best: smaller ones link only with their equals.
    least = next(n for n in range(1, 1 << 20) if n * den >= num * (n + 1))
    places = rows.filter(F.col("n") >= least).select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "shingle"))
    hot = places.join(F.broadcast(listed), "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("often")).filter(F.col("often") > HOT)
    met = places.join(F.broadcast(hot), "shingle", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("often") / HOT), F.lit(1)).cast("int"))
    met = met.withColumn("df", F.coalesce("often", F.count("*").over(Window.partitionBy("shingle", _block())))).filter("df > 1").drop("often")
    own = met.join(classes.select("node", *SKETCH), "node")
    n, of_node = F.col("n"), Window.partitionBy("node")
    probe = _probe(num, den)
    cost = [F.coalesce(F.sum(F.when(probe <= k, F.col("df"))).over(of_node) * (1 + n * VERIFY_COST / k), F.lit(0.0)) for k in range(1, LEVELS + 1)]
    chosen = own.withColumn("cost", F.array(*cost)).withColumn("level", F.array_position("cost", F.array_min("cost")).cast("int"))
    return chosen.select("node", "n", "at", "shingle", F.col("df").alias("all"), "blocks", "level", *[F.when(F.col("df") > SKETCHED, F.col(c)).otherwise(F.lit(0)).alias(c) for c in SKETCH])


def _probe(num: int, den: int, of: str = "") -> Column:
    """The least l for which a posting's place lies in the prefix against smaller sets."""
    n = F.col(f"{of}n")
    return F.greatest(F.lit(1), F.col(f"{of}at") + 1 - n + F.ceil(n * num / den))


def _index(num: int, den: int, of: str = "") -> Column:
    """The least l for which a posting's place lies in the prefix against larger sets."""
    n = F.col(f"{of}n")
    return F.greatest(F.lit(1), F.col(f"{of}at") + 1 - n + F.ceil(n * 2 * num / (num + den)))


def _labelled(postings: DataFrame, links: DataFrame) -> DataFrame:
    """The postings of shingles of several components, with component and same, the postings of shingle and component (for blocks an estimate)."""
    labels = connected_components(links).select("node", F.col("component").alias("label"))
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_IDS else labels
    marked = postings.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    whole = marked.filter("blocks > 1").groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low = high")
    marked = marked.join(F.broadcast(whole.select("shingle")), "shingle", "left_anti")
    inside = F.count("*").over(Window.partitionBy("shingle", "component", _block()))
    return marked.withColumn("same", F.least("all", 1 + (inside - 1) * F.col("blocks"))).filter("blocks > 1 OR `all` > same")


def jaccard_rows(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """``jaccard_components`` with row, the hash of the row's text, and component_row, that of the row which stands for its component.

    The row that stands for a component is that of its smallest key, of those with equal
    keys the one of the smallest hash; a row without shingles stands for itself.
    """
    steps = Steps(docs.sparkSession)
    docs = docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    top = steps.store(_counts(docs, width).orderBy(F.desc("n"), "shingle").limit(FREQUENT), "top").orderBy(F.desc("n"), "shingle")
    frequent = top.select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    sets = steps.store(_sets(docs, width, num, den, frequent), "sets")
    rows = steps.store(sets.select("doc_id", "row", "n", "h1", "h2"), "rows")
    classes = sets.filter("n > 0").groupBy("h1", "h2", "n").agg(
        F.min(F.struct("node", "doc_id", "row")).alias("own"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"),
        *[F.first(c).alias(c) for c in SKETCH],
    )
    classes = steps.store(classes.withColumn("node", F.col("own.node")), "classes")
    postings = steps.store(_postings(sets, classes, top.filter(F.col("n") > HOT).select("shingle"), num, den), "postings")
    steps.drop("sets", "top")

    links, known = None, 0
    marked = postings.withColumn("component", F.col("node"))
    for turn in range(ROUNDS):
        found = _verified(_tried(marked, turn, num, den), docs, classes, steps, width, num, den)
        links = steps.store(found if links is None else links.unionByName(found), "found")
        marked = steps.store(_labelled(postings, links), "marked")
        # Pairs of postings of different components, and postings.
        left, places = marked.agg(F.sum(F.col("all") - F.col("same")) / 2, F.count("*")).first()
        before, known = known, links.count()
        if (left or 0) <= MANY * places or known - before <= known * LEAST_GAIN:
            break
    steps.drop("postings")

    # Each block of a shingle's postings meets all of its postings.
    s = marked.withColumn("block", _block()).alias("s")
    r = marked.filter(_index(num, den) <= LEVELS).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("r")
    smaller = (F.col("r.n") < F.col("s.n")) | ((F.col("r.n") == F.col("s.n")) & (F.col("r.node") < F.col("s.node")))
    # Of the shingles that a linked pair shares, the l first lie within these places of both, for its own sizes.
    shared = F.ceil((F.col("s.n") + F.col("r.n")) * num / (num + den))
    early = (F.col("s.at") <= F.col("s.n") - shared + F.col("s.level") - 1) & (F.col("r.at") <= F.col("r.n") - shared + F.col("s.level") - 1)
    # Nor can sets of these sizes differ more than that leaves open.
    early = early & (_differ("s.", "r.") <= F.col("s.n") + F.col("r.n") - 2 * shared)
    pairs = (
        s.filter(_probe(num, den, "s.") <= F.col("s.level"))
        .join(r, (F.col("s.shingle") == F.col("r.shingle")) & (F.col("s.block") == F.col("r.block")) & smaller & (F.col("r.n") * den >= F.col("s.n") * num) & (_index(num, den, "r.") <= F.col("s.level")) & early & (F.col("r.component") != F.col("s.component")))
        .groupBy(F.col("s.node").alias("a"), F.col("r.node").alias("b"), F.col("s.level").alias("level"))
        .agg(F.count("*").alias("same"))
        .filter("same >= level")
        .select("a", "b")
    )
    links = steps.store(links.unionByName(_verified(pairs, docs, classes, steps, width, num, den)), "links-all")
    steps.drop("marked", "found", "pairs", "moves")
    grouped = connected_components(links)
    of_class = classes.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = of_class.groupBy("component").agg(F.min("first").alias("lowest"))
    of_class = of_class.join(lowest, "component").select("h1", "h2", "n", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.row").alias("component_row"))
    some = rows.filter("n > 0").join(of_class, ["h1", "h2", "n"]).select(F.col("doc_id").alias(key_col), "row", F.col("n").alias("n_shingles"), "component_id", "component_row")
    none = rows.filter("n = 0").select(F.col("doc_id").alias(key_col), "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("row").alias("component_row"))
    return some.unionByName(none)


def jaccard_components(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(key, n_shingles, component_id) per row: linked where intersection / union >= num / den.

    A-Z are lowered and words are runs of characters other than space and 0x09-0x0D.
    ``component_id`` is the smallest key that links reach.  Null, empty and wordless texts
    have no shingles and link with nothing.  Rows with equal keys are nodes of their own but
    share results where their texts do; a null key takes part and counts as larger than any
    other.  Other columns are ignored; an empty table gives no rows.
    """
    return jaccard_rows(docs, key_col, text_col, width, num, den).drop("row", "component_row")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at similarity 0.9 on shingles of three words."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
