"""Exact top-k search by inner product in an M-tree of paged metric nodes.

Vectors get one more coordinate that brings all of them to the length of the longest
(queries get 0 there): then the largest inner products are the smallest Euclidean distances.

* Routing objects are vectors of a bounded sample; every vector belongs to the nearest one.
  Above them stand levels of inner nodes of about ``FAN`` children, kept by the driver and
  sent to tasks: they are as few as the routing objects whatever the table's size.
* A routing object or node with more than two pages of vectors is split: vectors drawn from
  its own become objects of up to about ``SPLIT`` nodes below it, its vectors go to the nearest
  one, and so on down.  These nodes are rows of DataFrames and grow with the table.  A node
  that is not split is a page; only one that is (almost) all copies of a vector is dealt to
  several pages by a hash.  A page's vectors lie in leaves of up to ``NODE``.  Every
  node has an object, a covering radius and the distance of its object from its parent's;
  every entry of a leaf has the distance from the leaf's object.
* A query goes best first through the inner nodes to its nearest routing object and down to
  the nearest pages that hold enough vectors, which bounds the distance of its k-th neighbour;
  then through each subtree that the bound leaves.  Each query has its own queue of nodes by lower bound.  The
  bounds come from stored distances first; a distance is computed only for the node that is
  at the head of a queue, and its entries only where the triangle inequality leaves them.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tollhouse.llm.common import stored

PAGE, NODE = 1024, 64
#: Most routing objects, and so rows of the sample that the index is fitted on.
ROUTING = 2048
#: Children of an inner node, about.
FAN = 32
#: Most nodes wanted below one that is split, and vectors that one task gives to them.
SPLIT, DEALT = 512, 65536
#: Queries that are searched in a page at once; more go to other tasks.
QUERIES = 4096
#: Vectors of squared lengths from here on are kept out of the tree: their inner products may be beyond 64 bits.
TOO_LONG = 2.0**62
#: Rows of a block of such vectors, and of the rows that it is compared with.
BLOCK = 512
#: Largest score that the result holds; larger ones are given as this, smaller than its negative as that.
MOST = 2**63 - 1
#: "No bound yet" and "no entry yet".
LOW, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Slack of distances, for rounding.
SLACK = 1e-6


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vector: floor(scale * x), norm2, long) of the rows that take part.

    Vectors are 64-bit integers, but doubles (whole numbers) where ``long`` says that the squared length
    is 2**62 or more.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, norms, long = [], [], [], []
            for i, v in zip(batch["id"].to_pylist(), batch["vector"], strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    whole = np.floor(x * scale)
                    fits = whole @ whole < TOO_LONG
                if not fits and not np.isfinite(whole).all():
                    # Only the product with the scale is too large for a double.
                    whole = np.array([int(c) * scale if np.isinf(w) else int(w) for c, w in zip(x, whole, strict=True)], dtype=object)
                ids.append(i)
                long.append(not fits)
                q = whole.astype(np.int64) if fits else np.zeros(0, np.int64)
                vectors.append(q.tobytes() if fits else json.dumps([str(int(c)) for c in whole]).encode())
                norms.append(int(q @ q))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(norms, pa.int64()), pa.array(long, pa.bool_())], ["id", "vector", "norm2", "long"])

    given = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    return given.mapInArrow(run, "id long, vector binary, norm2 long, long boolean")


def _exact(vector: bytes, long: bool) -> list[int]:
    return [int(c) for c in json.loads(vector)] if long else np.frombuffer(vector, np.int64).tolist()


def _order_of(score: int) -> tuple[int, int, str]:
    """A score as 64 bits hold it, its side beyond them (1, -1 or 0), and a text that sorts such scores upwards."""
    if abs(score) <= MOST:
        return score, 0, ""
    digits = str(abs(score))
    key = f"{len(digits):06d}{digits}"
    return (MOST, 1, key) if score > 0 else (-MOST, -1, key.translate(str.maketrans("0123456789", "9876543210")))


def compared(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, side, key): the k best ``rows`` for each query of each pair of blocks, by whole numbers of any size.

    Both are (id, vector, long); every query meets every row in one pair of blocks.
    """
    sizes = [max(1, -(-df.count() // BLOCK)) for df in (queries, rows)]
    dealt = lambda df, n, own: df.withColumn(own, F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int"))
    left = dealt(queries, sizes[0], "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(sizes[1] - 1))))
    right = dealt(rows, sizes[1], "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(sizes[0] - 1))))

    def best(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        values = [(int(i), _exact(v, big)) for i, v, big in zip(given["id"], given["vector"], given["long"], strict=True)]
        out = []
        for i, v, big in zip(asked["id"], asked["vector"], asked["long"], strict=True):
            x = _exact(v, big)
            scored = ((-sum(c * d for c, d in zip(x, y, strict=False)), j) for j, y in values if j != i)
            out += [(int(i), j, *_order_of(-s)) for s, j in heapq.nsmallest(k, scored)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "side", "key"])

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(best, "query_id long, vec_id long, score long, side int, key string")


def _matrix(vectors: Iterable[bytes], width: int) -> np.ndarray:
    """Rows of a common width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        x = np.frombuffer(v, dtype=np.int64)
        row[: len(x)] = x
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """With the coordinate that makes all norms equal."""
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def _spread(x: np.ndarray, n: int) -> list[int]:
    """Up to ``n`` rows chosen farthest first."""
    chosen = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return chosen


def _slack(most: float, norms: np.ndarray) -> np.ndarray:
    return SLACK * (1 + np.sqrt(np.maximum(most, norms)))


def _reach(most: float, norms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distances beyond which no score of at least ``bounds`` lies."""
    square = norms + most - 2 * np.maximum(bounds.astype(np.float64), -most - norms)
    return np.where(bounds == LOW, np.inf, np.sqrt(np.maximum(0, square)) + _slack(most, norms))


class Inner:
    """The levels of nodes from the root's children down to the routing objects ``routes``.

    Each level has its objects, covering radii of all vectors below, covering radii of the
    routing objects below, and the distances of the objects from those of their parents;
    ``children[i][j]`` are the nodes below node j of level i.
    """

    def __init__(self, routes: np.ndarray, objects: np.ndarray, radii: np.ndarray):
        self.routes = routes
        levels, children = [], []
        cover = np.zeros(len(objects))
        while len(objects) > FAN:
            chosen = _spread(objects, -(-len(objects) // FAN))
            d = _distances(objects, objects[chosen])
            above = d.argmin(axis=1)
            far = d[np.arange(len(objects)), above]
            levels.append((objects, radii, cover, far))
            children.append([np.flatnonzero(above == j) for j in range(len(chosen))])
            wide, narrow = np.zeros(len(chosen)), np.zeros(len(chosen))
            np.maximum.at(wide, above, far + radii)
            np.maximum.at(narrow, above, far + cover)
            objects, radii, cover = objects[chosen], wide, narrow
        levels.append((objects, radii, cover, np.zeros(len(objects))))
        self.levels, self.children = levels[::-1], children[::-1]

    def nearest(self, x: np.ndarray) -> int:
        """The routing object next to ``x``, best first."""
        objects, _, cover, _ = self.levels[0]
        d = _distances(x[None, :], objects)[0]
        queue = [(d[j] - cover[j], 0, j, d[j]) for j in range(len(d))]
        heapq.heapify(queue)
        last = len(self.levels) - 1
        best = d.min() if not last else np.inf
        while True:
            _, depth, j, far = heapq.heappop(queue)
            if depth == last:
                return int(self.routes[j])
            objects, _, cover, above = self.levels[depth + 1]
            below = self.children[depth][j]
            below = below[np.abs(far - above[below]) - cover[below] <= best]
            d = _distances(x[None, :], objects[below])[0]
            if depth + 1 == last and len(d):
                best = min(best, d.min() * (1 + SLACK) + SLACK)
            for c, to in zip(below.tolist(), d.tolist(), strict=True):
                heapq.heappush(queue, (to - cover[c], depth + 1, c, to))

    def within(self, x: np.ndarray, reach: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(routing object, rows of ``x``) wherever a row's ball of radius ``reach`` meets that of the object."""
        objects, radii, _, _ = self.levels[0]
        d = _distances(x, objects)
        level = [(j, np.flatnonzero(d[:, j] - radii[j] <= reach)) for j in range(len(objects))]
        open_to = [(j, rows, d[rows, j]) for j, rows in level if len(rows)]
        for children, (objects, radii, _, above) in zip(self.children, self.levels[1:], strict=True):
            below = []
            for j, rows, far in open_to:
                for c in children[j].tolist():
                    # By the stored distance, before any is computed.
                    some = rows[np.abs(far - above[c]) - radii[c] <= reach[rows]]
                    to = _distances(x[some], objects[c : c + 1])[:, 0]
                    met = to - radii[c] <= reach[some]
                    if met.any():
                        below.append((c, some[met], to[met]))
            open_to = below
        return [(int(self.routes[j]), rows) for j, rows, _ in open_to]


class Index:
    """The inner nodes, the levels of nodes below the routing objects and a DataFrame of leaves."""

    def __init__(self, nodes: DataFrame, levels: list[DataFrame], inner: Inner, pages: DataFrame, most: float, width: int, exact: bool):
        self.nodes, self.levels, self.inner, self.pages = nodes, levels, inner, pages
        self.most, self.width, self.exact = most, width, exact


def _split(rows: DataFrame, full: DataFrame, most: float, width: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The vectors of the nodes ``full`` (node, n) at new nodes below, and those nodes' (parent, node, object).

    Objects are drawn by a hash of the id: about twice as many as pages, sixteen more against
    bad luck.  A node's vectors are dealt to tasks of about ``DEALT``, each beside all its objects.
    """
    wanted = F.least(F.ceil(F.col("n") / PAGE), F.lit(SPLIT)) * 2 + 16
    within = rows.select("id", "vector", "node").join(full, "node")
    drawn = within.filter(F.expr("pmod(xxhash64(id, %d), n)" % depth) < wanted)
    name = F.concat_ws("/", "node", F.hex(F.xxhash64("vector")))
    objects = stored(drawn.groupBy(F.col("node").alias("parent"), name.alias("node")).agg(F.min("vector").alias("object")), "objects")
    groups = F.ceil(F.col("n") / DEALT).cast("int")
    dealt = within.select("id", "vector", "node", F.pmod(F.xxhash64("vector", "id"), groups).cast("int").alias("group"))
    beside = objects.join(full.withColumnRenamed("node", "parent"), "parent").select("parent", "node", "object", F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"))

    def given(key: tuple, mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(above):
            return mine.assign(far=np.inf)[["id", "vector", "node", "far"]]
        pivots, names = _lifted(_matrix(above["object"].tolist(), width), most), above["node"].to_numpy()
        near, far = np.zeros(len(mine), np.int64), np.zeros(len(mine))
        for at in range(0, len(mine), 2048):
            d = _distances(_lifted(_matrix(mine["vector"].iloc[at : at + 2048].tolist(), width), most), pivots)
            near[at : at + 2048], far[at : at + 2048] = d.argmin(axis=1), d.min(axis=1)
        return pd.DataFrame({"id": mine["id"], "vector": mine["vector"], "node": names[near], "far": far})

    moved = dealt.groupBy("node", "group").cogroup(beside.groupBy("parent", "group")).applyInPandas(given, "id long, vector binary, node string, far double")
    return stored(moved, "placed"), objects


def build_index(vectors: DataFrame) -> Index | None:
    """The M-tree of (id, vector, norm2) rows; None if there are none."""
    n, most, width = vectors.agg(F.count("*"), F.max("norm2"), F.max(F.octet_length("vector"))).first()
    if not n:
        return None
    width, most = max(1, width // 8), float(most)
    wanted = min(ROUTING, -(-n // PAGE))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(4 * wanted).select("vector").collect()
    distinct = list(dict.fromkeys(bytes(r.vector) for r in sample))[:wanted]
    routing = _lifted(_matrix(distinct, width), most)

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                d = _distances(_lifted(_matrix(part["vector"].to_pylist(), width), most), routing)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part["id"], part["vector"], pa.array(near.astype(str)), pa.array(d[np.arange(len(d)), near])], ["id", "vector", "node", "far"])

    def measured(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("radius"))

    rows = stored(vectors.select("id", "vector").mapInArrow(nearest, "id long, vector binary, node string, far double"), "placed")
    sizes = stored(measured(rows), "sizes")
    # One row a routing object: bounded by ROUTING.
    radii = np.full(len(routing), -1.0)
    for r in sizes.collect():
        radii[int(r.node)] = r.radius
    levels, settled, counted = [], [], []
    full = sizes.filter((F.col("n") > 2 * PAGE) & (F.col("radius") > 0)).select("node", "n")
    while not full.isEmpty():
        settled.append(rows.join(full, "node", "left_anti"))
        counted.append(sizes.join(full, "node", "left_anti"))
        rows, objects = _split(rows, full, most, width, len(levels))
        parents = full.select(F.col("node").alias("parent"), F.col("n").alias("all"))
        sizes = stored(measured(rows).join(objects, "node").join(parents, "parent"), "sizes")
        levels.append(sizes.select("parent", "node", "object", "radius", "n"))
        # One that keeps nearly all vectors is made of copies: no object parts them.
        full = sizes.filter((F.col("n") > 2 * PAGE) & (F.col("radius") > 0) & (F.col("n") < 0.9 * F.col("all"))).select("node", "n")
    rows = reduce(DataFrame.unionByName, settled, rows)
    sizes = reduce(DataFrame.unionByName, [c.select("node", "n") for c in counted], sizes.select("node", "n"))
    pages = stored(sizes.select("node", F.when(F.col("n") > 2 * PAGE, F.ceil(F.col("n") / PAGE)).otherwise(1).cast("int").alias("subs")), "pages")
    copies = pages.filter("subs > 1")
    paged = rows.join(copies, "node", "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("id"), "subs").cast("int"), F.lit(0)))

    def nodes_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        x = _lifted(_matrix(rows["vector"].tolist(), width), most)
        ids = rows["id"].to_numpy()
        # Objects: vectors spread over the page by farthest-first choice; entries go to the nearest.  The first is the page's own.
        chosen = _spread(x, -(-len(x) // NODE) * 2)
        d = _distances(x, x[chosen])
        of = d.argmin(axis=1)
        whole = x[:, :-1].astype(np.int64)
        out = []
        for k, c in enumerate(chosen):
            members = np.flatnonzero(of == k)
            for at in range(0, len(members), NODE):
                m = members[at : at + NODE]
                out.append((*key, whole[0].tobytes(), whole[c].tobytes(), float(d[m, k].max()), float(d[c, 0]), ids[m].tobytes(), whole[m].tobytes(), d[m, k].tobytes()))
        return pd.DataFrame(out, columns=["node", "sub", "top", "object", "radius", "parent", "ids", "vectors", "distances"])

    nodes = paged.select("id", "vector", "node", "sub").groupBy("node", "sub").applyInPandas(nodes_of, "node string, sub int, top binary, object binary, radius double, parent double, ids binary, vectors binary, distances binary")
    used = np.flatnonzero(radii >= 0)
    return Index(stored(nodes, "nodes"), levels, Inner(used, routing[used], radii[used]), pages, most, width, most < 2**52)


def _searched(nodes: pd.DataFrame, queries: pd.DataFrame, most: float, width: int, exact: bool, k: int) -> pd.DataFrame:
    """The k best entries of one page for each of the queries, none worse than the query's bound."""
    if not len(nodes) or not len(queries):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})
    objects = _lifted(_matrix(nodes["object"].tolist(), width), most)
    radii, parents = nodes["radius"].to_numpy(), nodes["parent"].to_numpy()
    root = _lifted(_matrix(nodes["top"].tolist()[:1], width), most)
    leaves = [(np.frombuffer(i, np.int64), np.frombuffer(v, np.int64).reshape(-1, width), np.frombuffer(d, np.float64)) for i, v, d in zip(nodes["ids"], nodes["vectors"], nodes["distances"], strict=True)]
    if exact:
        leaves = [(i, v.astype(np.float64), d) for i, v, d in leaves]
    ids = queries["id"].to_numpy(np.int64)
    bound = queries["bound"].to_numpy(np.int64).copy()
    plain = _matrix(queries["vector"].tolist(), width)
    given = plain if exact else np.stack([np.pad(x, (0, width - len(x))) for x in (np.frombuffer(v, np.int64) for v in queries["vector"])])
    norms = (plain * plain).sum(axis=1)
    lifted = np.concatenate([plain, np.zeros((len(plain), 1))], axis=1)
    # A row of the queue holds one query's lower bounds of all leaves, from stored distances at first.
    queue = np.abs(_distances(lifted, root) - parents[None, :]) - radii[None, :]
    to_object = np.full(queue.shape, np.nan)
    keys, names = np.full((len(ids), k), NONE), np.zeros((len(ids), k), dtype=np.int64)
    going = np.arange(len(ids))
    while len(going):
        head = queue[going].argmin(axis=1)
        left = queue[going, head] <= _reach(most, norms[going], bound[going])
        left &= queue[going, head] < np.inf
        going, head = going[left], head[left]
        measured = ~np.isnan(to_object[going, head])
        rows, leaf = going[~measured], head[~measured]
        to_object[rows, leaf] = np.sqrt(((lifted[rows] - objects[leaf]) ** 2).sum(axis=1))
        queue[rows, leaf] = np.maximum(queue[rows, leaf], to_object[rows, leaf] - radii[leaf])
        rows, leaf = going[measured], head[measured]
        queue[rows, leaf] = np.inf
        for opened in np.unique(leaf).tolist():
            here = rows[leaf == opened]
            own_ids, values, stored_d = leaves[opened]
            near = _reach(most, norms[here], bound[here])
            columns = np.flatnonzero((np.abs(to_object[here, opened][:, None] - stored_d[None, :]) <= near[:, None]).any(axis=0))
            if not len(columns):
                continue
            scores = (given[here] @ values[columns].T).astype(np.int64)
            good = (scores >= bound[here][:, None]) & (own_ids[columns][None, :] != ids[here][:, None])
            hit = np.flatnonzero(good.any(axis=1))
            to = here[hit]
            all_keys = np.concatenate([keys[to], np.where(good[hit], -scores[hit], NONE)], axis=1)
            all_names = np.concatenate([names[to], np.broadcast_to(own_ids[columns], (len(hit), len(columns)))], axis=1)
            order = np.lexsort((all_names, all_keys), axis=1)[:, :k]
            keys[to], names[to] = np.take_along_axis(all_keys, order, axis=1), np.take_along_axis(all_names, order, axis=1)
            full = to[keys[to, k - 1] != NONE]
            bound[full] = np.maximum(bound[full], -keys[full, k - 1])
    row, place = np.nonzero(keys != NONE)
    return pd.DataFrame({"query_id": ids[row], "vec_id": names[row, place], "score": -keys[row, place]})


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k largest inner products, ties to the smaller id; a query's own id does not count.

    ``queries`` are (id, vector) rows of ``quantised``, one an id.  Equal entries of one id and score rank one after another.
    """
    width, most, inner, exact = index.width, index.most, index.inner, index.exact

    def home(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["vector"].to_pylist(), width)
            near = [inner.nearest(q) for q in np.concatenate([x, np.zeros((len(x), 1))], axis=1)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], pa.array([LOW] * len(near), pa.int64()), pa.array([str(j) for j in near], pa.string())], ["id", "vector", "bound", "node"])

    def reached(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """A row for each query and routing object that its bound leaves."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part["vector"].to_pylist(), width)
                reach = _reach(most, (x * x).sum(axis=1), part["bound"].to_numpy())
                for route, rows in inner.within(np.concatenate([x, np.zeros((len(x), 1))], axis=1), reach):
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([taken["id"], taken["vector"], taken["bound"], pa.array([str(route)] * len(rows), pa.string())], ["id", "vector", "bound", "node"])

    def grouped(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs dealt to groups of about ``QUERIES`` a node, and each node's groups."""
        groups = pairs.groupBy("node").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        hot = groups.filter("groups > 1").withColumnRenamed("groups", "many")
        dealt = pairs.join(hot, "node", "left").withColumn("group", F.coalesce(F.pmod(F.xxhash64("id"), "many").cast("int"), F.lit(0))).drop("many")
        return dealt, groups.select("node", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))

    def down(pairs: DataFrame, level: DataFrame, home: bool) -> DataFrame:
        """The pairs one level down: at all nodes that a query's bound leaves, or at the nearest with more than k vectors; those at pages stay."""

        def one(key: tuple, asked: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
            columns = ["id", "vector", "bound", "node"]
            if not len(asked) or not len(below):
                return asked[columns]
            x = _matrix(asked["vector"].tolist(), width)
            d = _distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), _lifted(_matrix(below["object"].tolist(), width), most))
            if home:
                order = d.argsort(axis=1, kind="stable")
                before = np.cumsum(below["n"].to_numpy()[order], axis=1) - below["n"].to_numpy()[order]
                met = np.zeros(d.shape, bool)
                np.put_along_axis(met, order, before <= k, axis=1)
            else:
                reach = _reach(most, (x * x).sum(axis=1), asked["bound"].to_numpy(np.int64))
                met = d - below["radius"].to_numpy()[None, :] <= reach[:, None]
            rows, to = np.nonzero(met)
            return asked.iloc[rows].assign(node=below["node"].to_numpy()[to])[columns]

        dealt, groups = grouped(pairs)
        below = level.join(groups.withColumnRenamed("node", "parent"), "parent")
        return dealt.groupBy("node", "group").cogroup(below.groupBy("parent", "group")).applyInPandas(one, "id long, vector binary, bound long, node string")

    def descended(pairs: DataFrame, home: bool) -> DataFrame:
        for level in index.levels:
            pairs = stored(down(pairs, level, home), "pairs")
        return pairs

    def run(pairs: DataFrame) -> DataFrame:
        """The pages of each pair's node searched; its queries in groups of about ``QUERIES``, each beside the page."""
        dealt, groups = grouped(pairs)
        dealt = dealt.join(index.pages, "node").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))

        def one(nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return _searched(nodes, rows, most, width, exact, k)

        by = ("node", "sub", "group")
        return index.nodes.join(groups, "node").groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(one, "query_id long, vec_id long, score long")

    pairs_schema = "id long, vector binary, bound long, node string"
    placed = descended(stored(queries.select("id", "vector").mapInArrow(home, pairs_schema), "queries"), True)
    near = stored(run(placed), "near")
    order = Wd.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    bounded = queries.select("id", "vector").join(bounds, "id", "left").select("id", "vector", F.coalesce("bound", F.lit(LOW).cast("long")).alias("bound"))
    # The pages of the first descent are not searched again.
    pairs = descended(stored(bounded.mapInArrow(reached, pairs_schema), "pairs"), False)
    pairs = stored(pairs.join(placed.select("id", "node"), ["id", "node"], "left_anti"), "pairs")
    return near.unionByName(run(pairs)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row whose id is a multiple of ``every``.

    Rows without an id, and vectors that are null or hold null or non-finite components, take
    no part.  Vectors of a scaled squared length of 2**62 or more stay out of the tree: they are
    compared with all queries, and those among the queries with all rows, in blocks of whole
    numbers of any size.  Scores rank by their true value; one beyond 64 bits is given as
    ``MOST`` or its negative.  Shorter vectors are taken to end in zeros.  Rows of equal ids are one
    query (of the smallest stored vector) and never match one another.  Other columns are ignored; an empty table gives no rows.
    """
    every_vector = stored(quantised(df, id_col, vector_col, scale), "vectors")
    vectors = every_vector.filter("NOT long").drop("long")
    asked = every_vector.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("long", "vector")).alias("v")).select("id", "v.vector", "v.long")
    index = build_index(vectors)
    found = []
    if index is not None:
        plain = search(index, asked.filter("NOT long").select("id", "vector"), k)
        found.append(plain.select("query_id", "vec_id", "score", F.lit(0).alias("side"), F.lit("").alias("key")))
    long = every_vector.filter("long")
    if not long.isEmpty():
        ids = ["id", "vector", "long"]
        found.append(compared(asked, long.select(*ids), k))
        if index is not None:
            found.append(compared(asked.filter("long"), every_vector.filter("NOT long").select(*ids), k))
    if not found:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    if len(found) == 1 and index is not None:
        return plain.select("query_id", "rank", "vec_id", "score")
    order = Wd.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("key"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each twentieth embedding."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
