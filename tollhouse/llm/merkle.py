"""A Merkle manifest of a table, with the proof of every row by pointer jumping.

Leaves are digests of rows.  Within each part they ascend by the given order, and runs of
``FANOUT`` consecutive nodes become their parent, until one is left: the part's subroot.  The
subroots, ordered by part, are joined to one root in the same way.

Every inner node starts with one segment, its siblings below its parent, and a pointer to that
parent.  A round joins the nodes with themselves: each takes over its ancestor's segments and
pointer, so the distance doubles and all reach the root after log2(depth) rounds.  A run of
leaves is one row, so the segments above it are stored once for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollhouse.llm.common import Steps, split_count

#: Consecutive nodes below a parent.
FANOUT = 8
#: Up to so many rows (of a few hundred bytes a level) are broadcast; beyond, they are joined by a shuffle.
FEW = 4096
_PATH = "array<struct<l:binary,r:binary>>"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _no_path() -> Column:
    return F.expr(f"CAST(array() AS {_PATH})")


def digest(*texts: Column) -> Column:
    """SHA-256 in lowercase hexadecimal of the texts' UTF-8, one after another."""
    return F.sha2(F.concat(*texts), 256)


def record_digest(*columns: Column) -> Column:
    """The digest of a row: each value as its count of UTF-8 bytes, a colon and itself; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf's to the root's, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["l"]), _hex(s["r"]))), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) has with the siblings of a proof."""
    return F.aggregate(path, leaf, lambda own, s: digest(_hex(s["l"]), own, _hex(s["r"])))


def _ranked(rows: DataFrame, by: list[str], order: list[str], steps: Steps, name: str) -> DataFrame:
    """``rows`` with __pos, the place among those of equal ``by`` in ``order``, from 0, and __of, their number.

    Rows are range-partitioned and sorted; a row's place in its partition is corrected by
    what earlier partitions hold of its group, so no group meets in one task.
    """
    parted = rows.repartitionByRange(split_count(rows), *by, *order).sortWithinPartitions(*by, *order)
    placed = steps.store(parted.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__task", F.shiftright("__at", 33))
    cells = placed.groupBy("__task", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    cells = steps.store(cells, f"{name}-cells")
    before = F.sum("__n").over(W.partitionBy(*by).orderBy("__task").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumns({"__before": F.coalesce(before, F.lit(0)), "__of": F.sum("__n").over(W.partitionBy(*by))})
    cells = cells.select(F.col("__task").alias("__t"), *[F.col(c).alias(f"__by_{c}") for c in by], "__first", "__before", "__of")
    few = cells.count() <= FEW
    on = F.col("__task") == F.col("__t")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = placed.join(F.broadcast(cells) if few else cells, on)
    return joined.withColumn("__pos", F.col("__before") + F.col("__at") - F.col("__first")).select(*rows.columns, "__pos", "__of")


def _runs(nodes: DataFrame) -> DataFrame:
    """Runs of consecutive ``nodes`` (tree, many, pos, hash, id, sub) of each tree: their children in order, and the run as a node."""
    kids = F.sort_array(F.collect_list(F.struct((F.col("pos") % FANOUT).alias("i"), "hash", "id", "sub")))
    runs = nodes.groupBy("tree", "many", F.expr(f"pos div {FANOUT}").alias("pos")).agg(kids.alias("kids"))
    whole = F.array_join(F.transform("kids", lambda k: F.hex(k["hash"])), "")
    return runs.withColumn("all", F.unhex(whole)).withColumn("hash", F.unhex(digest(F.lower(whole))))


def _siblings(whole: Column, i: Column) -> Column:
    """A segment: the digests left and right of the ``i``-th (32 bytes each) of a run."""
    at = (i * 32).cast("int")
    return F.struct(whole.substr(F.lit(1), at).alias("l"), whole.substr(at + 33, F.octet_length(whole)).alias("r"))


class _Forest:
    """Levels of nodes above the runs of leaves, as stored tables of runs."""

    def __init__(self, steps: Steps):
        self.steps, self.links = steps, []
        self.height = 0

    def grow(self, nodes: DataFrame, most: int, mark: bool) -> DataFrame:
        """The roots of the trees of ``nodes`` (up to ``most`` in one); links to parents are kept."""
        tops = nodes.filter("many = 1")
        while most > 1:
            self.height += 1
            most = -(-most // FANOUT)
            runs = self.steps.store(_runs(nodes.filter("many > 1")), f"level-{self.height}")
            runs = runs.withColumn("id", F.concat_ws("/", F.lit(self.height), "tree", "pos"))
            kid = runs.select(F.col("id").alias("above"), F.lit(self.height - 1).alias("height"), "all", F.explode("kids").alias("k"))
            self.links.append(kid.select(F.col("k.id").alias("id"), "above", "height", F.col("k.sub").alias("sub"), F.array(_siblings(F.col("all"), F.col("k.i"))).cast(_PATH).alias("path")))
            many = F.expr(f"(many + {FANOUT - 1}) div {FANOUT}")
            nodes = runs.select("tree", many.alias("many"), "pos", "hash", "id", F.when((many == 1) & F.lit(mark), F.col("hash")).alias("sub"))
            tops = tops.unionByName(nodes.filter("many = 1"))
        return tops


def _jumped(paths: DataFrame, steps: Steps) -> DataFrame:
    """(id, path to the root, sub) of ``paths`` (id, above, height, path, sub); above is null where it is the root."""
    paths, distance = steps.store(paths, "paths"), 1
    while True:
        ahead = paths.filter(F.col("height") >= distance)
        going, ancestors = paths.agg(F.count("above"), F.count(F.when(F.col("height") >= distance, 1))).first()
        if not going:
            return paths
        # Only nodes with as many levels below can be pointed at; each round has fewer of them.
        ahead = ahead.select(F.col("id").alias("above"), F.col("above").alias("__above"), F.col("path").alias("__path"), F.col("sub").alias("__sub"))
        met = paths.filter("above IS NOT NULL").join(F.broadcast(ahead) if ancestors <= FEW else ahead, "above")
        met = met.select("id", F.col("__above").alias("above"), "height", F.coalesce("sub", "__sub").alias("sub"), F.concat("path", "__path").alias("path"))
        paths = steps.store(met.unionByName(paths.filter("above IS NULL").select(*met.columns)), "paths")
        distance *= 2


def merkle_manifest(rows: DataFrame, part: str, order: list[str], leaf: str, carry: list[str] | None = None) -> tuple[str | None, DataFrame]:
    """The root (hexadecimal) and a row per leaf: ``part``, ``order``, ``leaf``, ``carry``, subroot and path.

    ``leaf`` is a binary digest.  A path lists, from the leaf to the root, the digests left
    and right of the node in its run (binary, joined); ``fold`` and ``proof_digest`` read it.
    A part of one leaf has that leaf as its subroot, a table of one part its subroot as its root.
    Leaves of equal ``order`` (repeated rows) follow by their digest; nulls come first.  An
    empty table gives None and no rows.
    """
    carry = carry or []
    steps = Steps(rows.sparkSession)
    given = steps.store(rows.select(part, *order, leaf, *carry).withColumn("__n", F.monotonically_increasing_id()), "leaves")
    leaves = steps.store(_ranked(given, [part], [*order, leaf, "__n"], steps, "ranks"), "placed")
    steps.drop("leaves", "ranks", "ranks-cells")
    parts = leaves.filter("__pos = 0").select(F.col(part).alias("__part"), F.col("__of").alias("__size"))
    parts = steps.store(_ranked(parts, [], ["__part"], steps, "parts"), "trees").select("__part", F.col("__pos").alias("tree"), F.col("__of").alias("__trees"))
    trees, most = parts.count(), leaves.agg(F.max("__of")).first()[0]
    if not trees:
        return None, rows.select(part, *order, leaf, *carry, F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_PATH).alias("path")).limit(0)
    leaves = leaves.join(F.broadcast(parts) if trees <= FEW else parts, F.col(part).eqNullSafe(F.col("__part"))).drop("__part")

    # Runs of leaves; a lone leaf is its own run and its part's subroot.
    kids = F.sort_array(F.collect_list(F.struct((F.col("__pos") % FANOUT).alias("i"), F.col(leaf).alias("hash"), F.struct(part, *order, *carry).alias("row"))))
    runs = leaves.groupBy("tree", F.col("__of").alias("leaves"), F.expr(f"__pos div {FANOUT}").alias("pos")).agg(kids.alias("kids"))
    whole = F.array_join(F.transform("kids", lambda k: F.hex(k["hash"])), "")
    run_hash = F.when(F.col("leaves") == 1, F.unhex(whole)).otherwise(F.unhex(digest(F.lower(whole))))
    runs = steps.store(runs.withColumn("all", F.unhex(whole)).withColumn("hash", run_hash), "runs").withColumn("id", F.concat_ws("/", F.lit(0), "tree", "pos"))
    steps.drop("placed")
    many = F.expr(f"(leaves + {FANOUT - 1}) div {FANOUT}")
    nodes = runs.select("tree", many.alias("many"), "pos", "hash", "id", F.when(many == 1, F.col("hash")).alias("sub"))

    forest = _Forest(steps)
    tops = steps.store(forest.grow(nodes, -(-most // FANOUT), True), "subroots")
    crown = tops.select(F.lit(-1).cast("long").alias("tree"), F.lit(trees).cast("long").alias("many"), F.col("tree").alias("pos"), "hash", "id", "sub")
    top = forest.grow(crown, trees, False).select("id", F.lower(F.hex("hash")).alias("root")).first()
    found = runs.withColumns({"__path": _no_path(), "__sub": F.lit(None).cast("binary")})
    if forest.links:
        links = reduce(DataFrame.unionByName, forest.links)
        paths = _jumped(links.withColumn("above", F.nullif("above", F.lit(top.id))), steps)
        first = paths.filter(F.col("id").startswith("0/")).select("id", F.col("path").alias("__path"), F.col("sub").alias("__sub"))
        found = runs.join(first, "id", "left").withColumn("__path", F.coalesce("__path", _no_path()))
    steps.drop("parts", "parts-cells", "trees", "subroots", *[f"level-{i + 1}" for i in range(forest.height)])
    own = F.when(F.col("leaves") > 1, F.array(_siblings(F.col("all"), F.col("k.i"))).cast(_PATH)).otherwise(_no_path())
    out = found.select("leaves", "all", "__path", "__sub", F.explode("kids").alias("k"))
    subroot = F.coalesce(_hex(F.col("__sub")), F.lit(top.root))
    return top.root, out.select("k.row.*", F.col("k.hash").alias(leaf), subroot.alias("subroot"), F.concat(own, "__path").alias("path"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and whether the proof still holds where a text was tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verify_tampered(docs)


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Proofs of ``docs`` (doc_id, source, lang, n_chars, text) and the roots they fold to from tampered texts.

    Where 3 divides the CRC-32 of the id in decimal, the leaf to be proved is that of the
    lower-cased text (A-Z alone); a null id or text is not tampered with.
    """
    fields = lambda text: record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.unhex(fields(F.translate("text", _CAPITALS, _SMALL))))
    rows = docs.select("doc_id", "lang", F.unhex(fields(F.col("text"))).alias("leaf"), tampered.alias("tampered"))
    root, proofs = merkle_manifest(rows, "lang", ["doc_id"], "leaf", ["tampered"])
    folded = fold(_hex(F.coalesce("tampered", "leaf")), F.col("path"))
    out = proofs.select("doc_id", _hex(F.col("leaf")).alias("leaf"), "subroot", F.lit(root).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL has for leaves of a part and for subroots: up to 8**7 and 8**3 of them.
_SQL_LEVELS, _SQL_TOP = 7, 3


def _sql_levels(name: str, first: str, levels: int) -> str:
    """Nodes (tree, many, pos, hash) by level from ``first`` up; a tree of one node stays as it is."""
    out = [f"{name}0 AS ({first})"]
    for i in range(1, levels + 1):
        out.append(f"""{name}{i} AS (SELECT tree, many, pos, hash FROM {name}{i - 1} WHERE many = 1 UNION ALL
  SELECT tree, (many + 7) // 8, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM {name}{i - 1} WHERE many > 1 GROUP BY tree, many, pos // 8)""")
        out.append(f"""{name}s{i} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name}{i - 1} a JOIN {name}{i - 1} b ON b.tree = a.tree AND b.pos // 8 = a.pos // 8 WHERE a.many > 1 GROUP BY a.tree, a.pos)""")
    return ",\n".join(out)


def _sql() -> str:
    size = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({size('doc_id')} || {size('source')} || {size('lang')} || {size('n_chars')} || {size(text)})"
    step = "xor(c >> 8, list_reduce(list_prepend(xor(c & 255, b), range(8)), lambda d, e: xor(d >> 1, 3988292384 * (d & 1))))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    folds = ["f0 AS (SELECT *, coalesce(tampered, leaf) AS h, '' AS proof FROM placed)"]
    ends = [(f"ns{k + 1} s ON s.tree = f.tree AND s.pos = f.pos // {8**k}") for k in range(_SQL_LEVELS)] + [f"ts{k + 1} s ON s.pos = f.tree // {8**k}" for k in range(_SQL_TOP)]
    for i, end in enumerate(ends):
        folds.append(f"f{i + 1} AS (SELECT f.* EXCLUDE (h, proof), CASE WHEN s.pos IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h, CASE WHEN s.pos IS NULL THEN f.proof ELSE f.proof || s.l || s.r END AS proof FROM f{i} f LEFT JOIN {end})")
    return f"""
WITH leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{_CAPITALS}', '{_SMALL}')")} END AS tampered FROM documents),
trees AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
placed AS (SELECT l.*, t.tree, count(*) OVER (PARTITION BY t.tree) AS many, row_number() OVER (PARTITION BY t.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves l JOIN trees t ON t.lang IS NOT DISTINCT FROM l.lang),
{_sql_levels('n', 'SELECT tree, many, pos, leaf AS hash FROM placed', _SQL_LEVELS)},
{_sql_levels('t', f'SELECT 0 AS tree, count(*) OVER () AS many, tree AS pos, hash FROM n{_SQL_LEVELS}', _SQL_TOP)},
{", ".join(folds)}
SELECT f.doc_id, f.leaf, n.hash AS subroot, t.hash AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.hash AS verified
FROM f{len(ends)} f JOIN n{_SQL_LEVELS} n ON n.tree = f.tree, t{_SQL_TOP} t
"""


OP11_SQL = _sql()
