"""How filters share their work: what each would remove in every order of them.

A row fails a set of filters, its mask.  An order removes it at the first of its filters, so at
step k with a given beginning of k filters: the first k - 1 outside the mask, the k-th inside.
All orders with one beginning are neighbours in the lexicographic list of permutations (their
Lehmer ranks form an interval).  So a mask's count is added where such an interval begins and
taken away behind its end, and running sums over the ranks give what every order removes at
every step, without going through rows or masks again for each order.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollhouse.llm.common import Steps

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Ids in a join that is dealt by id: rows without one are dealt into so many parts.
NULL_PARTS = 1024


def intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last) of every beginning that removes a mask's rows at that step."""
    n = len(filters)
    found = []
    for step in range(1, n + 1):
        width = math.factorial(n - step)
        # Beginnings of one length follow each other in lexicographic order, ``width`` ranks each.
        for i, begin in enumerate(itertools.permutations(range(n), step)):
            *before, last = begin
            others = [f for f in range(n) if f not in before and f != last]
            for k in range(len(others) + 1):
                for more in itertools.combinations(others, k):
                    mask = sum(1 << f for f in (last, *more))
                    found.append((mask, step, i * width, (i + 1) * width))
    return found


def audit_orders(masked: DataFrame, part: str, counts: list[str], filters: str = FILTERS) -> DataFrame:
    """A row per ``part``, order and step of its filters from rows (part, mask, ``counts``).

    Bit i of ``mask`` says that the i-th filter fails; ``counts`` are numbers of rows to add up,
    the first that of all rows.  Gives filter_order, step, kept and redundant, unique_fails
    and shapley of the first count, removed_<count> of each.  Parts and masks may repeat, null
    masks count as 0.  An empty table gives no rows.
    """
    n, ranks = len(filters), math.factorial(len(filters))
    spark = masked.sparkSession
    first = counts[0]
    sums = masked.groupBy(part, F.coalesce(F.col("mask"), F.lit(0)).alias("mask")).agg(*[F.sum(c).alias(c) for c in counts])
    whole = sums.groupBy(part).agg(
        F.sum(first).alias("__all"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(first)).otherwise(0)) for i in range(n)]).alias("__fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col(first)).otherwise(0)) for i in range(n)]).alias("__alone"),
    )
    spans = F.broadcast(spark.createDataFrame(intervals(filters), "mask int, step int, lo int, hi int"))
    ends = sums.withColumn("mask", F.col("mask").cast("int")).join(spans, "mask")
    ends = ends.select(part, "step", F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign")))).alias("e"), *counts)
    steps = [f"{c}_{k + 1}" for c in counts for k in range(n)]
    deltas = [F.sum(F.when(F.col("step") == k + 1, F.col(c) * F.col("e.sign")).otherwise(0)).alias(f"{c}_{k + 1}") for c in counts for k in range(n)]
    changes = ends.groupBy(part, F.col("e.rank").alias("rank")).agg(*deltas)
    grid = whole.select(F.col(part).alias("__part"), "__all", "__fails", "__alone", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("__rank"))
    rows = grid.join(changes, F.col("__part").eqNullSafe(F.col(part)) & (F.col("__rank") == F.col("rank")), "left").drop(part, "rank")
    running = W.partitionBy("__part").orderBy("__rank").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("__part", "__all", "__fails", "__alone", "__rank", *[F.sum(F.coalesce(c, F.lit(0))).over(running).alias(c) for c in steps])
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    removed = lambda c: F.array(*[F.col(f"{c}_{k + 1}") for k in range(n)])
    rows = rows.select("__part", "__all", "__fails", "__alone", orders[F.col("__rank")].alias("filter_order"), *[removed(c).alias(f"__{c}") for c in counts])
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    at = F.col("step") - 1
    own = F.expr(f"instr('{filters}', substr(filter_order, step, 1)) - 1")
    gone = F.aggregate(F.slice(f"__{first}", 1, F.col("step")), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.withColumns({"__own": own, "__gone": gone} | {f"removed_{c}": F.col(f"__{c}")[at] for c in counts})
    shapley = F.sum(f"removed_{first}").over(W.partitionBy("__part", "__own"))
    return rows.select(
        F.col("__part").alias(part), "filter_order", "step", (F.col("__all") - F.col("__gone")).alias("kept"), *[f"removed_{c}" for c in counts],
        (F.col("__fails")[F.col("__own")] - F.col(f"removed_{first}")).alias("redundant"), F.col("__alone")[F.col("__own")].alias("unique_fails"), shapley.alias("shapley"),
    )


def text_mask(text: Column) -> Column:
    """The mask of the filters A to D of a text, in the order of ``FILTERS``; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    # A let of one element: the words are found once for both counts.
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("own")))[0]
    small = n["all"] < 50
    repeated = 100 * n["own"].cast("long") < 65 * n["all"].cast("long")
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long")
    marked = text.rlike(r"[#$%&*|]")
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((small, repeated, loud, marked))), F.lit(0))


def mask_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents counted by source (null is an empty one) and the filters A to E that they fail.

    E: a smaller doc_id has the same text (by its SHA-256).  A null doc_id is larger than all
    others; rows that share the smallest one all pass.  good and toxic count ids that any row of
    ``labels`` marks so.  Copies are counted before they move, and only the smallest id
    of each text is looked for, so a text of many copies meets in no task.  Empty tables give
    no rows.
    """
    steps = Steps(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("hash"), F.lit(NULL_PARTS))).otherwise(0)
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), text_mask(F.col("text")).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "hash", "mask").agg(F.count("*").alias("docs")).withColumn("__salt", salt)
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
    rows = rows.join(marks.withColumn("__salt", F.lit(0).cast("long")), ["doc_id", "__salt"], "left").fillna(0, ["good", "toxic"])
    rows = steps.store(rows, "masks")
    by = ["part", "mask", "good", "toxic"]
    every = rows.groupBy(*by).agg(F.sum("docs").alias("docs"))
    # Of each text, the rows of its smallest id, as they stand in its parts.
    ids = rows.groupBy("hash", "doc_id").agg(F.collect_list(F.struct(*by, "docs")).alias("in"))
    least = ids.groupBy("hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "in")).alias("l"))
    firsts = least.select(F.inline("l.in")).groupBy(*by).agg(F.sum("docs").alias("firsts"))
    both = every.join(firsts, by, "left").fillna(0, ["firsts"])
    repeat = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask").alias("m"), F.col("firsts").alias("n")), F.struct((F.col("mask") + repeat).alias("m"), (F.col("docs") - F.col("firsts")).alias("n")))
    counted = both.select("part", "good", "toxic", F.inline(split))
    return counted.filter("n > 0").select("part", F.col("m").alias("mask"), F.col("n").alias("docs"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, by source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = audit_orders(mask_documents(docs, labels), "part", ["docs", "good", "toxic"])
    return found.select("part", "filter_order", "step", "kept", F.col("removed_docs").alias("removed"), "redundant", "unique_fails", F.col("removed_good").alias("good_lost"), F.col("removed_toxic").alias("toxic_lost"), "shapley")


_ORDERS = ", ".join(f"('{p}')" for p in ORDERS)
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (SELECT d.part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 5 * length(d.t) AS c,
  regexp_matches(d.t, '[#$%&*|]') AS x, d.doc_id > firsts.least AS e, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM d JOIN firsts ON firsts.t = d.t LEFT JOIN labels l ON l.doc_id = d.doc_id),
m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN x THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS mask,
  count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
o AS (SELECT * FROM (VALUES {_ORDERS}) v(filter_order)),
r AS (SELECT m.*, o.filter_order, s.step, substr(o.filter_order, s.step, 1) AS own, CASE WHEN mask = '' THEN 9 ELSE length(regexp_extract(o.filter_order, '^[^' || mask || ']*')) + 1 END AS gone
  FROM m, o, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 6)) s),
p AS (SELECT part, filter_order, step, own, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed, sum(n) FILTER (gone < step AND contains(mask, own)) AS redundant,
  sum(n) FILTER (mask = own) AS alone, sum(g) FILTER (gone = step) AS good, sum(x) FILTER (gone = step) AS toxic FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM p
"""
