"""Extendible hashing of rows into shards under a byte limit.

A directory over the leading bits of a row's hash; only a bucket above the limit splits on
one more bit.  A bucket of depth d holds the rows whose first d bits agree, so the depth of
a row is the least d at which its bucket fits.  Bytes are summed once at a fine depth, and the
coarser buckets are sums of those sums: rows are never shuffled to find the directory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollhouse.llm.common import stored

#: Bytes of text a shard holds at most.
SHARD_LIMIT = 1 << 20
WORD = 32
#: Bits counted at once below the expected depth.
EXTRA_BITS = 5


def _word(hexadecimal: Column) -> Column:
    """The first 32 bits of a hash in hexadecimal."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long")


def _depths(rows: DataFrame, word: str, low: int, high: int, limit: int) -> DataFrame:
    """(cell of ``high`` bits within ``word``, __d: least fitting depth from ``low`` to ``high``, null if none)."""
    by = ["__path", "__cell"]
    cells = rows.withColumn("__cell", F.shiftright(word, WORD - high)).groupBy(*by).agg(F.sum("__bytes").alias("b"), F.count("*").alias("n"))
    levels = cells.select(*by, "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("__d"))
    bucket = F.expr(f"shiftright(__cell, {high} - __d)")
    sums = levels.groupBy("__path", "__d", bucket.alias("__bucket")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    fits = sums.filter((F.col("b") <= limit) | (F.col("n") == 1)).select("__path", "__d", "__bucket")
    fitting = levels.withColumn("__bucket", bucket).join(fits, ["__path", "__d", "__bucket"]).groupBy(*by).agg(F.min("__d").alias("__d"))
    return cells.select(*by).join(fitting, by, "left")


def assign_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_LIMIT) -> DataFrame:
    """``docs`` with ``shard`` (the bits of its bucket, '' for the only one), depth, shard_bytes and shard_docs.

    The hash is the MD5 of the key as text; where all its first 32 bits agree above the
    limit (a key with very many rows), the MD5 of the text and then a row number give further
    bits, so that any bucket can be split down to one row.  A single row above the limit is
    a shard of its own.  Null keys and texts count as empty.  Columns of the new names are
    replaced.  An empty table gives no rows.
    """
    own = docs.drop("shard", "depth", "shard_bytes", "shard_docs")
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = own.withColumns({"__bytes": F.octet_length(text).cast("long"), "__w0": _word(F.md5(key)), "__path": F.lit("")})
    total = rows.agg(F.sum("__bytes")).first()[0] or 0
    high = min(WORD, max(1, math.ceil(math.log2(max(1, total / limit)))) + EXTRA_BITS)
    parts: list[DataFrame] = []
    low, word = 0, 0
    while True:
        name = f"__w{word}"
        depths = _depths(rows, name, low, high, limit)
        open_cells = stored(depths, "depths")
        marked = rows.withColumn("__cell", F.shiftright(name, WORD - high)).join(open_cells, ["__path", "__cell"])
        bits = F.expr(f"substring(lpad(bin(`{name}`), {WORD}, '0'), 1, __d)")
        parts.append(marked.filter("__d IS NOT NULL").withColumn("shard", F.concat("__path", bits)).select(*own.columns, "shard", "__bytes"))
        if open_cells.filter("__d IS NULL").isEmpty():
            break
        rows = marked.filter("__d IS NULL").drop("__d", "__cell")
        if high < WORD:
            low, high = high + 1, WORD
            continue
        rows = rows.withColumn("__path", F.concat("__path", F.lpad(F.bin(name), WORD, "0")))
        word += 1
        if word > 2:
            raise RuntimeError("rows could not be told apart")
        # Row numbers are kept in a stored table: they must not change when a task is run again.
        rows = rows.withColumn(f"__w{word}", _word(F.md5(text)) if word == 1 else F.shiftright(F.xxhash64(F.monotonically_increasing_id()), 32) + (1 << 31))
        rows = stored(rows, "split-on") if word == 2 else rows
        low, high = 0, WORD
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    sizes = out.groupBy("shard").agg(F.sum("__bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return out.drop("__bytes").join(sizes, "shard").withColumn("depth", F.length("shard").cast("long"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes rows with a ``shard`` column, one folder a shard."""
    assigned.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def op2_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "shard", "depth", "shard_bytes", "shard_docs")


OP2_SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS b,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
buckets AS (
  SELECT d, h >> (32 - d) AS p, sum(b) AS b, count(*) AS n
  FROM rows, (SELECT CAST(range AS INTEGER) AS d FROM range(0, 33)) GROUP BY 1, 2),
fit AS (SELECT d, p, b, n FROM buckets WHERE b <= {SHARD_LIMIT} OR n = 1),
least AS (
  SELECT r.doc_id, r.h, min(f.d) AS d FROM rows r JOIN fit f ON f.p = r.h >> (32 - f.d) GROUP BY 1, 2)
SELECT l.doc_id, substr(lpad(bin(l.h), 32, '0'), 1, l.d) AS shard, CAST(l.d AS BIGINT) AS depth,
       CAST(f.b AS BIGINT) AS shard_bytes, CAST(f.n AS BIGINT) AS shard_docs
FROM least l JOIN fit f ON f.d = l.d AND f.p = l.h >> (32 - l.d)
"""
