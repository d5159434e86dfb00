"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and is written as
Parquet and read again for the next.  All but the last return those columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollhouse.llm.common import stored
from tollhouse.llm.jaccard import jaccard_rows
from tollhouse.llm.packing import harmonic_pack
from tollhouse.llm.quality import fit_quality, score_quality
from tollhouse.llm.repeats import remove_repeats

#: Documents with a lower score go.
LEAST_QUALITY = 0.3
#: Five-word shingles at a similarity of 0.8 or more.
WIDTH, NUM, DEN = 5, 8, 10
#: Bytes of a repeated passage: fewer than 50 words of usual length have.
PASSAGE_BYTES = 200
#: Up to so many ids (8 bytes each) are broadcast; beyond, they are joined.
BROADCAST_IDS = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, out="__score").filter(F.col("__score") >= LEAST_QUALITY).drop("__score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id; rows without shingles all stay.

    Rows are told apart by id and text: other texts under the id of a row that goes stay.
    """
    groups = stored(jaccard_rows(docs, width=WIDTH, num=NUM, den=DEN), "groups").filter("n_shingles > 0")
    stands = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("component_row"))
    gone = groups.filter(~stands).select(F.col("doc_id").alias("__gone"), F.col("row").alias("__hash")).distinct()
    few = gone.count() <= BROADCAST_IDS
    rows = docs.withColumn("__row", F.xxhash64("text"))
    same = rows.doc_id.eqNullSafe(F.col("__gone")) & (F.col("__row") == F.col("__hash"))
    kept = rows.join(F.broadcast(gone) if few else gone, same, "left_anti")
    again = stored(groups.filter(stands).groupBy("doc_id", "row").count().filter("count > 1").select(F.col("doc_id").alias("__gone"), F.col("row").alias("__hash")), "again")
    if not again.isEmpty():
        # The very row that stands for its group is repeated.
        once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__row"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop("__row")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur again; bytes of characters cut in two go as well."""
    done = remove_repeats(docs, threshold=PASSAGE_BYTES, decoded=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).withColumnRenamed("kept", "text").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    return harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: SQL cannot express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
