"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollhouse.llm.audit import OP13_SQL, op13_filter_audit
from tollhouse.llm.bpe import op8_batched_bpe
from tollhouse.llm.jaccard import op6_jaccard_join
from tollhouse.llm.merkle import OP11_SQL, op11_merkle_manifest
from tollhouse.llm.mtree import OP9_SQL, op9_mtree_top_k
from tollhouse.llm.packing import op5_harmonic_pack
from tollhouse.llm.quality import op4_positive_unlabelled
from tollhouse.llm.repeats import op7_radix_repeats
from tollhouse.llm.sharding import OP2_SQL, op2_extendible_hashing
from tollhouse.llm.simhash import op12_simhash
from tollhouse.llm.sstable import op3_sstable
from tollhouse.llm.webp import op1_webp
from tollhouse.llm.wrapper import op10_wrapper_induction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_webp": op1_webp,
    "op2_extendible_hashing": op2_extendible_hashing,
    "op3_sstable": op3_sstable,
    "op4_positive_unlabelled": op4_positive_unlabelled,
    "op5_harmonic_pack": op5_harmonic_pack,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_radix_repeats": op7_radix_repeats,
    "op8_batched_bpe": op8_batched_bpe,
    "op9_mtree_top_k": op9_mtree_top_k,
    "op10_wrapper_induction": op10_wrapper_induction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash": op12_simhash,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {"op2_extendible_hashing": OP2_SQL, "op9_mtree_top_k": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_filter_audit": OP13_SQL}
