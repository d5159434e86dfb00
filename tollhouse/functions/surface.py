"""The library's functions for use in ``spark.sql``: SQL functions, functions of texts and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tollhouse.functions import pii

_HASH = "lower(lpad(hex(aggregate(filter(transform(split(key, ''), c -> CAST(ascii(c) AS BIGINT)), c -> c > 0), 2166136261L, (a, b) -> ((a ^ b) * 16777619L) & 4294967295L)), 8, '0'))"
#: Functions that SQL itself expresses: arguments, type and body; Spark puts the body in place of the call.
SQL_FUNCTIONS = {
    "mask_key_id": ("key STRING", "STRING", f"CASE WHEN length(key) <= 12 THEN key ELSE concat(substring(key, 1, 12), '…', {_HASH}) END"),
    "breaker_provider": ("key STRING", "STRING", "substring_index(key, ':', 1)"),
    "breaker_model": ("key STRING", "STRING", "CASE WHEN instr(key, ':') > 0 THEN substring(key, instr(key, ':') + 1) ELSE '' END"),
    "cost_e4": ("tokens BIGINT, usd_per_million DOUBLE", "BIGINT", "CAST(ceil(coalesce(tokens / 1e6D * usd_per_million, 0D) * 1e4D) AS BIGINT)"),
    "seconds_left": ("at TIMESTAMP, win STRING", "BIGINT", "CASE WHEN win = 'minute' THEN 60 - pmod(unix_seconds(at), 60) ELSE 86400 - pmod(unix_seconds(at), 86400) END"),
    "pii_tier": ("kind STRING", "STRING", "CASE kind " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in pii.POLICY.items()) + " ELSE 'REDACT' END"),
}


class PiiSpans:
    """Rows of a table function: the final spans of a text, none of a null one."""

    def eval(self, text: str | None) -> Iterator[tuple[int, int, str, float, str]]:
        for s in pii.final_spans(text) if text else ():
            yield s["start"], s["end"], s["entity_type"], float(s["score"]), text[s["start"] : s["end"]]


def register_all(spark: SparkSession) -> None:
    """Registers, for this session: ``SQL_FUNCTIONS``; redact_text(text) and scrub_body(body, provider); and the table function pii_spans(text).

    pii_spans gives start, end (characters), entity_type, score and value, one row a span, for use
    as ``FROM t, LATERAL pii_spans(t.text)``.  Null arguments give null, no rows for pii_spans.
    """

    @F.pandas_udf("string")
    def redact_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pii.redact(t, pii.final_spans(t)))

    @F.pandas_udf("string")
    def scrub_body(bodies: pd.Series, providers: pd.Series) -> pd.Series:
        spans = lambda b, p: [pii.leaf_spans(t, o) for *_, t, o in pii.json_leaves(b, p)[1]]
        return pd.Series([None if b is None else pii.put_leaves(b, p, spans(b, p), pii.Registry()) for b, p in zip(bodies, providers, strict=True)])

    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udf.register("redact_text", redact_text)
    spark.udf.register("scrub_body", scrub_body)
    spark.udtf.register("pii_spans", F.udtf(PiiSpans, returnType="start int, end int, entity_type string, score double, value string"))
