"""Queries of sources and sinks: rows are written to a folder of the session's warehouse and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollhouse.plans.adapter import Tables
from tollhouse.plans.queries_cost import costed
from tollhouse.plans.registry import query
from tollhouse.sources import history as H


def _folder(t: Tables) -> str:
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tollhouse-{uuid.uuid4().hex}"


@query("read_history", "SELECT request_id, provider, input_tokens, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hour FROM usage")
def read_history(t: Tables) -> DataFrame:
    base = _folder(t)
    H.write_history(t.usage.select("request_id", "provider", "input_tokens", "ts"), base, "usage")
    return H.read_history(t.spark, base, "usage", "request_id long, provider string, input_tokens long").select("request_id", "provider", "input_tokens", "dt", "hour")


@query("write_history", "SELECT strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hour, count(*) AS n FROM usage WHERE strftime(ts, '%Y-%m-%d') IN ('2024-01-03', '2024-01-04') GROUP BY 1, 2")
def write_history(t: Tables) -> DataFrame:
    base = _folder(t)
    H.write_history(t.usage.select("request_id", "ts"), base, "usage", max_records=100, streams=("usage", "cost"))
    return H.read_history(t.spark, base, "usage", "request_id long", ["2024-01-03", "2024-01-04"]).groupBy("dt", "hour").agg(F.count("*").alias("n"))


@query("cost_jsonl_roundtrip", "SELECT request_id, key_id, total_e4 FROM cost")
def cost_jsonl_roundtrip(t: Tables) -> DataFrame:
    path = _folder(t)
    H.write_cost_jsonl(costed(t).select("request_id", "key_id", "total_e4"), path)
    return H.read_cost_jsonl(t.spark, path, "request_id long, key_id string, total_e4 long")


query("cost_keyed_records", """SELECT request_id, 'COST#' || strftime(ts, '%Y-%m-%d') AS pk, 'TIMESTAMP#' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z#' || request_id AS sk, 'PROVIDER#' || provider AS idx1pk, 'MODEL#' || model AS idx1sk, 'USER#' || user_id AS idx2pk,
 'PROVIDER#' || provider AS idx2sk, 'MODEL#' || model AS idx3pk, 'PROVIDER#' || provider AS idx3sk, CAST(floor(epoch(ts + INTERVAL 1 YEAR)) AS BIGINT) AS ttl, CAST(floor(epoch(ts)) AS BIGINT) AS ts_unix FROM cost""")(
    lambda t: H.cost_keyed_records(costed(t)).select("request_id", "pk", "sk", "idx1pk", "idx1sk", "idx2pk", "idx2sk", "idx3pk", "idx3sk", "ttl", "ts_unix")
)
query("cost_metric_points", """SELECT request_id, m.metric, CASE m.metric WHEN 'tokens.input' THEN CAST(input_tokens AS DOUBLE) WHEN 'tokens.output' THEN CAST(output_tokens AS DOUBLE) WHEN 'tokens.total' THEN CAST(input_tokens + output_tokens AS DOUBLE)
 WHEN 'cost.input_cents' THEN input_e4 / 100.0::DOUBLE WHEN 'cost.output_cents' THEN output_e4 / 100.0::DOUBLE WHEN 'cost.total_cents' THEN total_e4 / 100.0::DOUBLE ELSE 1.0::DOUBLE END AS value,
 'provider:' || provider || ',model:' || model || CASE WHEN user_id <> '' THEN ',user_id:' || user_id ELSE '' END AS tags
FROM cost, (VALUES ('tokens.input'), ('tokens.output'), ('tokens.total'), ('cost.input_cents'), ('cost.output_cents'), ('cost.total_cents'), ('requests.count')) AS m(metric)""")(
    lambda t: H.cost_metric_points(costed(t), ("user_id",)).withColumn("tags", F.array_join("tags", ","))
)
query("pii_metric_points", """SELECT 'pii.scans' AS metric, provider, CASE WHEN request_id % 3 = 0 THEN 'unknown' ELSE 'ok' END AS tag, count(*) AS value FROM usage GROUP BY 2, 3
UNION ALL SELECT 'pii.entities', provider, 'EMAIL_ADDRESS', CAST(sum(request_id % 4) AS BIGINT) FROM usage GROUP BY 2""")(
    lambda t: H.pii_metric_points(t.usage.withColumns({"outcome": F.when(F.col("request_id") % 3 == 0, "").otherwise("ok"), "entity_counts": F.create_map(F.lit("EMAIL_ADDRESS"), (F.col("request_id") % 4).cast("int"))}))
)
query("masked_id_lookup", "SELECT key_id AS pk, 1 AS n_matches FROM (SELECT DISTINCT key_id FROM keys) k")(lambda t: _looked_up(t))


def _looked_up(t: Tables) -> DataFrame:
    from tollhouse.functions import ids as I
    from tollhouse.operators.joins import masked_id_lookup

    masked = t.keys.select("key_id", I.parse_masked_id(I.mask_key_id(F.col("key_id"))).alias("m"))
    ids = masked.select("m.prefix", "m.hash")
    return masked_id_lookup(ids, masked.select("key_id", "m.hash")).select("pk", F.col("n_matches").cast("int").alias("n_matches"))
