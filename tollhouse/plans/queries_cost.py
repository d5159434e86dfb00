"""Queries of pricing and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollhouse.functions.surface import register_all
from tollhouse.operators import pricing as P
from tollhouse.operators import rollups as R
from tollhouse.plans.adapter import Tables
from tollhouse.plans.registry import query


def costed(t: Tables) -> DataFrame:
    """Cost rows of the whole log."""
    return P.cost_records(t.usage, t.pricing, t.catalog)


@query("pricing_rows", "SELECT provider, model, CAST(tier_no AS INT) AS tier_no, threshold, price_in, price_out FROM pricing WHERE provider IN (SELECT provider FROM usage)")
def pricing_rows(t: Tables) -> DataFrame:
    nested = t.pricing.groupBy("provider", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("tier_no", "threshold", "price_in", "price_out"))), lambda x: F.struct(x["threshold"].alias("threshold"), x["price_in"].alias("input"), x["price_out"].alias("output"))).alias("tiers"))
    return P.pricing_rows(nested).join(t.usage.select("provider").distinct(), "provider", "left_semi")


@query("resolve_alias", "SELECT u.request_id, u.provider, u.model, c.canonical FROM usage u JOIN canon c ON c.provider = u.provider AND c.model = u.model")
def resolve_alias(t: Tables) -> DataFrame:
    return P.resolve_alias(t.usage, t.catalog).select("request_id", "provider", "model", "canonical")


@query("price_exact", """WITH own AS (SELECT u.request_id, p.price_in, p.price_out, row_number() OVER (PARTITION BY u.request_id ORDER BY p.tier_no) AS rn FROM usage u
  JOIN pricing p ON p.provider = u.provider AND p.model = u.model WHERE p.threshold = 0 OR u.input_tokens <= p.threshold)
SELECT u.request_id, CASE WHEN u.provider = 'gemini' AND u.model = 'base-3' THEN CAST(9 AS DOUBLE) ELSE o.price_in END AS price_in,
  CASE WHEN u.provider = 'gemini' AND u.model = 'base-3' THEN CAST(18 AS DOUBLE) ELSE o.price_out END AS price_out
FROM usage u LEFT JOIN own o ON o.request_id = u.request_id AND o.rn = 1""")
def price_exact(t: Tables) -> DataFrame:
    overrides = t.pricing.filter("provider = 'gemini' AND model = 'base-3'").select("provider", "model", F.lit(9.0).alias("price_in"), F.lit(18.0).alias("price_out"))
    return P.price_exact(t.usage, t.pricing, overrides).select("request_id", "price_in", "price_out")


@query("price_tiered", """WITH own AS (SELECT u.request_id, p.price_in, row_number() OVER (PARTITION BY u.request_id ORDER BY p.tier_no) AS rn FROM usage u
  JOIN pricing p ON p.provider = u.provider AND p.model = u.model WHERE p.threshold = 0 OR u.input_tokens <= p.threshold)
SELECT u.request_id, u.input_tokens, o.price_in FROM usage u LEFT JOIN own o ON o.request_id = u.request_id AND o.rn = 1""")
def price_tiered(t: Tables) -> DataFrame:
    return P.price_tiered(t.usage, t.pricing).select("request_id", "input_tokens", "price_in")


@query("price_tiered_desc", """WITH own AS (SELECT u.request_id, p.price_in, row_number() OVER (PARTITION BY u.request_id ORDER BY p.threshold DESC) AS rn FROM usage u
  JOIN pricing p ON p.provider = u.provider AND p.model = u.model WHERE p.threshold = 0 OR u.input_tokens <= p.threshold)
SELECT u.request_id, u.input_tokens, o.price_in FROM usage u LEFT JOIN own o ON o.request_id = u.request_id AND o.rn = 1""")
def price_tiered_desc(t: Tables) -> DataFrame:
    return P.price_tiered_desc(t.usage, t.pricing).select("request_id", "input_tokens", "price_in")


@query("fuzzy_model_match", "SELECT provider, model, near AS matched_model, CAST(d AS INT) AS distance FROM fuzzy")
def fuzzy_model_match(t: Tables) -> DataFrame:
    names = P.resolve_alias(t.usage.select("provider", "model").distinct(), t.catalog)
    rest = names.join(t.pricing.select("provider", F.col("model").alias("canonical")).distinct(), ["provider", "canonical"], "left_anti")
    return P.fuzzy_model_match(rest, t.pricing)


@query("price_with_fallback", "SELECT request_id, matched_model, is_estimate, price_in, price_out FROM priced")
def price_with_fallback(t: Tables) -> DataFrame:
    return P.price_with_fallback(t.usage, t.pricing, t.catalog).select("request_id", "matched_model", "is_estimate", "price_in", "price_out")


@query("request_cost", "SELECT request_id, input_e4, output_e4, total_e4 FROM cost")
def request_cost(t: Tables) -> DataFrame:
    return P.request_cost(P.price_with_fallback(t.usage, t.pricing, t.catalog)).select("request_id", "input_e4", "output_e4", "total_e4")


@query("cost_records", "SELECT request_id, provider, model, key_id, user_id, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, total_e4 / 1e4 AS total_cost, is_estimate, coalesce(matched_model, '') AS matched_model FROM cost")
def cost_records(t: Tables) -> DataFrame:
    return costed(t).select("request_id", "provider", "model", "key_id", "user_id", "input_tokens", "output_tokens", "total_tokens", (F.col("total_e4") / F.lit(1e4)).alias("total_cost"), "is_estimate", "matched_model")


@query("cost_reconcile", "SELECT (SELECT count(*) FROM cost WHERE status = 200) AS n_obs, (SELECT CAST(sum(total_e4) AS BIGINT) FROM cost WHERE status = 200) AS total_obs, (SELECT count(*) FROM cost) AS n_exp, (SELECT CAST(sum(total_e4) AS BIGINT) FROM cost) AS total_exp")
def cost_reconcile(t: Tables) -> DataFrame:
    cost = costed(t)
    return P.cost_reconcile(cost.filter("status = 200"), cost)


@query("estimate_request_cost", "SELECT c.request_id, CAST(ceil(coalesce((input_tokens // 4) / 1e6 * p.price_in + 1024 / 1e6 * p.price_out, 0) * 1e4) AS BIGINT) AS est_e4 FROM cost c LEFT JOIN LATERAL (SELECT price_in, price_out FROM pricing q WHERE q.provider = c.provider AND q.model = c.matched_model AND (q.threshold = 0 OR c.input_tokens // 4 <= q.threshold) ORDER BY tier_no LIMIT 1) p ON true")
def estimate_request_cost(t: Tables) -> DataFrame:
    return P.estimate_request_cost(t.usage.withColumn("est_tokens", F.expr("input_tokens div 4")), t.pricing, t.catalog).select("request_id", "est_e4")


@query("reconcile_request_cost", "SELECT request_id, CAST(CASE WHEN status >= 500 THEN 0 WHEN input_tokens + output_tokens <= 0 THEN 77 ELSE total_e4 END AS BIGINT) AS actual_e4 FROM cost")
def reconcile_request_cost(t: Tables) -> DataFrame:
    return P.reconcile_request_cost(costed(t).withColumn("est_e4", F.lit(77))).select("request_id", "actual_e4")


@query("token_stats", """WITH r AS (SELECT provider, model, input_tokens AS tokens, output_tokens + 1 AS chars, row_number() OVER (PARTITION BY provider, model ORDER BY input_tokens) - 1 AS r, count(*) OVER (PARTITION BY provider, model) AS n FROM usage)
SELECT provider, model, max(CASE WHEN r = n // 2 THEN tokens END) AS p50, max(CASE WHEN r = (95 * n + 99) // 100 - 1 THEN tokens END) AS p95, CAST(sum(tokens) AS DOUBLE) * 1000 / CAST(sum(chars) AS DOUBLE) AS per_1k_chars, round(avg(tokens), 6) AS mean, round(stddev_pop(tokens), 6) AS stdev FROM r GROUP BY 1, 2""")
def token_stats(t: Tables) -> DataFrame:
    return P.token_stats(t.usage.withColumns({"tokens": F.col("input_tokens"), "chars": F.col("output_tokens") + 1}), ["provider", "model"]).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("topn_with_other", """WITH d AS (SELECT day, provider AS member, CAST(sum(total_e4) AS BIGINT) AS spend_e4 FROM cost GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY spend_e4 DESC, member) AS rn FROM d)
SELECT day, CASE WHEN rn <= 2 THEN member ELSE 'other_provider' END AS member, CAST(sum(spend_e4) AS BIGINT) AS spend_e4 FROM r GROUP BY 1, 2""")
def topn_with_other(t: Tables) -> DataFrame:
    return R.topn_with_other(R.cost_by_provider(costed(t)), ["day"], "spend_e4", "member", 2, "provider")


@query("sql_functions", "SELECT request_id, key_id[1:12] AS masked_start, length(key_id) > 12 AS hashed, input_e4, CAST(60 - CAST(floor(epoch(ts)) AS BIGINT) % 60 AS BIGINT) AS left, provider FROM cost")
def sql_functions(t: Tables) -> DataFrame:
    """The registered SQL functions over priced requests."""
    register_all(t.spark)
    text = """SELECT request_id, substring(mask_key_id(key_id), 1, 12) AS masked_start, length(mask_key_id(key_id)) = 21 AS hashed, cost_e4(input_tokens, price_in) AS input_e4,
        seconds_left(CAST(ts AS TIMESTAMP), 'minute') AS left, breaker_provider(concat(provider, ':', model)) AS provider FROM {rows}"""
    return t.spark.sql(text, rows=costed(t))
