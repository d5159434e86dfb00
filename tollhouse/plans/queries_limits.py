"""Queries of limits, failures and breakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollhouse.operators import breaker as B
from tollhouse.operators import failures as X
from tollhouse.operators import limits as L
from tollhouse.operators import rollups as R
from tollhouse.plans.adapter import Tables
from tollhouse.plans.queries_cost import costed
from tollhouse.plans.registry import query

query("running_key_spend", """SELECT request_id, CAST(coalesce(sum(total_e4) OVER (PARTITION BY key_id, day ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_day_e4,
  CAST(coalesce(sum(total_e4) OVER (PARTITION BY key_id, date_trunc('month', day) ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_month_e4 FROM cost""")(
    lambda t: L.running_key_spend(costed(t)).select("request_id", "prior_day_e4", "prior_month_e4")
)
query("spend_cap_replay", """WITH a AS (SELECT c.request_id, c.key_id, c.day, c.ts, c.total_e4, coalesce(k.daily_limit_cents, 0) AS dl, coalesce(k.monthly_limit_cents, 0) AS ml,
  coalesce(sum(c.total_e4) OVER (PARTITION BY c.key_id, c.day ORDER BY c.ts, c.request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pd FROM cost c LEFT JOIN keys k ON k.key_id = c.key_id),
b AS (SELECT *, dl > 0 AND (pd + 99) // 100 >= dl AS db FROM a),
m AS (SELECT *, coalesce(sum(CASE WHEN db THEN 0 ELSE total_e4 END) OVER (PARTITION BY key_id, date_trunc('month', day) ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pm FROM b),
n AS (SELECT *, ml > 0 AND (pm + 99) // 100 >= ml AS mb FROM m),
o AS (SELECT *, coalesce(sum(CASE WHEN mb THEN 0 ELSE total_e4 END) OVER (PARTITION BY key_id, day ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc FROM n)
SELECT request_id, mb OR (dl > 0 AND (pc + 99) // 100 >= dl) AS blocked, CASE WHEN dl > 0 AND (pc + 99) // 100 >= dl THEN 'daily' WHEN mb THEN 'monthly' ELSE '' END AS reason FROM o""")(
    lambda t: L.spend_cap_replay(costed(t), t.keys).select("request_id", "blocked", "reason")
)
#: Requests take up to an hour here, so that some are settled after midnight, and some never end.
_DONE = "CASE WHEN request_id % 50 <> 0 THEN ts + make_interval(0, 0, 0, 0, 0, 0, request_id % 3600) END"
query("spend_cap_reservation")(
    lambda t: L.spend_cap_reservation(costed(t).select("request_id", "key_id", "ts", "total_e4", (F.col("total_e4") + F.col("request_id") % 7 * 40 - 40).alias("est_e4"), F.expr(_DONE).alias("done_ts")), t.keys)
)
_SCOPES = """WITH sc AS (SELECT u.*, 'global' AS kind, 'global' AS scope_key FROM usage u UNION ALL SELECT u.*, 'provider', 'provider:' || provider FROM usage u WHERE provider <> '' UNION ALL SELECT u.*, 'model', 'model:' || model FROM usage u WHERE model <> ''
  UNION ALL SELECT u.*, 'key', 'key:' || key_id FROM usage u WHERE key_id <> '' UNION ALL SELECT u.*, 'user', 'user:' || user_id FROM usage u WHERE user_id <> '')
"""
query("scope_expand", _SCOPES + "SELECT request_id, kind, scope_key FROM sc")(lambda t: L.scope_expand(t.usage).select("request_id", "kind", "scope_key"))


def _overrides(t: Tables) -> DataFrame:
    key = F.concat(F.lit("key:"), "key_id")
    return t.keys.filter("personal").select(key.alias("scope_key"), F.lit("minute").alias("win"), F.lit(9).cast("long").alias("req_limit"), F.lit(0).cast("long").alias("tok_limit"))


query("effective_limits", _SCOPES + """SELECT DISTINCT s.scope_key, l.win, CASE WHEN k.key_id IS NOT NULL THEN 9 ELSE l.req_limit END AS req_limit, l.tok_limit FROM sc s JOIN limits l ON l.kind = s.kind
LEFT JOIN keys k ON k.personal AND s.scope_key = 'key:' || k.key_id AND l.win = 'minute'""")(lambda t: L.effective_limits(L.scope_expand(t.usage), t.limits, _overrides(t)))
query("rate_limit_usage", _SCOPES + """, w AS (SELECT s.scope_key, l.win, l.req_limit, l.tok_limit, CASE WHEN l.win = 'minute' THEN date_trunc('minute', s.ts) ELSE date_trunc('day', s.ts) END AS bucket, s.input_tokens + s.output_tokens AS tk FROM sc s JOIN limits l ON l.kind = s.kind),
g AS (SELECT scope_key, win, bucket, req_limit, tok_limit, count(*) AS requests, CAST(sum(tk) AS BIGINT) AS tokens FROM w GROUP BY ALL)
SELECT *, greatest(0, req_limit - requests) AS remaining, CASE WHEN req_limit > 0 AND requests > req_limit THEN 'requests' WHEN tok_limit > 0 AND tokens > tok_limit THEN 'tokens' ELSE '' END AS metric FROM g""")(
    lambda t: L.rate_limit_usage(t.usage, t.limits).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
)
query("rate_limit_replay_requests", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY key_id, date_trunc('minute', ts) ORDER BY ts, request_id) <= 1 AS m FROM usage WHERE key_id <> ''),
b AS (SELECT *, coalesce(sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY key_id, day ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM a)
SELECT request_id, m AND p < 10 AS allowed, CASE WHEN NOT m THEN 'minute' WHEN p >= 10 THEN 'day' ELSE '' END AS "window" FROM b""")(
    lambda t: L.rate_limit_replay_requests(t.usage, "key_id", 1, 10).select("request_id", "allowed", "window")
)
query("rate_limit_replay")(lambda t: L.rate_limit_replay(t.usage, "key_id", 2, 30_000, 14, 300_000))


def _admitted(t: Tables) -> DataFrame:
    return L.rate_limit_admission(t.usage, t.limits, _overrides(t), unit_s=3600)


query("rate_limit_admission")(lambda t: _admitted(t).select("request_id", "allowed", "scope_key", "metric", "win", "lim", "retry_after"))
query("ratelimit_daily")(lambda t: L.rate_limit_daily(_admitted(t).withColumn("day", F.to_date("ts"))))
query("retry_after", "SELECT request_id, CAST(60 - CAST(epoch(ts) AS BIGINT) % 60 AS BIGINT) AS minute_left, CAST(86400 - CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS BIGINT) AS day_left FROM usage".replace("CAST(epoch(ts) AS BIGINT) % 60", "CAST(floor(epoch(ts)) AS BIGINT) % 60"))(
    lambda t: t.usage.select("request_id", L.retry_after(F.col("ts"), F.lit("minute")).alias("minute_left"), L.retry_after(F.col("ts"), F.lit("day")).alias("day_left"))
)
query("rate_limit_reconcile", """WITH r AS (SELECT key_id, ts, status, ts + INTERVAL 25 SECOND AS done_ts, input_tokens AS est, CASE WHEN status >= 500 THEN 0 ELSE input_tokens + output_tokens END AS act FROM usage WHERE key_id <> '')
SELECT key_id, date_trunc('minute', ts) AS bucket, CAST(greatest(0, sum(CASE WHEN date_trunc('minute', ts) = date_trunc('minute', done_ts) AND status >= 500 AND act <= 0 THEN 0 ELSE 1 END)) AS BIGINT) AS requests,
  CAST(greatest(0, sum(CASE WHEN date_trunc('minute', ts) = date_trunc('minute', done_ts) AND status >= 500 AND act <= 0 THEN 0 WHEN date_trunc('minute', ts) = date_trunc('minute', done_ts) THEN act ELSE est END)) AS BIGINT) AS tokens FROM r GROUP BY 1, 2""")(
    lambda t: L.rate_limit_reconcile(t.usage.withColumns({"done_ts": F.col("ts") + F.expr("INTERVAL 25 SECONDS"), "est_tokens": F.col("input_tokens"), "actual_tokens": F.when(F.col("status") >= 500, 0).otherwise(F.col("input_tokens") + F.col("output_tokens"))}), "key_id").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
)

# Failures

#: Recorded answers of providers: every status, body, header and transport error that the classes and kinds tell apart.
_BODIES = """CASE WHEN status = 200 THEN NULL WHEN request_id % 10 = 7 THEN '{"error":{"code":"insufficient_quota","message":"You exceeded your quota"}}' WHEN request_id % 10 = 1 THEN '{"error":{"status":"RESOURCE_EXHAUSTED","message":"Quota exceeded for today"}}'
  WHEN request_id % 10 = 5 THEN '{"error":{"status":"RESOURCE_EXHAUSTED","message":"slow down"}}' WHEN request_id % 10 = 3 THEN '{"error":{"type":"rate_limit_error","message":"billing"}}' WHEN request_id % 10 = 0 THEN '{"error":{"status":"INTERNAL","type":"api_error","message":"m"}}'
  WHEN request_id % 10 = 8 THEN concat('{"error":{"status":"UNAVAILABLE","message":"', repeat('x', 600), '"}}') ELSE '{"error":{"type":"overloaded_error","status":"UNAVAILABLE","message":" Try later "}}' END"""
_ERRORS = "CASE WHEN status <> 200 THEN NULL WHEN request_id % 50 = 1 THEN 'dial tcp: lookup x: no such host' WHEN request_id % 50 = 2 THEN 'Post x: context deadline exceeded' WHEN request_id % 50 = 3 THEN 'context canceled' WHEN request_id % 50 = 4 THEN 'Post x: EOF' WHEN request_id % 50 = 5 THEN 'unexpected EOF' WHEN request_id % 50 = 6 THEN 'read tcp a: broken pipe' WHEN request_id % 50 = 7 THEN 'odd' ELSE NULL END"
_REQUESTS = "CASE WHEN status <> 429 OR request_id % 24 >= 18 THEN NULL WHEN request_id % 8 = 3 THEN '0' ELSE '17' END"
_TOKENS = "CASE WHEN status <> 429 OR request_id % 24 >= 18 THEN NULL WHEN request_id % 16 = 3 THEN ' 0' ELSE '100' END"
_WAIT = "CASE WHEN status <> 429 OR request_id % 24 >= 18 THEN NULL WHEN request_id % 5 = 1 THEN '75' WHEN request_id % 5 = 2 THEN '12' ELSE NULL END"
_ANSWERS = f"request_id, ts, day, provider, model, status, {_BODIES} AS error_body, {_REQUESTS} AS remaining_requests, {_TOKENS} AS remaining_tokens, {_WAIT} AS retry_after, {_ERRORS} AS transport_error, request_id % 97 = 0 AS aborted"
_OUT = f"""out AS (SELECT {_ANSWERS}, CASE WHEN length({_BODIES}) <= 512 THEN {_BODIES} END AS b FROM usage),
cls AS (SELECT *, CASE WHEN transport_error = 'context canceled' THEN 'none' WHEN transport_error IS NOT NULL OR status >= 500 THEN 'provider_degraded' WHEN status <> 429 THEN 'none'
  WHEN provider = 'openai' AND b->>'$.error.code' = 'insufficient_quota' THEN 'insufficient_quota'
  WHEN provider = 'openai' AND remaining_requests IS NULL AND remaining_tokens IS NULL AND retry_after IS NULL THEN 'global_rate_limit'
  WHEN provider = 'gemini' THEN CASE WHEN b->>'$.error.status' = 'RESOURCE_EXHAUSTED' AND (b->>'$.error.message') ILIKE '%quota%' THEN 'global_rate_limit' ELSE 'localized_rate_limit' END
  WHEN trim(remaining_requests) = '0' AND trim(remaining_tokens) = '0' OR CAST(retry_after AS INT) >= 60 THEN 'global_rate_limit' ELSE 'localized_rate_limit' END AS failure_class FROM out)"""


def outcomes(t: Tables) -> DataFrame:
    """Upstream outcomes with bodies, headers and transport errors."""
    return t.usage.selectExpr(*[f"{x} AS {name}" for name, x in (("error_body", _BODIES), ("remaining_requests", _REQUESTS), ("remaining_tokens", _TOKENS), ("retry_after", _WAIT), ("transport_error", _ERRORS), ("aborted", "request_id % 97 = 0"))], "request_id", "ts", "day", "provider", "model", "status")


query("classify_failure", f"WITH {_OUT} SELECT request_id, failure_class FROM cls")(lambda t: X.classify_failure(outcomes(t)).select("request_id", "failure_class"))
query("failure_kind", f"""WITH {_OUT} SELECT request_id, CASE WHEN transport_error LIKE '%no such host' THEN 'dns_failure' WHEN transport_error LIKE '%deadline exceeded' THEN 'client_deadline_exceeded' WHEN transport_error = 'context canceled' THEN 'client_canceled' WHEN transport_error = 'unexpected EOF' THEN 'unexpected_eof'
  WHEN transport_error LIKE '%EOF' THEN 'eof' WHEN transport_error LIKE 'read tcp%' THEN 'network_other' WHEN transport_error IS NOT NULL THEN 'unknown_transport' WHEN status < 400 THEN ''
  WHEN provider = 'gemini' AND status = 503 AND b->>'$.error.status' = 'UNAVAILABLE' THEN 'gemini_unavailable' WHEN provider = 'gemini' AND status = 429 AND b->>'$.error.status' = 'RESOURCE_EXHAUSTED' THEN 'gemini_resource_exhausted' WHEN provider = 'gemini' AND status = 500 AND b->>'$.error.status' = 'INTERNAL' THEN 'gemini_internal'
  WHEN provider = 'anthropic' AND status = 529 AND coalesce(b->>'$.error.type', '') IN ('', 'overloaded_error') THEN 'anthropic_overloaded' WHEN provider = 'anthropic' AND status = 429 AND b->>'$.error.type' = 'rate_limit_error' THEN 'anthropic_rate_limit' WHEN provider = 'anthropic' AND status = 500 AND b->>'$.error.type' = 'api_error' THEN 'anthropic_api_error'
  WHEN failure_class = 'insufficient_quota' THEN 'openai_insufficient_quota' WHEN status = 529 THEN 'http_overloaded' WHEN status >= 500 THEN 'http_' || status
  WHEN failure_class = 'global_rate_limit' THEN 'http_429_global' ELSE 'http_429_local' END AS failure_kind FROM cls""")(lambda t: X.failure_kind(outcomes(t)).select("request_id", "failure_kind"))
query("error_detail", f"""WITH {_OUT} SELECT request_id, coalesce(error_body->>'$.error.code', error_body->>'$.error.type', error_body->>'$.error.status', '') AS error_code,
  left(trim(CASE WHEN error_body IS NULL THEN '' ELSE coalesce(error_body->>'$.error.code', error_body->>'$.error.type', error_body->>'$.error.status') || ': ' || (error_body->>'$.error.message') END), 200) AS error_detail FROM out""")(lambda t: X.error_detail(outcomes(t)).select("request_id", "error_code", "error_detail"))
query("parse_retry_after", "SELECT request_id, CASE WHEN request_id % 2 = 0 THEN request_id % 100 ELSE CAST(greatest(0, ceil(epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(ts))) AS BIGINT) END AS seconds FROM usage")(
    lambda t: t.usage.select("request_id", X.parse_retry_after(F.when(F.col("request_id") % 2 == 0, (F.col("request_id") % 100).cast("string")).otherwise("Mon, 15 Jan 2024 12:00:00 GMT"), F.col("ts")).cast("long").alias("seconds"))
)
query("failure_window_count", f"""WITH {_OUT}, f AS (SELECT *, epoch_us(ts) AS us FROM cls WHERE failure_class = 'provider_degraded')
SELECT request_id, count(*) OVER (PARTITION BY provider, model ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS failures FROM f""")(
    lambda t: X.failure_window_count(X.classify_failure(outcomes(t)).filter("failure_class = 'provider_degraded'"), 3600).select("request_id", "failures")
)


#: Thresholds at which this traffic opens breakers by failures, by quota and by the rollup, probes, closes and opens them again.
BREAKERS = {"threshold": 2, "window_s": 36_000, "cooldown_s": 43_200, "rollup_threshold": 4, "rollup_window_s": 43_200, "bucket_s": 86_400}


def _replayed(t: Tables) -> DataFrame:
    return B.breaker_replay(X.classify_failure(outcomes(t)), **BREAKERS)


query("breaker_replay")(lambda t: _replayed(t).drop("ts"))
query("breaker_events")(lambda t: B.breaker_events(_replayed(t)).drop("ts"))
query("circuit_activity_daily")(lambda t: B.circuit_activity_daily(_replayed(t)))
query("circuit_blocked_daily")(lambda t: B.circuit_blocked_daily(_replayed(t)))
query("range_circuit_activity")(lambda t: R.range_totals(B.circuit_activity_daily(_replayed(t)).filter("provider = ''"), list(B.ACTIVITY), 7))
query("range_blocked_by_key")(lambda t: R.range_by(B.circuit_blocked_daily(_replayed(t)), "key", ["blocked"], 7))
query("force_open", f"WITH {_OUT} SELECT request_id, provider AS key, ts AS opened_at, ts + INTERVAL 300 SECOND AS open_until FROM cls WHERE failure_class = 'insufficient_quota'")(lambda t: X.force_open(X.classify_failure(outcomes(t))))
query("provider_health", """WITH st AS (SELECT provider || ':' || model AS key, count(*) FILTER (status >= 500) AS failures, CASE max(request_id) % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'half_open' END AS state, max(ts) AS cooldown_until FROM usage GROUP BY 1)
SELECT split_part(key, ':', 1) AS provider, CAST(sum(failures) AS BIGINT) AS failures, CASE max(CASE state WHEN 'open' THEN 2 WHEN 'half_open' THEN 1 ELSE 0 END) WHEN 2 THEN 'open' WHEN 1 THEN 'half_open' ELSE 'closed' END AS state, min(cooldown_until) AS cooldown_until FROM st GROUP BY 1""")(
    lambda t: X.provider_health(
        t.usage.groupBy(F.concat_ws(":", "provider", "model").alias("key")).agg(F.count(F.when(F.col("status") >= 500, 1)).alias("failures"), F.when(F.max("request_id") % 3 == 0, "closed").when(F.max("request_id") % 3 == 1, "open").otherwise("half_open").alias("state"), F.max("ts").alias("cooldown_until"))
    )
)
def rollup_events(t: Tables) -> DataFrame:
    """Openings and recoveries of keys, as events of breakers."""
    kept = X.classify_failure(outcomes(t)).filter("failure_class = 'provider_degraded' OR request_id % 40 = 9")
    return kept.select("request_id", "provider", "ts", F.col("model").alias("key"), F.when(F.col("failure_class") == "provider_degraded", "opened").otherwise("probe_closed").alias("kind"))


query("provider_rollup_open", f"""WITH {_OUT}, e AS (SELECT request_id, provider, model, ts, epoch_us(ts) AS us, CASE WHEN failure_class = 'provider_degraded' THEN 'opened' ELSE 'probe_closed' END AS kind FROM cls WHERE failure_class = 'provider_degraded' OR request_id % 40 = 9),
l AS (SELECT a.request_id, a.provider, a.ts, b.model, arg_max(b.kind, (b.us, b.request_id)) AS kind, max(b.us) FILTER (b.kind = 'opened') AS us, a.us AS now FROM e a JOIN e b ON b.provider = a.provider AND (b.us, b.request_id) <= (a.us, a.request_id) AND b.us > a.us - 36000000000 WHERE a.kind = 'opened' GROUP BY a.request_id, a.provider, a.ts, b.model, a.us)
SELECT request_id, provider, ts, count(*) FILTER (kind = 'opened') >= 2 AS open, count(*) FILTER (kind = 'opened') AS count FROM l GROUP BY 1, 2, 3""")(
    lambda t: X.provider_rollup_open(rollup_events(t), 2, 36_000)
)
query("log_mode_counterfactual")(lambda t: B.log_mode_counterfactual(X.classify_failure(outcomes(t)), **BREAKERS))
query("timeout_credit_filter", "SELECT request_id, NOT (request_id % 4 = 0 AND request_id % 30 < 12) AS credited FROM usage WHERE status >= 500")(
    lambda t: X.timeout_credit_filter(t.usage.filter("status >= 500").withColumns({"caller_shortened": F.col("request_id") % 4 == 0, "elapsed_s": (F.col("request_id") % 30).cast("double")}), 12.0).select("request_id", "credited")
)
