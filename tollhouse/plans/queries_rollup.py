"""Queries of rollups, series and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollhouse.operators import joins as J
from tollhouse.operators import rollups as R
from tollhouse.plans.adapter import Tables
from tollhouse.plans.queries_cost import costed
from tollhouse.plans.registry import query

_MONEY = "CAST(sum(total_e4) AS BIGINT) AS spend_e4, CAST(sum(input_e4) AS BIGINT) AS input_spend_e4, CAST(sum(output_e4) AS BIGINT) AS output_spend_e4, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens"
#: A day inside the log.
DAY = "2024-01-20"

query("cost_totals_daily", f"SELECT day, {_MONEY} FROM cost GROUP BY 1")(lambda t: R.cost_totals_daily(costed(t)))
query("cost_by_provider", f"SELECT day, provider AS member, {_MONEY} FROM cost GROUP BY 1, 2")(lambda t: R.cost_by_provider(costed(t)))
query("cost_by_key", f"SELECT day, key_id AS member, {_MONEY} FROM cost WHERE key_id <> '' GROUP BY 1, 2")(lambda t: R.cost_by_key(costed(t)))
query("cost_by_user", f"SELECT day, 'user:' || user_id AS member, {_MONEY} FROM cost WHERE user_id <> '' GROUP BY 1, 2")(lambda t: R.cost_by_user(costed(t)))
query("rollup_hourly", f"SELECT 'cost' AS metric, day, hour, {_MONEY} FROM cost GROUP BY 2, 3")(lambda t: R.rollup_hourly(costed(t)))
query("rollup_monthly_key_spend", "SELECT strftime(day, '%Y-%m') AS month, key_id, CAST(sum(total_e4) AS BIGINT) AS spend_e4 FROM cost WHERE key_id <> '' GROUP BY 1, 2")(lambda t: R.rollup_monthly_key_spend(costed(t)))

_USED = "used AS (SELECT *, input_tokens + output_tokens AS tokens FROM usage WHERE input_tokens + output_tokens > 0)"
_SETS = f"""WITH {_USED}, sets AS (
SELECT day, 'total' AS dim, '' AS member, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM used GROUP BY 1
UNION ALL SELECT day, 'model', 'model:' || model, count(*), CAST(sum(tokens) AS BIGINT) FROM used WHERE model <> '' GROUP BY 1, 3
UNION ALL SELECT day, 'provider', 'provider:' || provider, count(*), CAST(sum(tokens) AS BIGINT) FROM used WHERE provider <> '' GROUP BY 1, 3
UNION ALL SELECT day, 'key', 'key:' || key_id, count(*), CAST(sum(tokens) AS BIGINT) FROM used WHERE key_id <> '' GROUP BY 1, 3
UNION ALL SELECT day, 'user', 'user:' || user_id, count(*), CAST(sum(tokens) AS BIGINT) FROM used WHERE user_id <> '' GROUP BY 1, 3)
"""
query("usage_totals_daily", f"WITH {_USED} SELECT day, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM used GROUP BY 1")(lambda t: R.usage_totals_daily(t.usage))
query("usage_grouping_sets", _SETS + "SELECT * FROM sets")(lambda t: R.usage_grouping_sets(t.usage))
query("usage_by_scope", _SETS + "SELECT day, member, requests, tokens FROM sets WHERE dim <> 'total'")(lambda t: R.usage_by_scope(t.usage))


def _deltas(t: Tables) -> DataFrame:
    cost = costed(t)
    parts = [R.long_form(R.cost_by_provider(cost.filter(f"request_id % 2 = {i}")), "cost", "by_provider", "member", ["spend_e4", "requests"]) for i in (0, 1)]
    return R.merge_deltas(*parts)


query("merge_deltas", """SELECT 'cost' AS metric, day, 'by_provider' AS dim, provider AS member, f.field, CAST(sum(CASE f.field WHEN 'requests' THEN 1 ELSE total_e4 END) AS BIGINT) AS value
FROM cost, (VALUES ('spend_e4'), ('requests')) AS f(field) GROUP BY day, provider, f.field""")(_deltas)
query("split_member_field", "SELECT 'cost' AS metric, day, 'by_provider' AS dim, provider AS member, CAST(sum(total_e4) AS BIGINT) AS spend_e4, count(*) AS requests FROM cost GROUP BY day, provider")(
    lambda t: R.split_member_field(_deltas(t).select("metric", "day", "dim", F.concat_ws("|", "member", "field").alias("member_field"), "value"), ["spend_e4", "requests"])
)
query("topn", "SELECT day, member, spend_e4, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY spend_e4 DESC, member) AS rank FROM (SELECT day, key_id AS member, CAST(sum(total_e4) AS BIGINT) AS spend_e4 FROM cost WHERE key_id <> '' GROUP BY 1, 2) a) b WHERE rank <= 5")(
    lambda t: R.topn(R.cost_by_key(costed(t)), ["day"], "spend_e4", "member", 5).select("day", "member", "spend_e4", "rank")
)
_ALL_KEYS = "k AS (SELECT key_id AS member, CAST(sum(total_e4) AS BIGINT) AS spend_e4, count(*) AS requests FROM cost GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY spend_e4 DESC, member) AS rn FROM k)"


def _all_keys(t: Tables) -> DataFrame:
    return costed(t).groupBy(F.col("key_id").alias("member")).agg(F.sum("total_e4").alias("spend_e4"), F.count("*").alias("requests"))


query("topn_collapse_all_measures", f"WITH {_ALL_KEYS} SELECT CASE WHEN rn <= 10 THEN member ELSE '(and ' || (SELECT count(*) - 10 FROM k) || ' others)' END AS member, CAST(sum(spend_e4) AS BIGINT) AS spend_e4, CAST(sum(requests) AS BIGINT) AS requests FROM r GROUP BY 1")(lambda t: R.topn_collapse_all_measures(_all_keys(t), "member", "spend_e4", ["spend_e4", "requests"]))
query("donut_slices", f"WITH {_ALL_KEYS} SELECT CASE WHEN rn <= 8 THEN member ELSE '(and ' || (SELECT count(*) - 8 FROM k) || ' others)' END AS member, CAST(sum(spend_e4) AS BIGINT) AS spend_e4 FROM r GROUP BY 1")(lambda t: R.donut_slices(_all_keys(t), "member", "spend_e4"))
query("share_of_total", f"WITH {_ALL_KEYS} SELECT member, spend_e4, CAST(spend_e4 AS DOUBLE) / CAST((SELECT sum(spend_e4) FROM k) AS DOUBLE) AS share FROM k WHERE spend_e4 > 0")(
    lambda t: R.share_of_total(_all_keys(t).withColumn("__all", F.lit(1)), ["__all"], "spend_e4").select("member", "spend_e4", "share")
)
_LAST = "days AS (SELECT DISTINCT day FROM cost ORDER BY day DESC LIMIT 7)"
query("range_totals", f"WITH {_LAST} SELECT CAST(sum(total_e4) AS BIGINT) AS spend_e4, count(*) AS requests FROM cost WHERE day IN (SELECT day FROM days)")(lambda t: R.range_totals(R.cost_totals_daily(costed(t)), ["spend_e4", "requests"], 7))
query("range_peaks", f"WITH {_LAST}, d AS (SELECT day, CAST(sum(total_e4) AS BIGINT) AS s FROM cost WHERE day IN (SELECT day FROM days) GROUP BY 1) SELECT max(s) AS spend_e4 FROM d")(lambda t: R.range_peaks(R.cost_totals_daily(costed(t)), ["spend_e4"], 7))
for _name, _f, _column, _member in (("range_by_provider", R.cost_by_provider, "provider", "provider"), ("range_by_key", R.cost_by_key, "key_id", "key_id"), ("range_by_user", R.cost_by_user, "user_id", "'user:' || user_id")):
    query(_name, f"WITH {_LAST} SELECT {_member} AS member, CAST(sum(total_e4) AS BIGINT) AS spend_e4, count(*) AS requests FROM cost WHERE {_column} <> '' AND day IN (SELECT day FROM days) GROUP BY 1")(lambda t, f=_f: R.range_by(f(costed(t)), "member", ["spend_e4", "requests"], 7))
query("range_by_scope", _SETS + ", days AS (SELECT DISTINCT day FROM sets ORDER BY day DESC LIMIT 7) SELECT member, CAST(sum(tokens) AS BIGINT) AS tokens FROM sets WHERE dim <> 'total' AND day IN (SELECT day FROM days) GROUP BY 1")(lambda t: R.range_by(R.usage_by_scope(t.usage), "member", ["tokens"], 7))
query("key_daily_series", f"""WITH cal AS (SELECT CAST(DATE '{DAY}' - CAST(range AS INT) AS DATE) AS day FROM range(0, 7)), d AS (SELECT key_id, day, CAST(sum(total_e4) AS BIGINT) AS v FROM cost GROUP BY 1, 2)
SELECT k.key_id, c.day, coalesce(d.v, 0) AS value FROM keys k CROSS JOIN cal c LEFT JOIN d ON d.key_id = k.key_id AND d.day = c.day""")(lambda t: R.key_daily_series(costed(t).groupBy("key_id", "day").agg(F.sum("total_e4").alias("v")), t.keys, "v", DAY))
query("daily_history", f"SELECT day, CAST(sum(total_e4) AS BIGINT) AS spend_e4 FROM cost WHERE day <= DATE '{DAY}' AND day > DATE '{DAY}' - 10 GROUP BY 1")(lambda t: R.daily_history(R.cost_totals_daily(costed(t)), DAY, 10).select("day", "spend_e4"))
query("recent_events", "SELECT request_id, provider, ts, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, request_id DESC) AS rank FROM usage) z WHERE rank <= 50")(lambda t: R.recent_events(t.usage, 50, ["provider"]).select("request_id", "provider", "ts", "rank"))

_SNAPS = "snaps AS (SELECT request_id, ts, day, hour, provider, CAST(request_id * 7919 % 13 AS INT) AS failures, CASE request_id % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'half_open' END AS state, request_id * 7919 % 13 >= 12 AS rollup_open FROM usage)"


def _snaps(t: Tables) -> DataFrame:
    n = (F.col("request_id") * 7919) % 13
    state = F.when(F.col("request_id") % 3 == 0, "closed").when(F.col("request_id") % 3 == 1, "open").otherwise("half_open")
    return t.usage.select("request_id", "ts", "day", "hour", "provider", n.cast("int").alias("failures"), state.alias("state"), (n >= 12).alias("rollup_open"))


_PEAK = "max(failures) AS failures, bool_or(rollup_open) AS rollup_open, arg_max(state, (ts, request_id)) AS state FROM snaps"
query("circuit_peak_daily", f"WITH {_SNAPS} SELECT day, provider, {_PEAK} GROUP BY 1, 2")(lambda t: R.circuit_peaks(_snaps(t), ["day"]))
query("circuit_peak_hourly", f"WITH {_SNAPS} SELECT day, hour, provider, {_PEAK} GROUP BY 1, 2, 3")(lambda t: R.circuit_peaks(_snaps(t), ["day", "hour"]))
query("provider_failure_series", f"WITH {_SNAPS} SELECT day, " + ", ".join(f"coalesce(max(CASE WHEN provider = '{p}' THEN failures END), 0) AS {p}" for p in ("anthropic", "gemini", "openai")) + " FROM snaps GROUP BY 1")(
    lambda t: R.provider_failure_series(R.circuit_peaks(_snaps(t), ["day"]), ["anthropic", "gemini", "openai"])
)

# Joins

_STATUS = """WITH known AS (SELECT provider, model AS name, model AS canonical, deprecated, replacement FROM catalog UNION SELECT provider, alias, model, deprecated, replacement FROM catalog),
gone AS (SELECT provider, model AS name, model AS canonical, replacement FROM retired UNION SELECT provider, alias, model, replacement FROM retired),
st AS (SELECT u.request_id, u.day, u.provider, u.model, CASE WHEN g.name IS NOT NULL THEN 'retired' WHEN k.deprecated THEN 'deprecated' WHEN k.name IS NULL THEN 'unknown' ELSE 'ok' END AS status,
  coalesce(g.canonical, k.canonical, u.model) AS canonical, coalesce(g.replacement, k.replacement, '') AS replacement
  FROM usage u LEFT JOIN known k ON k.provider = u.provider AND k.name = u.model LEFT JOIN gone g ON g.provider = u.provider AND g.name = u.model)
"""
query("model_status", _STATUS + "SELECT request_id, status, canonical, replacement FROM st")(lambda t: J.model_status(t.usage, t.catalog, t.retired).select("request_id", "status", "canonical", "replacement"))
query("retired_traffic", _STATUS + "SELECT request_id FROM st WHERE status = 'retired'")(lambda t: J.retired_traffic(t.usage, t.retired).select("request_id"))
query("unknown_traffic", _STATUS + "SELECT request_id FROM st WHERE canonical = model AND model NOT IN (SELECT name FROM known)")(lambda t: J.unknown_traffic(t.usage, t.catalog).select("request_id"))
query("model_status_daily", _STATUS + "SELECT day, status, provider || ':' || model AS name, count(*) AS n FROM st WHERE status <> 'ok' GROUP BY 1, 2, 3")(
    lambda t: J.model_status(t.usage, t.catalog, t.retired).filter("status <> 'ok'").groupBy("day", "status", F.concat_ws(":", "provider", "model").alias("name")).agg(F.count("*").alias("n"))
)
query("range_by_name", _STATUS + ", d AS (SELECT day, provider || ':' || model AS name, count(*) AS n FROM st WHERE status <> 'ok' GROUP BY 1, 2), days AS (SELECT DISTINCT day FROM d ORDER BY day DESC LIMIT 7) SELECT name, CAST(sum(n) AS BIGINT) AS n FROM d WHERE day IN (SELECT day FROM days) GROUP BY 1")(
    lambda t: R.range_by(J.model_status(t.usage, t.catalog, t.retired).filter("status <> 'ok'").groupBy("day", F.concat_ws(":", "provider", "model").alias("name")).agg(F.count("*").alias("n")), "name", ["n"], 7)
)
query("key_usage_join", f"SELECT k.key_id, k.provider, coalesce(c.s, 0) AS spend_e4, coalesce(c.n, 0) AS requests FROM keys k LEFT JOIN (SELECT key_id, CAST(sum(total_e4) AS BIGINT) AS s, count(*) AS n FROM cost WHERE day = DATE '{DAY}' GROUP BY 1) c ON c.key_id = k.key_id")(
    lambda t: J.key_usage_join(t.keys, costed(t), DAY).select("key_id", "provider", "spend_e4", "requests")
)
query("first_request_at", "SELECT key_id, min(ts) AS first_request_at FROM usage WHERE key_id <> '' GROUP BY 1")(lambda t: J.first_request_at(t.usage))
_REGISTRY = """WITH e AS (SELECT provider, key_id, 1 AS s, 0 AS r, 0 AS c, 'pii' AS src FROM usage WHERE request_id % 5 = 0
UNION ALL SELECT provider, key_id, 0, 1, total_e4, 'cost' FROM cost UNION ALL SELECT provider, key_id, 0, 0, 0, 'ban' FROM keys WHERE NOT enabled)
SELECT provider, key_id, CAST(sum(s) AS BIGINT) AS pii_scans, CAST(sum(r) AS BIGINT) AS cost_requests, CAST(sum(c) AS BIGINT) AS spend_e4, string_agg(DISTINCT src, ',' ORDER BY src) AS sources, bool_or(src = 'ban') AS banned FROM e GROUP BY 1, 2"""
query("credential_registry", _REGISTRY)(lambda t: J.credential_registry(t.usage.filter("request_id % 5 = 0"), costed(t), t.keys.filter("NOT enabled")))
query("merge_snapshots_max", """WITH a AS (SELECT key_id, count(*) AS n, CAST(sum(total_e4) AS BIGINT) AS e FROM cost WHERE request_id % 2 = 0 GROUP BY 1), b AS (SELECT key_id, count(*) AS n, CAST(sum(total_e4) AS BIGINT) AS e FROM cost WHERE request_id % 3 = 0 GROUP BY 1)
SELECT coalesce(a.key_id, b.key_id) AS key_id, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n, greatest(coalesce(a.e, 0), coalesce(b.e, 0)) AS e FROM a FULL JOIN b ON a.key_id = b.key_id""")(
    lambda t: J.merge_snapshots_max(*[costed(t).filter(f"request_id % {m} = 0").groupBy("key_id").agg(F.count("*").alias("n"), F.sum("total_e4").alias("e")) for m in (2, 3)], ["key_id"], ["n", "e"])
)
query("spend_limit_utilisation", f"""WITH s AS (SELECT key_id, CAST(sum(total_e4) AS BIGINT) AS spend_e4 FROM cost WHERE day = DATE '{DAY}' GROUP BY 1), j AS (SELECT k.key_id, k.daily_limit_cents AS lim, coalesce(s.spend_e4, 0) AS spend_e4 FROM keys k LEFT JOIN s ON s.key_id = k.key_id)
SELECT key_id, CASE WHEN lim > 0 THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, CAST(spend_e4 AS DOUBLE) / (lim * 100) * 100)) ELSE 0.0::DOUBLE END AS percent,
  CASE WHEN lim <= 0 THEN 'unlimited' WHEN CAST(spend_e4 AS DOUBLE) / (lim * 100) >= 0.95 THEN 'error' WHEN CAST(spend_e4 AS DOUBLE) / (lim * 100) >= 0.8 THEN 'warning' ELSE 'normal' END AS level FROM j""")(
    lambda t: J.spend_limit_utilisation(t.keys, costed(t).filter(F.col("day") == F.lit(DAY).cast("date")).groupBy("key_id").agg(F.sum("total_e4").alias("spend_e4"))).select("key_id", "percent", "level")
)
query("keys_by_owner", "SELECT key_id, provider, owner_email FROM keys WHERE owner_email = 'owner-1@corp.test' AND provider = 'anthropic'")(lambda t: J.keys_by_owner(t.keys, "owner-1@corp.test", "anthropic").select("key_id", "provider", "owner_email"))
query("backfill_key_limits", "SELECT key_id, CAST(CASE WHEN personal AND monthly_limit_cents = 300 THEN 500 ELSE monthly_limit_cents END AS BIGINT) AS monthly_limit_cents FROM keys")(
    lambda t: J.backfill_key_limits(t.keys, 300, 500, False).select("key_id", F.col("monthly_limit_cents").cast("long").alias("monthly_limit_cents"))
)
query("key_policy", "SELECT u.request_id, coalesce(k.redact_pii, true) AS flag FROM usage u LEFT JOIN keys k ON k.key_id = u.key_id")(lambda t: J.key_policy(t.usage, t.keys, True).select("request_id", "flag"))
query("key_day_report", f"""WITH d AS (SELECT key_id, day, CAST(sum(total_e4) AS BIGINT) AS v FROM cost GROUP BY 1, 2), cal AS (SELECT CAST(DATE '{DAY}' - CAST(range AS INT) AS DATE) AS day FROM range(0, 7)),
s AS (SELECT k.key_id, string_agg(CAST(coalesce(d.v, 0) AS VARCHAR), ',' ORDER BY c.day) AS series FROM keys k CROSS JOIN cal c LEFT JOIN d ON d.key_id = k.key_id AND d.day = c.day GROUP BY 1)
SELECT k.key_id, k.provider, coalesce((SELECT v FROM d WHERE d.key_id = k.key_id AND d.day = DATE '{DAY}'), 0) AS day_e4,
  CAST(coalesce((SELECT sum(v) FROM d WHERE d.key_id = k.key_id AND d.day BETWEEN DATE '2024-01-01' AND DATE '{DAY}'), 0) AS BIGINT) AS month_e4,
  (SELECT count(*) FROM usage u WHERE u.key_id = k.key_id AND u.day = DATE '{DAY}' AND u.request_id % 5 = 0) AS pii_scans, s.series FROM keys k JOIN s ON s.key_id = k.key_id""")(
    lambda t: J.key_day_report(t.keys, costed(t), t.usage.filter("request_id % 5 = 0"), DAY)
)
