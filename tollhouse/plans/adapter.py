"""A deterministic request log and its dimension tables, derived from ``events``.

The SQL is the same text for Spark and DuckDB: ``tables`` runs it in Spark, ``PRELUDE`` is
its form as common table expressions for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROVIDERS = ("anthropic", "gemini", "openai")

_USAGE = """
SELECT event_id AS request_id, ts, CAST(ts AS DATE) AS day, CAST(EXTRACT(hour FROM ts) AS INT) AS hour,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('user-', CAST(user_id AS STRING)) END AS user_id,
  concat('sk-iw-', lpad(CAST(user_id % 20 AS STRING), 10, '0')) AS key_id,
  CASE event_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gemini' END AS provider,
  CASE event_id % 7 WHEN 0 THEN 'base-4' WHEN 1 THEN 'base-4-latest' WHEN 2 THEN 'base-4-minis' WHEN 3 THEN 'zzz-experimental'
    WHEN 4 THEN 'base-2' WHEN 5 THEN 'base-3' ELSE 'tiered-1' END AS model,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 10 AS output_tokens,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 4 = 0 THEN 500 WHEN event_id % 4 = 1 THEN 503 WHEN event_id % 4 = 2 THEN 529 ELSE 429 END AS status,
  event_type
FROM events
"""

#: USD per million tokens; threshold 0 holds for any number of input tokens (fixed values of the fixture).
_PRICES = [
    ("base-4", 0, 0, 2.5, 10.0),
    ("base-4-mini", 0, 0, 0.15, 0.6),
    ("base-3", 0, 0, 1.123456789, 3.3),
    ("tiered-1", 0, 5000, 1.25, 5.0),
    ("tiered-1", 1, 20000, 2.0, 7.5),
    ("tiered-1", 2, 0, 2.5, 10.0),
]
_FACTOR = {"openai": 1.0, "anthropic": 1.2, "gemini": 0.5}
_PRICING = "SELECT * FROM (VALUES\n" + ",\n".join(f"('{p}', '{m}', {i}, CAST({t} AS BIGINT), CAST({a * f!r} AS DOUBLE), CAST({b * f!r} AS DOUBLE))" for p, f in _FACTOR.items() for m, i, t, a, b in _PRICES) + ") AS t(provider, model, tier_no, threshold, price_in, price_out)"
_CATALOG = "SELECT * FROM (VALUES\n" + ",\n".join(f"('{p}', '{m}', '{a}', {str(d).lower()}, '{r}')" for p in _FACTOR for m, a, d, r in (("base-4", "base-4-latest", False, ""), ("base-4-mini", "base-4-small", False, ""), ("base-3", "base-3-old", True, "base-4"), ("tiered-1", "tiered", False, ""))) + ") AS t(provider, model, alias, deprecated, replacement)"
_RETIRED = "SELECT * FROM (VALUES\n" + ",\n".join(f"('{p}', 'base-2', 'base-2-latest', '2023-06-30', 'base-3')" for p in _FACTOR) + ") AS t(provider, model, alias, retired_date, replacement)"
_KEYS = """
SELECT DISTINCT concat('sk-iw-', lpad(CAST(c_custkey % 25 AS STRING), 10, '0')) AS key_id,
  CASE c_custkey % 25 % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gemini' END AS provider,
  CAST(c_custkey % 25 % 5 * 40 AS BIGINT) AS daily_limit_cents, CAST(c_custkey % 25 % 4 * 300 AS BIGINT) AS monthly_limit_cents,
  concat('owner-', CAST(c_custkey % 25 % 6 AS STRING), '@corp.test') AS owner_email,
  c_custkey % 25 % 2 = 0 AS personal, c_custkey % 25 % 7 <> 0 AS enabled,
  CASE c_custkey % 25 % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS redact_pii
FROM customer
"""
#: Limits by scope and window; 0 is none.
_LIMITS = """
SELECT * FROM (VALUES ('global', 'minute', CAST(3 AS BIGINT), CAST(60000 AS BIGINT)), ('global', 'day', 300, 9000000),
 ('provider', 'minute', 2, 40000), ('provider', 'day', 120, 4000000), ('model', 'minute', 2, 40000), ('model', 'day', 60, 2000000),
 ('key', 'minute', 1, 30000), ('key', 'day', 14, 400000), ('user', 'minute', 1, 30000), ('user', 'day', 3, 80000)) AS t(kind, win, req_limit, tok_limit)
"""
SQL = {"usage": _USAGE, "pricing": _PRICING, "catalog": _CATALOG, "retired": _RETIRED, "keys": _KEYS, "limits": _LIMITS}

#: Prices and costs as oracle SQL: exact or alias, then the most similar name of the provider.
_PRICED = """
names AS (SELECT DISTINCT provider, model FROM usage),
canon AS (SELECT n.provider, n.model, coalesce(max(c.model), n.model) AS canonical FROM names n
  LEFT JOIN catalog c ON c.provider = n.provider AND (c.model = n.model OR c.alias = n.model) GROUP BY 1, 2),
listed AS (SELECT DISTINCT provider, model FROM pricing),
nearby AS (SELECT c.provider, c.model, p.model AS near, levenshtein(lower(c.canonical), lower(p.model)) AS d, greatest(length(c.canonical), length(p.model)) AS l
  FROM canon c JOIN listed p ON p.provider = c.provider
  WHERE NOT EXISTS (SELECT 1 FROM listed q WHERE q.provider = c.provider AND q.model = c.canonical)),
fuzzy AS (SELECT provider, model, near, d FROM (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY (l - d) * 1.0 / l DESC, near) AS rn FROM nearby WHERE 10 * (l - d) >= 7 * l) z WHERE rn = 1),
matched AS (SELECT c.provider, c.model, CASE WHEN p.model IS NOT NULL THEN c.canonical ELSE f.near END AS matched_model, f.near IS NOT NULL AS is_estimate
  FROM canon c LEFT JOIN listed p ON p.provider = c.provider AND p.model = c.canonical LEFT JOIN fuzzy f ON f.provider = c.provider AND f.model = c.model),
tier AS (SELECT u.request_id, p.price_in, p.price_out, row_number() OVER (PARTITION BY u.request_id ORDER BY p.tier_no) AS rn
  FROM usage u JOIN matched m ON m.provider = u.provider AND m.model = u.model JOIN pricing p ON p.provider = m.provider AND p.model = m.matched_model
  WHERE p.threshold = 0 OR u.input_tokens <= p.threshold),
priced AS (SELECT u.*, m.matched_model, m.is_estimate, t.price_in, t.price_out FROM usage u JOIN matched m ON m.provider = u.provider AND m.model = u.model
  LEFT JOIN tier t ON t.request_id = u.request_id AND t.rn = 1),
cost AS (SELECT *, CAST(ceil(coalesce(input_tokens / 1e6 * price_in, 0) * 1e4) AS BIGINT) AS input_e4, CAST(ceil(coalesce(output_tokens / 1e6 * price_out, 0) * 1e4) AS BIGINT) AS output_e4,
  CAST(ceil(coalesce(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out, 0) * 1e4) AS BIGINT) AS total_e4 FROM priced)"""
PRELUDE = "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in SQL.items()) + "," + _PRICED


class Tables:
    """The derived tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self.customer = spark.read.parquet(f"{sf_dir}/customer.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SQL:
            raise AttributeError(name)
        return self.spark.sql(SQL[name].replace("FROM events", "FROM {events}").replace("FROM customer", "FROM {customer}"), events=self.events, customer=self.customer)
