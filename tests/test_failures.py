"""Failure classes and kinds, breakers, rollups, spend caps and usage by shape: cases by hand and plain loops."""

import datetime as dt
import json
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tollhouse.operators import failures, limits, parsing
from tollhouse.plans.adapter import Tables

START = dt.datetime(2024, 1, 1)
QUOTA = '{"error":{"code":"insufficient_quota","message":"billing"}}'
CASES = [
    # provider, status, body, remaining requests, remaining tokens, retry after, transport error, class, kind
    ("openai", 200, None, None, None, None, None, "none", ""),
    ("openai", 429, None, "0", "5", None, None, "localized_rate_limit", "http_429_local"),
    ("openai", 429, None, "0", " 0 ", None, None, "global_rate_limit", "http_429_global"),
    ("openai", 429, None, "4", "5", "60", None, "global_rate_limit", "http_429_global"),
    ("openai", 429, None, "4", "5", "59", None, "localized_rate_limit", "http_429_local"),
    ("openai", 429, None, None, None, None, None, "global_rate_limit", "http_429_global"),
    ("openai", 429, QUOTA, "4", "5", None, None, "insufficient_quota", "openai_insufficient_quota"),
    ("openai", 429, QUOTA.replace("billing", "x" * 600), "4", "5", None, None, "localized_rate_limit", "http_429_local"),
    ("openai", 400, QUOTA, None, None, None, None, "none", "http_4xx"),
    ("anthropic", 429, QUOTA, None, None, None, None, "localized_rate_limit", "http_429_local"),
    ("anthropic", 429, '{"error":{"type":"rate_limit_error"}}', "0", "0", None, None, "global_rate_limit", "anthropic_rate_limit"),
    ("anthropic", 529, None, None, None, None, None, "provider_degraded", "anthropic_overloaded"),
    ("anthropic", 529, '{"error":{"type":"other"}}', None, None, None, None, "provider_degraded", "http_overloaded"),
    ("anthropic", 413, '{"error":{"type":"request_too_large"}}', None, None, None, None, "none", "anthropic_request_too_large"),
    ("gemini", 429, '{"error":{"status":"RESOURCE_EXHAUSTED","message":"Quota spent"}}', None, None, None, None, "global_rate_limit", "gemini_resource_exhausted"),
    ("gemini", 429, '{"error":{"status":"RESOURCE_EXHAUSTED","message":"slow"}}', "0", "0", None, None, "localized_rate_limit", "gemini_resource_exhausted"),
    ("gemini", 503, '{"error":{"status":"UNAVAILABLE"}}', None, None, None, None, "provider_degraded", "gemini_unavailable"),
    ("other", 429, None, "0", "0", None, None, "none", "http_429_local"),
    ("other", 501, "not json", None, None, None, None, "provider_degraded", "http_5xx_other"),
    ("openai", 408, None, None, None, None, None, "none", "http_4xx"),
    ("openai", 401, QUOTA, None, None, None, None, "none", "http_4xx"),
    ("openai", None, None, None, None, None, None, "provider_degraded", "nil_response"),
    ("openai", None, None, None, None, None, "context canceled", "none", "client_canceled"),
    ("openai", None, None, None, None, None, "Post x: EOF", "provider_degraded", "eof"),
    ("openai", None, None, None, None, None, "unexpected EOF", "provider_degraded", "unexpected_eof"),
    ("openai", None, None, None, None, None, "read tcp a: connection reset by peer", "provider_degraded", "connection_reset"),
    ("openai", None, None, None, None, None, "write tcp a: broken pipe", "provider_degraded", "network_other"),
    ("openai", None, None, None, None, None, "dial tcp a: i/o timeout", "provider_degraded", "io_timeout"),
    ("openai", None, None, None, None, None, "odd", "provider_degraded", "unknown_transport"),
]


def test_classes_and_kinds(spark):
    fields = "provider string, status int, error_body string, remaining_requests string, remaining_tokens string, retry_after string, transport_error string, want_class string, want_kind string"
    df = spark.createDataFrame(CASES, fields).withColumn("ts", F.lit(START))
    got = failures.failure_kind(failures.classify_failure(df)).collect()
    assert [(r.failure_class, r.failure_kind) for r in got] == [c[-2:] for c in CASES]


def test_month_blocks_before_the_day(spark):
    cost = spark.createDataFrame([(i, START + dt.timedelta(minutes=i), "k", 100) for i in range(14)], "request_id long, ts timestamp, key_id string, total_e4 long").withColumn("day", F.to_date("ts"))
    keys = spark.createDataFrame([("k", 10, 5)], "key_id string, daily_limit_cents long, monthly_limit_cents long")
    assert [r.reason for r in limits.spend_cap_replay(cost, keys).orderBy("request_id").collect()] == [""] * 5 + ["monthly"] * 9


def test_recovered_keys_leave_the_rollup(spark):
    events = [(0, "a", "opened"), (10, "b", "opened"), (20, "a", "probe_closed"), (30, "c", "opened"), (40, "c", "probe_reopened"), (309, "d", "opened"), (310, "e", "opened"), (340, "e", "probe_reopened")]
    df = spark.createDataFrame([(i, START + dt.timedelta(seconds=s), "p", k, kind) for i, (s, k, kind) in enumerate(events)], "request_id long, ts timestamp, provider string, key string, kind string")
    got = {r.request_id: (r["count"], r.open) for r in failures.provider_rollup_open(df, 2, 300).collect()}
    assert got == {0: (1, False), 1: (2, True), 3: (2, True), 4: (2, True), 5: (3, True), 6: (3, True), 7: (2, True)}


def test_rate_limits_by_reason(spark, sf):
    t = Tables(spark, sf)
    decided = limits.rate_limit_replay(t.usage, "key_id", 1, 30_000, 3, 60_000).join(t.usage.select("request_id", "day", "provider"), "request_id")
    rows = decided.collect()
    got = {(r.day, r.by, r.member): (r.total, r.allowed, r.blocked) for r in limits.rate_limit_daily(decided).collect()}
    wanted = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        whole = wanted[r.day, "", ""]
        whole[0] += 1
        whole[1 if r.allowed else 2] += 1
        if not r.allowed:
            wanted[r.day, "provider", r.provider][2] += 1
            wanted[r.day, "reason", f"{r.metric} per {r.win}"][2] += 1
    assert got == {k: tuple(v) for k, v in wanted.items()} and any(k[1] == "reason" for k in got)


def _stream(*events):
    return "".join(f"data: {e if isinstance(e, str) else json.dumps(e)}\n\n" for e in events)


USAGE = {"input_tokens": 7, "output_tokens": 3, "total_tokens": 10}
BODIES = [
    ("openai", True, _stream({"type": "response.created", "response": {"id": "r", "model": "m"}}, {"type": "response.completed", "response": {"usage": USAGE}}), ("m", 7, 3)),
    ("openai", True, _stream({"type": "response.done", "event": {"id": "r", "model": "m", "usage": USAGE}}), ("m", 7, 3)),
    ("openai", True, _stream({"type": "response.created", "response": {"id": "r", "model": "m"}}), ("m", 0, 0)),
    ("gemini", True, _stream({"object": "chat.completion.chunk", "model": "m", "choices": []}, {"model": "m", "choices": [], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}, "[DONE]"), ("m", 7, 3)),
    ("bedrock", True, _stream({"messageStop": {"stopReason": "end_turn"}}, {"metadata": {"usage": {"inputTokens": 7, "outputTokens": 3}}}), ("", 7, 3)),
    ("bedrock", False, json.dumps({"output": {"message": {}}, "stopReason": "x", "usage": {"inputTokens": 7, "outputTokens": 3}}), ("", 7, 3)),
    ("anthropic", False, json.dumps({"choices": [], "model": "m", "usage": {"prompt_tokens": 7, "completion_tokens": 3}}), ("m", 7, 3)),
    ("openai", False, "", None),
    ("openai", False, "[1, 2", None),
    ("openai", True, "data: hello\n\n", None),
    ("openai", None, "{}", None),
    ("openai", None, json.dumps({"choices": [], "model": "m", "usage": {"prompt_tokens": 7, "completion_tokens": 3}}), ("m", 7, 3)),
    ("openai", None, _stream({"model": "m", "choices": []}, {"model": "m", "choices": [], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}, "[DONE]"), ("m", 7, 3)),
    ("openai", True, json.dumps({"choices": [], "model": "m", "usage": {"prompt_tokens": 7, "completion_tokens": 3}}), ("m", 7, 3)),
    ("anthropic", True, "\n " + json.dumps({"model": "m", "usage": USAGE}), ("m", 7, 3)),
    ("openai", True, json.dumps({"error": {"message": "no"}}), None),
    ("openai", None, None, None),
    # A text of that name in one event hides no other; nothing counts behind the end; a broken line is passed over.
    ("openai", True, _stream({"type": "response.output_text.delta", "delta": 'say "usage"'}, {"type": "response.completed", "response": {"model": "m", "usage": USAGE}}), ("m", 7, 3)),
    ("anthropic", True, _stream({"type": "message_start", "message": {"model": "m", "usage": {"input_tokens": 7, "output_tokens": 1}}}, {"type": "error", "message": "text"}, {"type": "message_delta", "usage": {"output_tokens": 3}}), ("m", 7, 3)),
    ("openai", True, _stream({"model": "m", "choices": [], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}, "[DONE] ", {"model": "m", "choices": [], "usage": {"prompt_tokens": 9}}).replace("\n", "\r\n"), ("m", 7, 3)),
    ("openai", True, _stream('{broken "usage', {"model": "m", "choices": [], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}), ("m", 7, 3)),
]


def test_usage_by_shape(spark):
    df = spark.createDataFrame([(i, p, s, b) for i, (p, s, b, _) in enumerate(BODIES)], "request_id long, provider string, is_streaming boolean, response_body string")
    got = sorted(parsing.parse_usage(df).collect())
    assert [None if r.parse_error else (r.usage_model, r.usage_input_tokens, r.usage_output_tokens) for r in got] == [b[-1] for b in BODIES]


@pytest.mark.parametrize("module", ["tollhouse.plans.queries_cost", "tollhouse.plans.queries_stream", "tollhouse.plans.registry"])
def test_modules_import_alone(module):
    subprocess.run([sys.executable, "-c", f"import {module}"], check=True)
