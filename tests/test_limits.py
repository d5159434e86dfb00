"""Limits of all scopes together and caps with reservations, against plain loops."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tollhouse.operators import limits
from tollhouse.plans import catalog
from tollhouse.plans.adapter import Tables
from tollhouse.plans.queries_cost import costed
from tollhouse.plans.queries_limits import _DONE, _overrides

KINDS = (("provider", "provider"), ("model", "model"), ("key", "key_id"), ("user", "user_id"))


def admitted_in_order(rows, limit_of):
    """One pass over all requests; ``limit_of`` gives (requests, tokens) of a scope and window."""
    used, out = defaultdict(lambda: [0, 0]), {}
    for r in sorted(rows, key=lambda r: (r.ts, r.request_id)):
        names = ["global"] + [f"{k}:{r[c]}" for k, c in KINDS if r[c]]
        tokens = (r.input_tokens or 0) + (r.output_tokens or 0)
        windows = [(n, w, used[n, w, r.ts.strftime(f)]) for n in names for w, f in (("minute", "%Y%m%d%H%M"), ("day", "%Y%m%d"))]
        verdict = (True, "", "", "")
        for n, w, c in windows:
            most = limit_of(n, w)
            metric = "requests" if 0 < most[0] < c[0] + 1 else "tokens" if 0 < most[1] < c[1] + tokens and c[1] else ""
            if metric:
                verdict = (False, n, metric, w)
                break
        else:
            for *_, c in windows:
                c[0] += 1
                c[1] += tokens
        out[r.request_id] = verdict
    return out


def test_admission_query_against_one_pass(spark, sf):
    t = Tables(spark, sf)
    base = {(r.kind, r.win): (r.req_limit, r.tok_limit) for r in t.limits.collect()}
    own = {(r.scope_key, r.win): r.req_limit for r in _overrides(t).collect()}
    wanted = admitted_in_order(t.usage.collect(), lambda n, w: (own.get((n, w), base[n.split(":")[0], w][0]), base[n.split(":")[0], w][1]))
    found = {r.request_id: (r.allowed, r.scope_key, r.metric, r.win) for r in catalog.QUERIES["rate_limit_admission"](spark, sf).collect()}
    assert found == wanted and 0 < sum(v[0] for v in wanted.values()) < len(wanted)
    assert sum(r.blocked for r in catalog.QUERIES["ratelimit_daily"](spark, sf).filter("by = ''").collect()) == sum(not v[0] for v in wanted.values())


def test_scopes_are_charged_together_or_not_at_all(spark):
    """What one scope denies is charged to none; large requests are denied and small ones after them admitted."""
    start = dt.datetime(2024, 1, 1, 23, 58)
    items = [(i, start + dt.timedelta(seconds=7 * i), "p" if i % 5 else None, f"m{i % 2}", f"k{i % 3}", "" if i % 4 else "u", 50 if i % 6 else 900, None if i % 7 else 10) for i in range(60)]
    df = spark.createDataFrame(items, "request_id long, ts timestamp, provider string, model string, key_id string, user_id string, input_tokens long, output_tokens long")
    base = {("global", "minute"): (6, 700), ("provider", "minute"): (4, 0), ("model", "minute"): (0, 300), ("key", "day"): (9, 600), ("user", "day"): (3, 0)}
    table = spark.createDataFrame([(*k, *v) for k, v in base.items()], "kind string, win string, req_limit long, tok_limit long")
    over = spark.createDataFrame([("key:k1", "day", 4, 0)], "scope_key string, win string, req_limit long, tok_limit long")
    wanted = admitted_in_order(df.collect(), lambda n, w: (4 if (n, w) == ("key:k1", "day") else base.get((n.split(":")[0], w), (0, 0))[0], base.get((n.split(":")[0], w), (0, 0))[1]))
    for unit in (60, 3600):
        found = {r.request_id: (r.allowed, r.scope_key, r.metric, r.win) for r in limits.rate_limit_admission(df, table, over, unit_s=unit).collect()}
        assert found == wanted
    assert {v[3] for v in wanted.values()} == {"", "minute", "day"} and len({v[1].split(":")[0] for v in wanted.values()}) >= 4
    assert limits.rate_limit_admission(df.limit(0), table, over).count() == 0
    with pytest.raises(ValueError, match="whole minutes"):
        limits.rate_limit_admission(df, table, over, unit_s=90)


def reserved_in_order(rows, caps, grace):
    """Reservations with the day and month of each moment, step by step."""
    out, grace = {}, dt.timedelta(seconds=grace)
    for key in {r.key_id for r in rows}:
        booked, reserved, due = defaultdict(int), defaultdict(int), []
        daily, monthly = caps.get(key, (0, 0))
        periods = lambda t: (("d", t.date(), daily), ("m", (t.year, t.month), monthly))
        for r in sorted((r for r in rows if r.key_id == key), key=lambda r: (r.ts, r.request_id)):
            for when, _, cost, change in sorted(d for d in due if d[0] <= r.ts):
                for k, p, cap in periods(when):
                    booked[k, p] += cost
                    if cap > 0:
                        reserved[k, p] = max(0, reserved[k, p] + change)
            due = [d for d in due if d[0] > r.ts]
            now, reason, est = periods(r.ts), "", max(0, r.est_e4)
            before = tuple(reserved[k, p] for k, p, _ in now)
            for (k, p, cap), name in zip(now, ("daily", "monthly"), strict=True):
                held = booked[k, p] + (reserved[k, p] if est else 0)
                if not reason and cap > 0 and -(-held // 100) >= cap:
                    reason = name
            if not reason:
                for k, p, cap in now:
                    if cap > 0:
                        reserved[k, p] += est
                if r.done_ts is not None:
                    due += [(r.done_ts, r.request_id, r.total_e4, r.total_e4 - est if est else 0), (r.done_ts + grace, r.request_id, 0, -r.total_e4 if est else 0)]
            out[r.request_id] = (not reason, reason, *before)
    return out


def test_reservation_query_against_a_loop(spark, sf):
    t = Tables(spark, sf)
    rows = costed(t).select("request_id", "key_id", "ts", "total_e4", (F.col("total_e4") + F.col("request_id") % 7 * 40 - 40).alias("est_e4"), F.expr(_DONE).alias("done_ts")).collect()
    wanted = reserved_in_order(rows, {r.key_id: (r.daily_limit_cents, r.monthly_limit_cents) for r in t.keys.collect()}, 30)
    found = {r.request_id: (r.allowed, r.reason, r.day_reserved_e4, r.month_reserved_e4) for r in catalog.QUERIES["spend_cap_reservation"](spark, sf).collect()}
    assert found == wanted


def test_reservations_across_midnight_and_months(spark):
    """Made at 23:59 and settled after midnight; undone by the month; months that begin settled and unsettled."""
    schema = "request_id long, key_id string, ts timestamp, est_e4 long, total_e4 long, done_ts timestamp"
    at = lambda day, h, m, s=0, month=1: dt.datetime(2024, month, day, h, m, s)
    items = []
    for month in (1, 2, 3):
        for day in (1, 30 if month != 2 else 29, 31 if month != 2 else 28):
            for n, (h, m, wait) in enumerate([(0, 0, 20), (12, 0, 3), (12, 0, 90), (23, 59, 70), (23, 59, 4000)]):
                for key in ("a", "b", None):
                    begin = at(day, h, m, 7 * n, month)
                    items.append((len(items), key, begin, 300 + 50 * n if n != 1 else 0, 250 + 90 * n, begin + dt.timedelta(seconds=wait) if (day, n) != (30, 2) else None))
    df = spark.createDataFrame(items, schema).repartition(4)
    caps = {"a": (9, 20), "b": (0, 13), "c": (1, 1)}
    keys = spark.createDataFrame([(k, *v) for k, v in caps.items()], "key_id string, daily_limit_cents long, monthly_limit_cents long")
    wanted = reserved_in_order(df.collect(), caps, 30)
    found = {r.request_id: (r.allowed, r.reason, r.day_reserved_e4, r.month_reserved_e4) for r in limits.spend_cap_reservation(df, keys).collect()}
    assert found == wanted and {v[1] for v in wanted.values()} == {"", "daily", "monthly"}
