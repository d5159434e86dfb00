"""Breakers of keys, providers and rollups: cases by hand, a plain loop, and streams against replays."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tollhouse.operators import breaker, failures
from tollhouse.plans import catalog
from tollhouse.plans.adapter import Tables
from tollhouse.plans.queries_limits import BREAKERS, outcomes
from tollhouse.streaming import jobs

START = dt.datetime(2024, 1, 1)
BASE = 1_704_067_200_000_000
SECOND = 1_000_000
SCHEMA = "request_id long, us long, provider string, model string, failure_class string, aborted boolean"


def attempts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("request_id", "timestamp_micros(us) AS ts", "provider", "model", "failure_class", "aborted").repartition(3)


def by_hand(spark, items, **options):
    """(state, action, key) of items (seconds, model, class or 'aborted') of one provider."""
    rows = [(i, BASE + int(s * SECOND), "p", m, "none" if c == "aborted" else c, c == "aborted") for i, (s, m, c) in enumerate(items)]
    found = breaker.breaker_replay(attempts(spark, rows), **options).orderBy("request_id").collect()
    return [(r.state_before, r.action, r.key) for r in found]


BAD, QUOTA, OK = "provider_degraded", "insufficient_quota", "none"


def test_quota_of_one_model_stops_all(spark):
    items = [(0, "m1", OK), (1, "m1", QUOTA), (2, "m2", OK), (301, "m1", OK), (302, "m3", "aborted"), (303, "m2", OK), (304, "m1", OK)]
    assert by_hand(spark, items) == [
        ("closed", "pass", "p:m1"), ("closed", "forced_open", "p"), ("open", "fast_fail", "p"), ("open", "fast_fail", "p"),
        ("half_open", "probe", "p"), ("half_open", "probe_closed", "p"), ("closed", "pass", "p:m1"),
    ]


def test_failed_probe_of_a_provider(spark):
    items = [(0, "m1", QUOTA), (301, "m2", QUOTA), (302, "m3", OK), (601, "m1", OK), (602, "m1", "localized_rate_limit"), (603, "m3", OK)]
    assert [a for _, a, _ in by_hand(spark, items)] == ["forced_open", "probe_reopened", "fast_fail", "fast_fail", "probe_reopened", "fast_fail"]


def test_own_probe_comes_before_the_provider_s(spark):
    """A half-open key probes itself although its provider waits too; its next request is the provider's probe."""
    items = [(0, "m", BAD), (1, "m", BAD), (2, "n", QUOTA), (303, "m", OK), (304, "m", OK), (305, "n", OK)]
    assert by_hand(spark, items, threshold=2)[3:] == [("half_open", "probe_closed", "p:m"), ("half_open", "probe_closed", "p"), ("closed", "pass", "p:n")]


def test_rollup_stops_closed_keys(spark):
    items = [(0, "a", BAD), (1, "b", BAD), (2, "c", OK), (302, "a", OK), (303, "c", OK), (304, "c", OK)]
    options = {"threshold": 1, "rollup_threshold": 2, "rollup_window_s": 400}
    assert by_hand(spark, items, **options) == [
        ("closed", "opened", "p:a"), ("closed", "opened", "p:b"), ("open", "fast_fail", "p:c"),
        ("half_open", "probe_closed", "p:a"), ("closed", "pass", "p:c"), ("closed", "pass", "p:c"),
    ]
    assert [a for _, a, _ in by_hand(spark, [(0, "a", BAD), (1, "b", BAD), (400, "c", OK), (401, "c", OK)], **options)][2:] == ["pass", "pass"]


def test_log_mode_ignores_quota(spark):
    items = [(0, "m", QUOTA), (1, "m", OK), (2, "m", BAD), (3, "m", OK), (400, "m", BAD), (401, "m", OK)]
    assert [a for _, a, _ in by_hand(spark, items, threshold=1, mode="log")] == ["pass", "pass", "opened", "would_fail", "pass", "pass"]


def looped(rows, threshold, window, cooldown, rollup, rollup_window, log):
    """Breakers in plain steps; rows are (id, microseconds, provider, model, class, aborted)."""
    keys, opened, out = defaultdict(lambda: ["closed", None, []]), defaultdict(dict), {}
    for i, us, p, m, c, aborted in sorted(rows, key=lambda r: (r[1], r[0])):

        def look(k):
            if keys[k][0] == "open" and us > keys[k][1]:  # noqa: B023
                keys[k][0] = "half_open"
            return keys[k]

        def opens(k):
            keys[k][:2] = ["open", us + cooldown]  # noqa: B023
            opened[p][k] = us  # noqa: B023
            return True

        key = f"{p}:{m}" if m else p
        own, by, action, turned = look(key), key, "pass", False
        state = own[0]
        rolled = rollup > 0 and sum(t > us - rollup_window for t in opened[p].values()) >= rollup
        if log:
            if state == "open" or rolled:
                action = "would_fail"
        else:
            if state == "closed" and key != p and look(p)[0] != "closed":
                state, by = look(p)[0], p
            if state == "closed" and rolled:
                state = "open"
            if state == "open":
                action = "fast_fail"
            elif state == "half_open" and aborted:
                action = "probe"
            elif state == "half_open" and c == "none":
                keys[by], action = ["closed", None, []], "probe_closed"
                opened[p].pop(by, None)
            elif state == "half_open":
                action, turned = "probe_reopened", opens(by)
        if (log or state == "closed") and action in ("pass", "would_fail") and not aborted:
            if c == "provider_degraded":
                own[2] = [t for t in own[2] if t > us - window] + [us]
                if len(own[2]) >= threshold and own[0] == "closed":
                    turned = opens(key)
                    action = "opened" if action == "pass" else action
            elif c == "insufficient_quota" and not log:
                whole = keys[p]
                whole[2] = [t for t in whole[2] if t > us - window] + [us]
                whole[:2] = ["open", us + cooldown]
                action, by, turned = "forced_open", p, True
        out[i] = (state, action, by, turned)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("mode, rollup", [("enforce", 0), ("enforce", 2), ("log", 2)])
def test_replay_against_a_loop(spark, seed, mode, rollup):
    """Few and many failures, providers without quotas, keys without models, repeated times, nulls; buckets shorter than cooldowns."""
    dice = random.Random(seed)
    share, span, rows = (0.02, 0.1, 0.4)[seed], dice.choice([4000, 20_000]), []
    for i in range(2500):
        p, m = dice.choice(["a", "b", "", "c"]), dice.choice(["m1", "m2", "m3", "m4", "m5", ""])
        c = dice.choices(["none", "provider_degraded", "insufficient_quota", "localized_rate_limit"], [1 - share, share * 0.8, share * 0.1 * (p in "ac"), share * 0.1])[0]
        rows.append((i, BASE + dice.randrange(span) * SECOND + dice.choice([0, 0, 500_000]), p, m, c, dice.random() < 0.1))
    given = [(i, us, p or dice.choice(["", None]), m or dice.choice(["", None]), c if c != "none" else dice.choice(["none", None]), a or dice.choice([False, None])) for i, us, p, m, c, a in rows]
    found = breaker.breaker_replay(attempts(spark, given), 3, 120, 200, mode, rollup, 300, bucket_s=150).collect()
    wanted = looped(rows, 3, 120 * SECOND, 200 * SECOND, rollup, 300 * SECOND, mode == "log")
    assert {r.request_id: (r.state_before, r.action, r.key, r.opens) for r in found} == wanted and len(found) == len(rows)


def test_no_attempts(spark):
    assert breaker.breaker_replay(attempts(spark, [])).count() == 0


def test_registered_queries_against_a_loop(spark, sf):
    rows = failures.classify_failure(outcomes(Tables(spark, sf))).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).collect()
    o = {k: v * SECOND if k.endswith("_s") else v for k, v in BREAKERS.items()}
    run = lambda log: looped([(r.request_id, r.us, r.provider, r.model, r.failure_class, r.aborted) for r in rows], o["threshold"], o["window_s"], o["cooldown_s"], o["rollup_threshold"], o["rollup_window_s"], log)
    wanted, watched = run(False), run(True)
    assert {"opened", "forced_open", "fast_fail", "probe_closed", "probe_reopened"} <= {a for _, a, *_ in wanted.values()}
    assert {r.request_id: (r.state_before, r.action, r.key, r.opens) for r in catalog.QUERIES["breaker_replay"](spark, sf).collect()} == wanted
    assert {r.request_id: (r.key, r.kind) for r in catalog.QUERIES["breaker_events"](spark, sf).collect()} == {i: (k, a) for i, (_, a, k, _) in wanted.items() if a != "pass"}
    day = {r.request_id: r.ts.date() for r in rows}
    blocked = Counter((day[i], k) for i, (_, a, k, _) in wanted.items() if a == "fast_fail")
    assert {(r.day, r.key): r.blocked for r in catalog.QUERIES["circuit_blocked_daily"](spark, sf).collect()} == blocked
    activity = catalog.QUERIES["circuit_activity_daily"](spark, sf).filter("provider = ''").collect()
    names = {"blocked_open": ("fast_fail",), "probes_started": ("probe", "probe_closed", "probe_reopened"), "circuits_opened": ("opened", "forced_open")}
    for name, actions in names.items():
        assert {r.day: r[name] for r in activity if r[name]} == Counter(day[i] for i, (_, a, *_) in wanted.items() if a in actions)
    last = sorted({*day.values()})[-7:]
    assert catalog.QUERIES["range_circuit_activity"](spark, sf).first().blocked_open == sum(n for (d, _), n in blocked.items() if d in last)
    would = Counter((day[i], k) for i, (_, a, k, _) in watched.items() if a == "would_fail")
    assert {(r.day, r.key): r.would_have_fast_failed for r in catalog.QUERIES["log_mode_counterfactual"](spark, sf).collect()} == would and would


@pytest.mark.parametrize("name, batch, columns", [
    ("stream_breaker", "breaker_replay", ["request_id", "state_before", "action", "key", "opens"]),
    ("stream_rate_limit", "rate_limit_replay", ["request_id", "allowed", "metric", "win"]),
    ("stream_provider_rollup", "provider_rollup_open", ["request_id", "open", "count"]),
])
def test_streams_equal_replays_with_files_dealt_at_random(spark, sf, name, batch, columns):
    rows = lambda q: sorted(tuple(r[c] for c in columns) for r in catalog.QUERIES[q](spark, sf).collect())
    assert rows(name) == rows(batch)


def test_streamed_rows_wait_for_earlier_ones(spark, tmp_path):
    """Files in three batches: an earlier failure of the second opens the breaker before a request of the first."""
    schema = "request_id long, ts timestamp, provider string, model string, failure_class string, aborted boolean"
    items = [[(3, 20, OK), (1, 0, BAD)], [(2, 10, BAD), (4, 30, OK)], [(None, 5000, OK)], [(None, 5001, OK)]]
    for part in items:
        spark.createDataFrame([(i, START + dt.timedelta(seconds=s), "p", "m", c, False) for i, s, c in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = jobs.stream_breaker(source, threshold=2)
    out.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").orderBy("request_id").collect()
    assert [(r.request_id, r.action) for r in found] == [(1, "pass"), (2, "opened"), (3, "fast_fail"), (4, "fast_fail")]
