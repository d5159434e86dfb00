"""Golden cases of the operators and of their helpers."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tollhouse.functions import ids, pii
from tollhouse.operators import breaker, failures, joins, limits, pricing, redact, rollups


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fuzzy(spark):
    listed = spark.createDataFrame([("openai", "gpt-4"), ("openai", "gpt-3.5-turbo")], "provider string, model string")
    asked = spark.createDataFrame([("openai", "gpt4"), ("openai", "gpt-3.5-turbo-16k"), ("openai", "completely-different-model"), ("nobody", "gpt-4")], "provider string, model string")
    assert rows(pricing.fuzzy_model_match(asked, listed), "model", "matched_model") == [("gpt-3.5-turbo-16k", "gpt-3.5-turbo"), ("gpt4", "gpt-4")]


def test_round_up_and_tiers(spark):
    usage = spark.createDataFrame([(1_000_000, 0, 0.123456789, 0.0)], "input_tokens long, output_tokens long, price_in double, price_out double")
    assert pricing.request_cost(usage).first().total_e4 == 1235
    tiers = spark.createDataFrame([("p", "m", 0, 100, 1.0, 2.0), ("p", "m", 1, 0, 10.0, 20.0)], "provider string, model string, tier_no int, threshold long, price_in double, price_out double")
    asked = spark.createDataFrame([("p", "m", 50), ("p", "m", 1000), ("p", "x", 5)], "provider string, model string, input_tokens long")
    assert sorted(((r.input_tokens, r.price_in) for r in pricing.price_tiered(asked, tiers).collect()), key=str) == [(1000, 10.0), (5, None), (50, 1.0)]
    assert {r.input_tokens: r.price_in for r in pricing.price_tiered_desc(asked, tiers).collect()}[50] == 1.0


def test_top_n(spark):
    df = spark.createDataFrame([("d", n, v) for n, v in (("high", 100), ("mid", 50), ("low", 10), ("tiny", 1), ("smidge", 1))], "day string, member string, v long")
    assert rows(rollups.topn_with_other(df, ["day"], "v", "member", 2, "key"), "member", "v") == [("high", 100), ("mid", 50), ("other_key", 12)]
    assert rollups.topn_with_other(df, ["day"], "v", "member", 0, "key").count() == 5


def test_circuit_peak(spark):
    t = [dt.datetime(2024, 1, 1, 0, i) for i in range(3)]
    snaps = spark.createDataFrame([(1, t[0], "p", 3, False, "closed"), (2, t[1], "p", 7, True, "open"), (3, t[2], "p", 2, False, "closed")], "request_id long, ts timestamp, provider string, failures int, rollup_open boolean, state string").withColumn("day", F.to_date("ts"))
    r = rollups.circuit_peaks(snaps, ["day"]).first()
    assert (r.failures, r.rollup_open, r.state) == (7, True, "closed")


def _traffic(spark, items):
    start = dt.datetime(2024, 1, 1, 12, 0, 5)
    return spark.createDataFrame([(i, start + dt.timedelta(seconds=s), "k", tokens, 0) for i, (s, tokens) in enumerate(items)], "request_id long, ts timestamp, key_id string, input_tokens long, output_tokens long").withColumn("day", F.to_date("ts"))


def test_rate_limits(spark):
    asked = _traffic(spark, [(0, 1), (1, 1), (2, 1), (60, 1)])
    got = limits.rate_limit_replay(asked, "key_id", 2, 0, 0, 0)
    assert rows(got, "request_id", "allowed") == [(0, True), (1, True), (2, False), (3, True)]
    tokens = limits.rate_limit_replay(_traffic(spark, [(0, 60), (1, 50), (2, 40)]), "key_id", 0, 100, 0, 0)
    assert rows(tokens, "request_id", "allowed", "metric") == [(0, True, ""), (1, False, "tokens"), (2, True, "")]
    first = limits.rate_limit_replay(_traffic(spark, [(0, 500)]), "key_id", 0, 100, 0, 0)
    assert first.first().allowed
    assert not limits.rate_limit_replay(_traffic(spark, [(0, 500)]), "key_id", 0, 100, 0, 0, first_free=False).first().allowed
    # The window form agrees with the replay where only requests are limited.
    many = _traffic(spark, [(7 * i, 1) for i in range(60)])
    assert rows(limits.rate_limit_replay_requests(many, "key_id", 3, 10), "request_id", "allowed") == rows(limits.rate_limit_replay(many, "key_id", 3, 0, 10, 0), "request_id", "allowed")


def _attempts(spark, items):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + dt.timedelta(seconds=s), "p", "m", c, False) for i, (s, c) in enumerate(items)], "request_id long, ts timestamp, provider string, model string, failure_class string, aborted boolean")


def test_breaker(spark):
    bad, good = "provider_degraded", "none"
    got = breaker.breaker_replay(_attempts(spark, [(0, bad), (1, bad), (2, bad), (3, good), (302, good), (303, bad), (304, good)]), 3, 120, 300)
    assert [r.action for r in sorted(got.collect())] == ["pass", "pass", "opened", "fast_fail", "fast_fail", "probe_reopened", "fast_fail"]
    slid = breaker.breaker_replay(_attempts(spark, [(0, bad), (100, bad), (120, bad), (121, bad)]), 3, 120, 300)
    assert [r.action for r in sorted(slid.collect())] == ["pass", "pass", "pass", "opened"]
    calm = breaker.breaker_replay(_attempts(spark, [(0, bad), (1, good)]), 3)
    assert rows(calm, "request_id", "action") == [(0, "pass"), (1, "pass")]


def test_spend_caps(spark):
    cost = _traffic(spark, [(i, 1) for i in range(5)]).withColumn("total_e4", F.lit(150).cast("long"))
    keys = spark.createDataFrame([("k", 3, 0)], "key_id string, daily_limit_cents long, monthly_limit_cents long")
    assert [r.reason for r in limits.spend_cap_replay(cost, keys).orderBy("request_id").collect()] == ["", "", "daily", "daily", "daily"]


def test_masks(spark):
    df = spark.createDataFrame([("short",), ("sk-iw-0000000001",)], "k string").withColumn("m", ids.mask_key_id(F.col("k")))
    got = dict(df.collect())
    h = 2166136261
    for b in b"sk-iw-0000000001":
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    assert got == {"short": "short", "sk-iw-0000000001": f"sk-iw-000000…{h:08x}"}


@pytest.mark.parametrize(
    ("value", "kind", "reason"),
    [("Johnson", "PERSON", "single_token_person"), ("Massachusetts", "LOCATION", "non_street_location"), ("127.0.0.1", "IP_ADDRESS", "private_ip"), ("10.0.0.5", "IP_ADDRESS", "private_ip"), ("fd12:3456::1", "IP_ADDRESS", "private_ip"), ("alice@example.com", "EMAIL_ADDRESS", "test_email"), ("8.8.8.8", "IP_ADDRESS", ""), ("123 Main St", "LOCATION", ""), ("real.user@gmail.com", "EMAIL_ADDRESS", "")],
)
def test_allowed(spark, value, kind, reason):
    assert pii.allow_reason(value, kind) == reason
    row = spark.createDataFrame([(value, (0, len(value), kind, 1.0))], "value string, span struct<start:int,end:int,entity_type:string,score:double>")
    assert redact.allow_middle_ground(row).first().reason == reason


def test_overlaps_and_placeholders():
    text = "John Q 123-45-6789"
    spans = [{"start": 0, "end": 18, "entity_type": "PERSON", "score": 0.99}, {"start": 7, "end": 18, "entity_type": "US_SSN", "score": 0.85}]
    assert [s["entity_type"] for s in pii.resolve(spans)] == ["US_SSN"]
    registry = pii.Registry()
    assert pii.scrub("a@corp.test b@corp.test a@corp.test", registry) == "<PII_EMAIL_ADDRESS_1> <PII_EMAIL_ADDRESS_2> <PII_EMAIL_ADDRESS_1>"
    assert pii.scrub("ssn 123-45-6789", registry) == "ssn <PII_US_SSN_1>"
    back, n = pii.restore("to [ PII_EMAIL_ADDRESS_2 ] and \\u003cPII_EMAIL_ADDRESS_1\\u003e, <PII_US_SSN_1>", registry.rows())
    assert (back, n) == ("to b@corp.test and a@corp.test, <PII_US_SSN_1>", 2)
    assert pii.leaked("x {PII_EMAIL_ADDRESS_1}", registry.rows()) == 1


def test_checks():
    assert pii.luhn("4111 1111 1111 1111") and not pii.luhn("4111 1111 1111 1112")
    assert pii.iban("GB82 WEST 1234 5698 7654 32") and not pii.iban("GB82 WEST 1234 5698 7654 33")
    assert pii.policy("SOMETHING_NEW") == "REDACT"


def test_merge_snapshots(spark):
    a = spark.createDataFrame([("x", 1, 5)], "k string, n long, m long")
    b = spark.createDataFrame([("x", 3, 2), ("y", 1, 1)], "k string, n long, m long")
    assert rows(joins.merge_snapshots_max(a, b, ["k"], ["n", "m"]), "k", "n", "m") == [("x", 3, 5), ("y", 1, 1)]


def test_whole_texts_and_all_entities(spark, tmp_path):
    """Queries over whole texts against the row helpers and counts by hand."""
    from tollhouse.plans.catalog import QUERIES

    texts = {0: "mail a@corp.test or b@corp.test, ssn 123-45-6789", 1: "ssn 123-45-6789 card 4111 1111 1111 1111", 2: "passport no A12345678", 3: "driver licence D1234567", 5: "nothing", 6: None, 9: 'said "hi" to c@corp.test at 8.8.8.8'}
    texts[10] = texts[0]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, t in texts.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    # Scans of every seventh document fail here: nothing is found in them.
    wanted = Counter((i % 5, s["entity_type"]) for i, t in texts.items() if i % 7 for s in pii.threshold(pii.detect(t or ""), len(t or "")))
    assert wanted[0, "US_SSN"] == 1 and wanted[1, "CREDIT_CARD"] == 1 and wanted[4, "IP_ADDRESS"] == 1
    assert {(r.day.day - 1, r.name): r["count"] for r in run("pii_by_entity_all")} == wanted
    daily = {r.day.day - 1: r for r in run("pii_daily_all")}
    assert all(r.entities_total == sum(n for (d, _), n in wanted.items() if d == day) for day, r in daily.items())
    good = {d: r.requests_scanned - r.fail_open for d, r in daily.items()}
    assert run("range_detection_rate_all")[0].rate == sum(daily[d].requests_with_pii for d in (2, 3, 4)) / sum(good[d] for d in (2, 3, 4))
    assert {r.doc_id: json.loads(r.spans) if r.spans else [] for r in run("dedupe_analyze_all")} == {i: pii.detect(t or "") for i, t in texts.items()}
    assert {r.doc_id: (r.sealed, r.detected) for r in run("pii_tier_counts_all")}[10] == (1, 3)
    assert {r.doc_id: r.text for r in run("reformat_placeholders_all")}[2] == "passport no [ PII_US_PASSPORT_1 ]"
    assert {r.request_id: r.outcome for r in run("gov_id_gate_all")} == {0: "cleared", 1: "fail_open", 2: "blocked", 3: "blocked", 5: "cleared", 6: "cleared", 9: "cleared", 10: "fail_open"}
    assert sum(r.blocked for r in run("id_gate_daily_all")) == 2
    bodies = {r.conv_id: json.loads(r.scrubbed) for r in run("scrub_json_all")}
    for i, t in texts.items():
        assert bodies[i]["messages"][0]["content"] == pii.scrub(t or "", pii.Registry()) and bodies[i]["metadata"]["note"] == "a@corp.test"
    assert all((texts[r.conv_id] or "").replace('"', '\\"') in r.masked and "model" not in r.masked for r in run("mask_json_metadata_all"))
    assert {r.request_id // 1000: bytes(r.bytes).decode() for r in run("extract_images_all")} == {i: t * 40 for i, t in texts.items() if t}
    stripped = {r.conv_id: r for r in run("strip_images_all")}
    assert stripped[0].stripped == f"{texts[0]} __IMAGE__ end" and all(r.whole for r in stripped.values())


def test_token_stats_by_brute_force(spark):
    import math
    import random
    import statistics

    draw = random.Random(3)
    given = [(f"g{i % 3}", draw.choice([None, 1, 5, 5, 9, 1000, draw.randrange(50)]), draw.randrange(1, 9)) for i in range(400)] + [("one", 7, 2), ("none", None, 4)]
    df = spark.createDataFrame(given, "g string, tokens long, chars long").repartition(5)
    found = {r.g: r for r in pricing.token_stats(df, ["g"]).collect()}
    assert set(found) == {g for g, _, _ in given}
    for g, r in found.items():
        ranked = sorted((t for k, t, _ in given if k == g), key=lambda t: -1 if t is None else t)
        known = [t for t in ranked if t is not None]
        assert (r.p50, r.p95) == (ranked[len(ranked) // 2], ranked[math.ceil(0.95 * len(ranked)) - 1])
        if not known:
            assert (r["mean"], r.stdev, r.per_1k_chars) == (None, None, None)
            continue
        assert (r["mean"], r.stdev) == pytest.approx((statistics.fmean(known), statistics.pstdev(known)))
        assert r.per_1k_chars == pytest.approx(sum(known) * 1000 / sum(c for k, _, c in given if k == g))
    assert pricing.token_stats(df.limit(0), ["g"]).count() == 0


def test_collapse_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, 9, 1), ("a", 5, 2), ("b", 5, 3), ("c", 1, 4), ("d", None, 5)], "member string, v long, n long")
    found = rollups.topn_collapse_all_measures(df, "member", "v", ["v", "n"], 2)
    assert {tuple(r) for r in found.collect()} == {(None, 9, 1), ("a", 5, 2), ("(and 3 others)", 6, 12)}
    assert {tuple(r) for r in rollups.topn_collapse_all_measures(df, "member", "v", ["n"], 5).collect()} == {(m, n) for m, _, n in df.collect()}
    assert rollups.topn_collapse_all_measures(df.limit(0), "member", "v", ["v"], 2).count() == 0


def test_conversations_stream(spark):
    turns = [(c, t, f"from u{t % 3}@corp.test and x{c}@corp.test to u{t % 2}@corp.test") for c in (1, 2, None) for t in range(7)] + [(1, 7, None), (1, 8, ""), (1, 3, "again u9@corp.test")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn int, text string, registry string").repartition(4)
    got = redact.scrub_conversation(df, "conv_id", "turn", "text").collect()
    assert len(got) == len(turns)
    found = {(r.conv_id, r.turn, r.scrubbed): ({x.placeholder: x.original for x in r.registry}, r.originals) for r in got}
    for c in (1, 2, None):
        registry = pii.Registry()
        for _, t, text in sorted((x for x in turns if x[0] == c), key=lambda x: (x[1], x[2] or "")):
            scrubbed = None if text is None else pii.scrub(text, registry)
            own, originals = found[c, t, scrubbed]
            assert originals == len(registry.known)
            if text:
                assert own and pii.restore(scrubbed, [{"placeholder": p, "original": o, "policy": "MASK"} for p, o in own.items()])[0] == text
            else:
                assert not own


def test_dates_of_birth():
    found = [(s["start"], s["end"], round(s["score"], 6)) for s in pii.detect("born 01/02/1990, seen 2001-12-31, not 13/02/1990", ["DATE_OF_BIRTH"])]
    assert found == [(5, 15, 0.85), (22, 32, 0.85)]
