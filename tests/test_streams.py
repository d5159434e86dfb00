"""Archives, history chunks, rollups with late rows, request bodies by provider and the SQL surface."""

import datetime as dt
import gzip
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tollhouse.functions import ids, pii
from tollhouse.functions.surface import register_all
from tollhouse.operators import redact
from tollhouse.sources import history_source
from tollhouse.streaming import jobs

START = dt.datetime(2024, 1, 1)
DAYS = "metric string, day date, dim string, member string, " + ", ".join(f"{m} long" for m in jobs.MEASURES)


def days(spark, *items):
    return spark.createDataFrame([("cost", START.date() + dt.timedelta(days=d), "provider", p, n, n, n, n, n, n) for d, p, n in items], DAYS)


def archived(spark, path):
    return sorted((r.day.day, r.member, r.spend_e4) for r in jobs.read_archive(spark, path).collect())


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/archive"
    first, second = days(spark, (0, "a", 1), (0, "b", 2), (1, "a", 3)), days(spark, (2, "a", 4))
    jobs.archive_batch(first, 0, path, "w")
    jobs.archive_batch(second, 1, path, "w")
    wanted = [(1, "a", 1), (1, "b", 2), (2, "a", 3), (3, "a", 4)]
    assert archived(spark, path) == wanted
    jobs.archive_batch(second, 1, path, "w")
    jobs.archive_batch(first, 0, path, "w")
    assert archived(spark, path) == wanted and spark.read.parquet(f"{path}/ledger").count() == 3
    # It failed between data and ledger: the rows are there, the ledger does not know them.
    late = days(spark, (3, "a", 5), (3, "c", 6))
    jobs.archive_batch(late, 2, path, "w")
    for f in Path(path, "ledger").glob("part-*"):
        if spark.read.parquet(str(f)).filter("batch = 2").count():
            f.unlink()
    spark.catalog.refreshByPath(f"{path}/ledger")
    jobs.archive_batch(late, 2, path, "w")
    assert archived(spark, path) == [*wanted, (4, "a", 5), (4, "c", 6)]


def test_one_writer_archives_a_day(spark, tmp_path):
    path = f"{tmp_path}/archive"
    jobs.archive_batch(days(spark, (0, "a", 1)), 0, path, "w1")
    jobs.archive_batch(days(spark, (0, "a", 9), (1, "b", 2)), 0, path, "w2")
    assert archived(spark, path) == [(1, "a", 1), (2, "b", 2)]


COSTS = "request_id long, ts timestamp, provider string, model string, key_id string, user_id string, input_tokens long, output_tokens long, input_e4 long, output_e4 long, total_e4 long"


def test_late_rows_count_until_the_retention_is_over(spark, tmp_path):
    """An hour takes rows that are a day late, and no longer those that are two days late; a month takes them all."""
    hours = lambda *at: spark.createDataFrame([(i, START + dt.timedelta(hours=h), "p", "m", "k", "u", 1, 1, 1, 1, 2) for i, h in enumerate(at)], COSTS)
    for rows in (hours(0, 30), hours(6, 60), hours(0, 61)):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(COSTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for by, wanted in (("hour", {0: 1, 6: 1, 30: 1, 60: 1, 61: 1}), ("month", {0: 6})):
        seen = []
        job = jobs.stream_rollup(source, by, ["provider"]).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/{by}").trigger(availableNow=True)
        job.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).start().awaitTermination()  # noqa: B023
        last = {}
        for _, start, _, *values in sorted(seen):
            last[round((start - START).total_seconds() / 3600)] = values[3]
        assert last == wanted


ROW = "request_id long, ts timestamp, note string"


def test_history_chunks_are_bounded_committed_and_pruned(spark, tmp_path):
    base = f"{tmp_path}/history"
    rows = spark.range(500).select(F.col("id").alias("request_id"), (F.lit(START) + F.make_dt_interval(hours=F.col("id") % 50)).alias("ts"), F.when(F.col("id") == 7, F.repeat(F.lit("é"), 3000)).otherwise(F.lit("x")).alias("note"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ROW).parquet(f"{tmp_path}/in")
    sink = jobs.stream_history_sink(source, base, "usage", f"{tmp_path}/state", max_records=3, max_bytes=600, role="edge", instance="host-a-1")
    sink.trigger(availableNow=True).start().awaitTermination()
    chunks = list(Path(base).rglob("*.jsonl.gz"))
    sizes = [(len(lines := gzip.decompress(f.read_bytes()).splitlines()), sum(len(x) + 1 for x in lines)) for f in chunks]
    assert all(n <= 3 and (size <= 600 or n == 1) for n, size in sizes) and max(n for n, _ in sizes) == 3
    assert all(re.fullmatch(r"\d{8}T\d{6}\.000Z-edge-host-a-1-\d{6}-[0-9a-f]{8}\.jsonl\.gz", f.name) for f in chunks)
    assert not list(Path(base, "usage", "_staging").glob("*"))
    back = history_source.read_chunks(spark, base, "usage", ROW)
    assert {(r.role, r.instance) for r in back.collect()} == {("edge", "host-a-1")}
    assert sorted((r.request_id, r.ts, r.note) for r in back.collect()) == sorted((r.request_id, r.ts, r.note) for r in rows.collect())
    some = back.filter("dt = '2024-01-02' AND hour IN ('03', '04')")
    assert {r.request_id % 50 for r in some.collect()} == {27, 28}
    files = len(list(Path(base, "usage", "dt=2024-01-02").glob("hour=0[34]/*.gz")))
    assert some.rdd.getNumPartitions() == files < back.rdd.getNumPartitions() == len(chunks)
    # Filters that the source takes are not applied again above it.
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
    assert back.filter("role = 'other'").count() == 0
    assert history_source.read_chunks(spark, f"{base}/none", "usage", ROW).count() == 0


def test_a_batch_that_fails_leaves_no_chunk(spark, tmp_path):
    base = f"{tmp_path}/history"
    writer = history_source.HistoryWriter({"path": base})
    Path(base, "_staging").mkdir(parents=True)
    staged = Path(base, "_staging", "a")
    staged.write_bytes(gzip.compress(b"{}\n"))
    writer.abort([history_source.Written(0, [(str(staged), "2024-01-01", "00", 0)]), None], 3)
    assert not list(Path(base).rglob("*.gz")) and not staged.exists()
    for _ in range(2):
        staged.write_bytes(gzip.compress(b"{}\n"))
        writer.commit([history_source.Written(0, [(str(staged), "2024-01-01", "00", 0)])], 3)
    assert len(list(Path(base).rglob("*.gz"))) == 1


def test_history_sink_lists_its_streams(spark):
    assert jobs.stream_history_sink(spark.range(1).withColumn("ts", F.lit(START)), "x", "pii", "y", streams=("usage",)) is None
    with pytest.raises(ValueError, match="unknown stream"):
        history_source.chunk_rows(spark.range(1).withColumn("ts", F.lit(START)), "other")


MAIL = "a.person@corp.test"
HIDDEN = "<PII_EMAIL_ADDRESS_1>"
#: Bodies by provider, with MAIL where text of users stands and KEEP where the format holds none.
BODIES = [
    ("openai", {"model": "KEEP", "messages": [{"role": "KEEP", "content": MAIL}, {"content": [{"type": "text", "text": MAIL}], "tool_calls": [{"id": "KEEP", "function": {"name": "KEEP", "arguments": '{"a":"' + MAIL + '"}'}}]}], "system": "KEEP", "prompt": MAIL, "metadata": {"prompt": "KEEP"}}),
    ("openai", {"input": [MAIL, {"text": MAIL, "output": MAIL, "call_id": "KEEP"}], "tools": [{"name": "KEEP", "parameters": {"x": "KEEP"}}]}),
    ("openai", {"input": "x " + MAIL}),
    ("anthropic", {"system": MAIL, "messages": [{"role": "KEEP", "content": [{"text": MAIL}, {"tool_use": {"name": "KEEP", "input": {"who": MAIL, "to": [MAIL]}}}, {"input": {"who": "KEEP"}}]}], "prompt": "KEEP"}),
    ("anthropic", {"system": [{"type": "text", "text": MAIL}]}),
    ("gemini", {"contents": [{"role": "KEEP", "parts": [{"text": MAIL}, {"functionCall": {"name": "KEEP", "args": {"e": MAIL}}}, {"function_response": {"response": {"e": [MAIL]}}}]}], "content": "KEEP", "system": "KEEP"}),
    ("bedrock", {"modelId": "KEEP", "system": [{"text": MAIL}], "messages": [{"content": [{"toolUse": {"input": {"q": MAIL}}}, {"toolResult": {"content": [{"json": {"e": MAIL}}, {"text": MAIL}]}}]}], "text": "KEEP"}),
    ("bedrock-mantle", {"system": MAIL, "messages": [{"content": MAIL}]}),
    (None, {"system": MAIL, "contents": [{"parts": [{"text": MAIL}]}], "note": "KEEP"}),
]


def test_bodies_are_scrubbed_by_provider(spark):
    kept = "stays.here@corp.test"
    given = [(p, json.dumps(b).replace("KEEP", kept)) for p, b in BODIES]
    wanted = [json.loads(json.dumps(b).replace("KEEP", kept).replace(MAIL, HIDDEN)) for _, b in BODIES]
    odd = [("openai", None), ("openai", f"no json {MAIL}"), (None, json.dumps(MAIL)), ("gemini", "[]"), ("openai", ""), ("openai", json.dumps({"input": ["A" * 2000, MAIL]}))]
    df = spark.createDataFrame([(i, p, b, "s") for i, (p, b) in enumerate(given * 2 + odd)], "id long, provider string, body string, scrubbed string").repartition(3)
    found = {r.id: r for r in redact.scrub_json(df, "body", "provider").collect()}
    assert len(found) == len(given) * 2 + len(odd)
    for i in range(len(given) * 2):
        assert json.loads(found[i].scrubbed) == wanted[i % len(given)]
        assert [(r.placeholder, r.original) for r in found[i].registry] == [(HIDDEN, MAIL)]
    last = [found[len(given) * 2 + i].scrubbed for i in range(len(odd))]
    assert last == [None, f"no json {HIDDEN}", f'"{HIDDEN}"', "[]", "", json.dumps({"input": ["A" * 2000, HIDDEN]}, separators=(",", ":"))]


def test_each_text_is_analysed_once(spark, tmp_path, monkeypatch):
    """Many bodies with the same long system text: the analyser sees it once."""
    df = spark.createDataFrame([(i, "anthropic", json.dumps({"system": "same text " * 50, "messages": [{"content": f"own {i % 5}"}]})) for i in range(100)], "id long, provider string, body string").repartition(4)
    plan = redact.scrub_json(df, "body", "provider")
    seen = plan.collect()
    leaves = {t for r in seen for *_, t, _ in pii.json_leaves(r.body, r.provider)[1]}
    assert len(seen) == 100 and len(leaves) == 6
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("analysed") < text.rindex("Aggregate [__text")


def test_functions_in_sql(spark):
    register_all(spark)
    spark.createDataFrame([(1, f"mail {MAIL} and 10.0.0.1, card 4111111111111111"), (2, None), (3, "")], "id long, text string").createOrReplaceTempView("notes")
    rows = spark.sql("SELECT id, s.* FROM notes, LATERAL pii_spans(text) AS s ORDER BY start").collect()
    assert [(r.id, r.entity_type, r.value) for r in rows] == [(1, "EMAIL_ADDRESS", MAIL), (1, "CREDIT_CARD", "4111111111111111")]
    assert [r[0] for r in spark.sql("SELECT redact_text(text) FROM notes ORDER BY id").collect()] == ["mail [REDACTED:EMAIL_ADDRESS] and 10.0.0.1, card [REDACTED:CREDIT_CARD]", None, ""]
    body = json.dumps({"messages": [{"content": MAIL}]})
    one = spark.sql(f"SELECT scrub_body('{body}', 'openai') AS b, pii_tier('EMAIL_ADDRESS') AS t, pii_tier('odd') AS o, seconds_left(TIMESTAMP '2024-01-01 10:00:50', 'minute') AS s, cost_e4(1000001, 2.5D) AS c, breaker_model('p:m:x') AS m").first()
    assert (json.loads(one.b)["messages"][0]["content"], one.t, one.o, one.s, one.c, one.m) == (HIDDEN, pii.POLICY["EMAIL_ADDRESS"], "REDACT", 10, 25001, "m:x")
    keys = spark.createDataFrame([("short",), ("sk-iw-0000000001",), (None,)], "k string").withColumns({"a": ids.mask_key_id(F.col("k")), "b": F.expr("mask_key_id(k)")})
    assert all(r.a == r.b for r in keys.collect())
