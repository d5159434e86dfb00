"""What showed on larger tables alone."""

import datetime

import duckdb
import pytest

from tollhouse.plans import catalog


@pytest.fixture(scope="module")
def idle(spark, tmp_path_factory):
    """A folder whose events hold one without any tokens among others."""
    base = tmp_path_factory.mktemp("idle")
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), i, "click", 0.001 if i % 2 else 3.5, '{"k": 0}' if i % 2 else '{"k": 7}') for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{base}/events.parquet")
    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{base}/customer.parquet")
    return str(base)


@pytest.mark.parametrize("name", ["parse_sse_responses", "parse_usage"])
def test_responses_without_tokens(spark, idle, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{idle}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, idle)
    columns = sorted(df.columns)
    wanted = con.sql(catalog.ORACLES[name])
    rows = sorted((tuple(dict(zip(wanted.columns, r, strict=True))[c] for c in columns) for r in wanted.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == rows


def test_a_key_is_replayed_from_packs(spark):
    """The task of a key sorts packs, not rows; decisions stay those of rows in order, with nulls among keys and values."""
    from tollhouse.operators import replay

    rows = [(None if i % 3 == 0 else f"k{i % 3}", i // 500, i, None if i % 7 == 0 else f"v{i % 5}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "key string, stretch long, at long, value string").repartition(5)

    def fresh():
        seen = []

        def decide(r):
            seen.append(r.at)
            return r.at, r.value if r.value == r.value else None, len(seen), seen[-2] if len(seen) > 1 else -1

        return decide

    schema = "at long, value string, n long, before long"
    cut = replay.replayed(df, ["key"], ["at"], fresh, schema, ["stretch"])
    assert sorted(cut.collect(), key=str) == sorted(replay.replayed(df, ["key"], ["at"], fresh, schema).collect(), key=str)
    assert replay._kept_packed(df, ["key"], ["stretch"], ["at"]).count() == 3 * 24


def test_rows_are_python_objects_in_slices(spark):
    """However large Spark's batches are, helpers get a slice of rows at a time, and all results stay in order."""
    from tollhouse.operators import redact

    df = spark.range(0, 1000, 1, 1).selectExpr("id", "IF(id % 9 = 0, NULL, concat('mail u', id, '@corp.test now')) AS text")
    held = redact._rowwise(lambda t: t and t.upper(), "string", df["text"])
    assert all(r.t == (r.text and r.text.upper()) for r in df.select("text", held.alias("t")).collect())
    back = redact.leak_check(redact.restore_text(redact.scrub_text(df, "text"), "scrubbed"), "restored")
    assert all(r.restored == r.text and r.leaked == 0 and r.restored_count == (r.text is not None) for r in back.collect())


def test_very_many_chunks_share_partitions(tmp_path, monkeypatch):
    from tollhouse.sources import history_source as h

    base = tmp_path / "dt=2024-01-01" / "hour=00"
    base.mkdir(parents=True)
    for i in range(10):
        (base / f"20240101T000000.000Z-edge-i-{i:06d}-00000000.jsonl").write_text(f"{i}\n")
    monkeypatch.setattr(h, "MAX_PARTITIONS", 4)
    parts = h.HistoryReader(str(tmp_path)).partitions()
    lines = [x.as_py() for p in parts for b in h.HistoryReader(str(tmp_path)).read(p) for x in b["line"]]
    assert len(parts) == 4 and lines == [str(i) for i in range(10)]


def test_history_is_appended_in_chunks(spark, tmp_path):
    """Small files are not written by Hadoop's local client; rows, bounds, rows without a time and what was there before stay."""
    import gzip

    from tollhouse.sources import history

    at = datetime.datetime(2024, 1, 1)
    items = [(i, None if i % 50 == 0 else at + datetime.timedelta(hours=i % 30), None if i % 3 == 0 else f'"é\n{i}') for i in range(1500)]
    df = spark.createDataFrame(items, "request_id long, ts timestamp, text string").repartition(3)
    base = str(tmp_path)
    for _ in range(2):
        history.write_history(df, base, "usage", max_records=7)
    files = [f for f in tmp_path.rglob("*") if f.is_file()]
    assert all(f.name.endswith(".jsonl.gz") and "_staging" not in str(f) for f in files)
    assert max(len(gzip.decompress(f.read_bytes()).splitlines()) for f in files) == 7
    fields = "request_id long, ts timestamp, text string"
    place = lambda t: (None, None) if t is None else (f"{t:%Y-%m-%d}", f"{t:%H}")
    wanted = sorted([(i, s, *place(t)) for i, t, s in items] * 2, key=repr)
    assert sorted(((r.request_id, r.text, r.dt, r.hour) for r in history.read_history(spark, base, "usage", fields).collect()), key=repr) == wanted
    second = history.read_history(spark, base, "usage", fields, ["2024-01-02", "2024-01-09"])
    assert {f.split("/dt=")[1][:10] for f in second.inputFiles()} == {"2024-01-02"}
    assert second.count() == sum(r[2] == "2024-01-02" for r in wanted)
    assert history.read_history(spark, base, "usage", fields, ["2023-01-01"]).count() == 0


def test_a_batch_has_more_files_of_a_larger_log(spark, sf, tmp_path, monkeypatch):
    """Two files a batch let two tasks redact a log of any size."""
    from tollhouse.plans import queries_stream
    from tollhouse.plans.adapter import Tables

    monkeypatch.setattr(queries_stream, "FILE_EVENTS", 100)
    monkeypatch.setattr(queries_stream, "_base", lambda t: str(tmp_path))
    found = catalog.QUERIES["stream_redact"](spark, sf)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 10
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) == 2
    assert {r.redacted for r in found.collect()} == {"mail [REDACTED:EMAIL_ADDRESS] now"} and found.count() == Tables(spark, sf).events.count()
