"""Streaming queries: the log is written as files, read as a stream until there is no more, and the sink is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollhouse.operators.failures import classify_failure
from tollhouse.operators.rollups import MEASURES
from tollhouse.plans.adapter import PRELUDE, Tables
from tollhouse.plans.queries_limits import BREAKERS, outcomes, rollup_events
from tollhouse.plans.registry import ORACLES, query
from tollhouse.sources.history_source import read_chunks
from tollhouse.streaming import jobs as J


def _base(t: Tables) -> str:
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tollhouse-stream-{uuid.uuid4().hex}"


#: Seconds by which rows may come late in the streams that decide in order: the log covers 30 days.
LATE_S = 60 * 86_400


#: Events by which the files of a batch grow, and the batches that a log is cut into.
FILE_EVENTS, BATCHES = 250_000, 2


def _written(t: Tables, rows: DataFrame, base: str) -> int:
    """Writes the log as files that share it by their ids' hash; the number of files that makes a batch: two at least, more for larger tables."""
    each = max(2, -(-t.events.count() // (FILE_EVENTS * BATCHES)))
    rows.repartition(BATCHES * each, "request_id").write.parquet(f"{base}/in")
    return each


def _close(t: Tables, rows: DataFrame, base: str) -> None:
    """Adds two files of one later row without an id each: the watermark passes all others."""
    for i in range(2):
        beat = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else (F.max("ts") + F.expr(f"INTERVAL {2 * LATE_S + i} SECONDS")).alias("ts") for f in rows.schema]
        t.spark.read.parquet(f"{base}/in").agg(*beat).write.mode("append").parquet(f"{base}/in")


def streamed(t: Tables, rows: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str, closed: bool = False) -> DataFrame:
    """What a job makes of rows that come as a stream, in batches of files.

    Rows are dealt to the files by their id's hash, so times jump back and forth; a batch has more files the
    larger the table is, so its tasks do not grow.  If ``closed``, two
    files of one later row without an id follow: the watermark passes all others.  In append mode the result goes to files.  In update mode each batch replaces the rows
    of its groups: batches are written with their number, and the last row of a group counts.
    """
    base = _base(t)
    each = _written(t, rows, base)
    if closed:
        _close(t, rows, base)
    source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/in")
    out = job(source)
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return t.spark.read.schema(out.schema).parquet(f"{base}/out")
    writer.foreachBatch(lambda df, n: df.withColumn("__batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


def _latest(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    last = F.max_by(F.struct(*values), "__batch").alias("v")
    return df.groupBy(*keys).agg(last).select(*keys, "v.*")


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _log(t: Tables) -> DataFrame:
    return _timed(t.usage.select("request_id", "ts", "provider", "model", "key_id", "status", "input_tokens", "output_tokens"))


_MEASURES = """CAST(sum(total_e4) AS BIGINT) AS spend_e4, CAST(sum(input_e4) AS BIGINT) AS input_spend_e4, CAST(sum(output_e4) AS BIGINT) AS output_spend_e4,
  count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens"""


def _cost_log(t: Tables) -> DataFrame:
    return _timed(t.usage.select("request_id", "ts", "provider", "model", "key_id", "user_id", "input_tokens", "output_tokens"))


def _costs(t: Tables, source: DataFrame) -> DataFrame:
    return J.stream_costs(source, J.stream_prices(t.usage, t.pricing, t.catalog), t.pricing)


def _rolled(t: Tables, by: str, dims: list[str]) -> DataFrame:
    out = streamed(t, _cost_log(t), lambda s: J.stream_rollup(_costs(t, s), by, dims, f"{LATE_S} seconds"), "update")
    return _latest(out, [by, *dims], [*MEASURES]).withColumn(by, F.col(by).cast("timestamp_ntz"))


query("stream_rollup", f"SELECT date_trunc('hour', ts) AS hour, provider, {_MEASURES} FROM cost GROUP BY 1, 2")(lambda t: _rolled(t, "hour", ["provider"]))
query("stream_rollup_daily", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, provider, model, {_MEASURES} FROM cost GROUP BY 1, 2, 3")(lambda t: _rolled(t, "day", ["provider", "model"]))
query("stream_rollup_monthly", f"SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, key_id, {_MEASURES} FROM cost GROUP BY 1, 2")(lambda t: _rolled(t, "month", ["key_id"]))
query("stream_rate_usage", "SELECT date_trunc('minute', ts) AS bucket, key_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1, 2")(
    lambda t: _latest(streamed(t, _log(t), lambda s: J.stream_rate_usage(s, watermark="60 days"), "update"), ["bucket", "key_id"], ["requests", "tokens"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
)
query("stream_failure_rate", """SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) + (i + 1) * INTERVAL 1 HOUR AS TIMESTAMP) AS until, provider, model, count(*) AS failures FROM usage, range(0, 2) r(i) WHERE status >= 500 GROUP BY 1, 2, 3""")(
    lambda t: _latest(streamed(t, _log(t), lambda s: J.stream_failure_rate(s, "2 hours", "1 hour", "60 days"), "update"), ["until", "provider", "model"], ["failures"]).withColumn("until", F.col("until").cast("timestamp_ntz"))
)
query("stream_dedupe_requests", "SELECT request_id, provider FROM usage")(
    lambda t: streamed(t, _log(t).unionByName(_log(t).filter("request_id % 3 = 0")), lambda s: J.stream_dedupe_requests(s, "60 days"), "append").select("request_id", "provider")
)
query("stream_redact", "SELECT request_id, 'mail [REDACTED:EMAIL_ADDRESS] now' AS redacted FROM usage")(
    lambda t: streamed(t, _log(t).withColumn("text", F.concat(F.lit("mail u"), F.col("request_id").cast("string"), F.lit("@corp.test now"))), lambda s: J.stream_redact(s, "text").select("request_id", "redacted"), "append")
)


@query("stream_history_sink", "SELECT request_id, provider, input_tokens, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hour, 'edge' AS role, 'i-1' AS instance FROM usage")
def stream_history_sink(t: Tables) -> DataFrame:
    base = _base(t)
    rows = _log(t)
    rows.write.parquet(f"{base}/in")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    J.stream_history_sink(source, base, "usage", f"{base}/state", max_records=100, role="edge", instance="i-1").trigger(availableNow=True).start().awaitTermination()
    return read_chunks(t.spark, base, "usage", "request_id long, provider string, input_tokens long")


_DIMS = " UNION ALL ".join(f"SELECT 'cost' AS metric, day, '{dim}' AS dim, {member} AS member, {_MEASURES} FROM cost{where} GROUP BY ALL" for dim, member, where in (("total", "''", ""), ("provider", "provider", ""), ("model", "model", ""), ("key", "key_id", " WHERE key_id <> ''"), ("user", "user_id", " WHERE user_id <> ''")))


@query("stream_day_archive", _DIMS)
def stream_day_archive(t: Tables) -> DataFrame:
    """All days of the log are closed by later rows without an id; a second job over the same log finds them archived."""
    base, rows = _base(t), _cost_log(t)
    each = _written(t, rows, base)
    _close(t, rows, base)
    for job in "ab":
        source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/in")
        days = J.day_deltas(_costs(t, source), f"{LATE_S} seconds")
        J.stream_day_archive(days, f"{base}/archive", f"{base}/state-{job}").trigger(availableNow=True).start().awaitTermination()
    last = t.usage.agg(F.to_date(F.max("ts")).alias("last"))
    return J.read_archive(t.spark, f"{base}/archive").join(last, F.col("day") <= F.col("last")).select("metric", "day", "dim", "member", *MEASURES)


_ATTEMPTS = ("request_id", "ts", "provider", "model", "failure_class", "aborted")
_ORDERED = {k: v for k, v in BREAKERS.items() if k != "bucket_s"}


query("stream_breaker")(lambda t: streamed(t, _timed(classify_failure(outcomes(t)).select(*_ATTEMPTS)), lambda s: J.stream_breaker(s, **_ORDERED, watermark_s=LATE_S), "append", True))
query("stream_rate_limit")(lambda t: streamed(t, _log(t), lambda s: J.stream_rate_limit(s, "key_id", 2, 30_000, 14, 300_000, watermark_s=LATE_S), "append", True))


@query("stream_provider_rollup", "WITH " + ORACLES["provider_rollup_open"].removeprefix(PRELUDE).lstrip(",\n").replace("request_id, provider, ts, count(*) FILTER (kind = 'opened') >= 2", "request_id, provider, count(*) FILTER (kind = 'opened') >= 2").replace("GROUP BY 1, 2, 3", "GROUP BY request_id, provider, ts"))
def stream_provider_rollup(t: Tables) -> DataFrame:
    return streamed(t, _timed(rollup_events(t)), lambda s: J.stream_provider_rollup(s, 2, 36_000, LATE_S), "append", True)
