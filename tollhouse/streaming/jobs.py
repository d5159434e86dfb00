"""Structured Streaming forms of the rollups, limits and breakers.

They take and return streaming DataFrames; windows need a timestamp column ``ts``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tollhouse.operators.breaker import Breakers
from tollhouse.operators.limits import Limiter
from tollhouse.operators.pricing import price_tiered, price_with_fallback, request_cost
from tollhouse.operators.redact import redact_text
from tollhouse.operators.rollups import MEASURES, measures
from tollhouse.sources import history_source
from tollhouse.sources.history import exists
from tollhouse.streaming.ordered import in_order


#: How long a rollup's state of an hour, a day and a month takes late rows (fixed values).
RETENTION = {"hour": "26 hours", "day": "48 hours", "month": "35 days"}


def stream_prices(known: DataFrame, pricing: DataFrame, catalog: DataFrame) -> DataFrame:
    """(provider, model, matched_model, is_estimate) of ``known`` names, for ``stream_costs``: names are matched once, outside the stream."""
    names = known.select("provider", "model").distinct().withColumn("input_tokens", F.lit(0).cast("long"))
    return price_with_fallback(names, pricing, catalog).select("provider", "model", "matched_model", "is_estimate")


def stream_costs(df: DataFrame, matched: DataFrame, pricing: DataFrame) -> DataFrame:
    """A stream of requests with matched_model, prices and costs by a join with static tables; unknown names cost 0."""
    named = df.join(matched, ["provider", "model"], "left").withColumn("is_estimate", F.coalesce("is_estimate", F.lit(False)))
    return request_cost(price_tiered(named, pricing, model_col="matched_model"))


def stream_rollup(costs: DataFrame, by: str, dims: list[str], watermark: str | None = None) -> DataFrame:
    """All measures of cost (``rollups.MEASURES``) of each UTC ``by`` (hour, day or month) and ``dims``; late rows count until the retention is over.

    The result has ``by`` as a timestamp at its start.  One job for each granularity: each has its own
    watermark, so an hour's state goes after a day and a month's after the month that follows.
    """
    start = F.date_trunc(by, "ts")
    rows = costs.withColumn(by, start).withWatermark(by, watermark or RETENTION[by])
    return rows.groupBy(by, *dims).agg(*measures())


def stream_rate_usage(df: DataFrame, scope: str = "key_id", watermark: str = "10 minutes") -> DataFrame:
    """Requests and tokens per scope and minute."""
    return df.withWatermark("ts", watermark).groupBy(F.window("ts", "1 minute").alias("w"), scope).agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("tokens")).select(F.col("w.start").alias("bucket"), scope, "requests", "tokens")


def stream_failure_rate(df: DataFrame, window: str = "120 seconds", slide: str = "10 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Failures per provider and model in sliding windows."""
    return df.filter("status >= 500").withWatermark("ts", watermark).groupBy(F.window("ts", window, slide).alias("w"), "provider", "model").agg(F.count("*").alias("failures")).select(F.col("w.end").alias("until"), "provider", "model", "failures")


def day_deltas(costs: DataFrame, watermark: str = RETENTION["day"]) -> DataFrame:
    """(metric, day, dim, member and all measures) of closed UTC days, for ``stream_day_archive``: totals and each dimension that has a member."""
    named = [F.when(F.col(c) != "", F.struct(F.lit(k).alias("dim"), F.col(c).alias("member"))) for k, c in (("provider", "provider"), ("model", "model"), ("key", "key_id"), ("user", "user_id"))]
    each = F.explode(F.array_compact(F.array(F.struct(F.lit("total").alias("dim"), F.lit("").alias("member")), *named))).alias("d")
    rows = costs.select("ts", each, "total_e4", "input_e4", "output_e4", "input_tokens", "output_tokens").withWatermark("ts", watermark)
    days = rows.groupBy(F.window("ts", "1 day").alias("w"), "d").agg(*measures())
    return days.select(F.lit("cost").alias("metric"), F.to_date("w.start").alias("day"), "d.*", *MEASURES)


def archive_batch(batch: DataFrame, number: int, path: str, writer: str) -> None:
    """Merges closed days (metric, day, …) into ``path/days``, each (metric, day) as a whole and by one writer alone.

    A ledger in ``path/ledger`` says which writer archived a day with which batch.  Days that
    another writer or batch has archived are left as they are; a batch that runs again, even after
    it failed between data and ledger, replaces its own days by the same rows.
    """
    spark = batch.sparkSession
    ledger = f"{path}/ledger"
    fields = "metric string, day date, writer string, batch long"
    known = spark.read.schema(fields).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], fields)
    theirs = known.filter((F.col("writer") != writer) | (F.col("batch") != number))
    rows = batch.join(theirs, ["metric", "day"], "left_anti").persist()
    rows.repartition("metric", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "day").parquet(f"{path}/days")
    mine = known.filter((F.col("writer") == writer) & (F.col("batch") == number))
    new = rows.select("metric", "day").distinct().join(mine, ["metric", "day"], "left_anti")
    new.withColumns({"writer": F.lit(writer), "batch": F.lit(number).cast("long")}).coalesce(1).write.mode("append").parquet(ledger)
    rows.unpersist()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The days that ``stream_day_archive`` has closed; both filters on metric and day prune folders."""
    fields = ", ".join(f"{m} long" for m in MEASURES)
    return spark.read.schema(f"dim string, member string, {fields}, metric string, day date").parquet(f"{path}/days")


def stream_day_archive(days: DataFrame, path: str, checkpoint: str, writer: str = "") -> DataStreamWriter:
    """Writes closed days, such as ``day_deltas`` gives them, once: after the watermark, merged by (metric, day).

    ``writer`` names this job (its checkpoint, if empty) in the ledger.
    """
    return days.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: archive_batch(df, n, path, writer or checkpoint))


def stream_dedupe_requests(df: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Rows without repeated request ids within the watermark."""
    return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["request_id"])


def stream_redact(df: DataFrame, text_col: str) -> DataFrame:
    """Redacted text as it arrives; stateless."""
    return redact_text(df, text_col)


def stream_history_sink(
    df: DataFrame, base: str, stream: str, checkpoint: str, trigger: str = "5 minutes", max_records: int = history_source.MAX_RECORDS, max_bytes: int = history_source.MAX_BYTES,
    role: str = "sidecar", instance: str = "spark", streams: tuple[str, ...] | None = None,
) -> DataStreamWriter | None:
    """Writes rows as chunks of gzip JSON lines by day and hour, of at most ``max_records`` rows and ``max_bytes`` bytes of text (a longer row is alone).

    A chunk is as old as ``trigger`` at most.  It appears when its batch commits and belongs to
    ``role`` and ``instance``.  A stream that ``streams`` does not list is not written: None.
    """
    if streams is not None and stream not in streams:
        return None
    history_source.register(df.sparkSession)
    writer = history_source.chunk_rows(df, stream).writeStream.format("history").option("path", f"{base}/{stream}").option("checkpointLocation", checkpoint)
    return writer.option("maxRecords", max_records).option("maxBytes", max_bytes).option("role", role).option("instance", instance).trigger(processingTime=trigger)


_BREAKER = "request_id long, provider string, model string, state_before string, action string, key string, opens boolean"


def stream_breaker(attempts: DataFrame, threshold: int = 5, window_s: int = 120, cooldown_s: int = 300, rollup_threshold: int = 0, rollup_window_s: int = 300, watermark_s: int = 600) -> DataFrame:
    """What ``breaker_replay`` answers to whole logs, for attempts (failure_class, aborted) in whatever order they come.

    A provider's attempts wait until the watermark has passed them.  Closed keys without late
    failures are forgotten, a provider with nothing to remember altogether.
    """

    def step(key: tuple, memory: dict | None, rows: Iterable) -> tuple[dict | None, list[tuple]]:
        own, out, now = Breakers(key[0], threshold, window_s, cooldown_s, "enforce", rollup_threshold, rollup_window_s), [], 0
        if memory:
            own.load(memory)
        for r in rows:
            now = r.us
            state, action, by, opens = own.decide(now, r.model, r.failure_class, r.aborted)
            out.append((r.request_id, key[0], r.model, state, action, by, opens))
        own.forget(now)
        return own.dump() if own.keys or own.opened else None, out

    given = {"provider": "", "model": "", "failure_class": "none", "aborted": False}
    rows = attempts.select("request_id", "ts", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in given.items()])
    return in_order(rows, ["provider"], "request_id long, us long, model string, failure_class string, aborted boolean", _BREAKER, ["us", "request_id"], step, watermark_s)


def stream_provider_rollup(events: DataFrame, threshold: int, window_s: int = 300, watermark_s: int = 600) -> DataFrame:
    """(request_id, provider, open, count) at each opening, as ``provider_rollup_open`` gives it, for events (key, kind) in whatever order.

    The state is the time of each key's latest opening; keys leave it when they recover or
    their opening is older than the window.
    """
    out = "request_id long, provider string, open boolean, count long"

    def step(key: tuple, memory: dict | None, rows: Iterable) -> tuple[dict | None, list[tuple]]:
        opened, found = memory or {}, []
        for now, together in itertools.groupby(rows, key=lambda r: r.us):
            openings = []
            for r in together:
                if r.kind == "probe_closed":
                    opened.pop(r.key, None)
                else:
                    opened[r.key] = now
                    openings.append(r.request_id)
            opened = {k: t for k, t in opened.items() if t > now - window_s * 1_000_000}
            n = len(opened) if window_s > 0 else 0
            found += [(i, key[0], n >= threshold > 0, n) for i in openings]
        return opened or None, found

    rows = events.filter(F.col("request_id").isNull() | F.col("kind").isin("opened", "probe_reopened", "probe_closed")).select("request_id", "ts", F.coalesce("provider", F.lit("")).alias("provider"), "key", "kind")
    return in_order(rows, ["provider"], "request_id long, us long, key string, kind string", out, ["us", "request_id"], step, watermark_s)


_LIMIT = "request_id long, scope string, allowed boolean, metric string, win string"


def stream_rate_limit(df: DataFrame, scope: str, rpm: int, tpm: int = 0, rpd: int = 0, tpd: int = 0, watermark_s: int = 600, first_free: bool = True) -> DataFrame:
    """(request_id, scope, allowed, metric, win) as ``rate_limit_replay`` gives them for whole logs, for requests in whatever order they come; 0 is no limit.

    A scope's requests wait until the watermark has passed them; its counters go with its day.
    """

    def step(key: tuple, memory: list | None, rows: Iterable) -> tuple[list | None, list[tuple]]:
        limiter, out = Limiter(rpm, tpm, rpd, tpd, first_free), []
        if memory:
            limiter.used = memory
        for r in rows:
            denied = limiter.decide(r.us // 1_000_000, r.tokens)
            out.append((r.request_id, key[0], denied is None, *(denied or ("", ""))[:2]))
        return limiter.used if out or memory else None, out

    tokens = F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))
    rows = df.filter(F.col("request_id").isNull() | (F.col(scope) != "")).select("request_id", "ts", F.coalesce(scope, F.lit("")).alias("scope"), tokens.cast("long").alias("tokens"))
    return in_order(rows, ["scope"], "request_id long, us long, tokens long", _LIMIT, ["us", "request_id"], step, watermark_s)
