"""Failure classes and kinds of recorded outcomes, and what is read from breakers' openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of an error body that are looked at; a JSON body cut there cannot be parsed and says nothing (fixed value).
PEEK_BYTES = 512
#: Seconds to wait from which a limit is taken for one of the whole account (fixed value).
LONG_WAIT_S = 60
_ENVELOPE = "error struct<code:string, type:string, status:string, message:string>"


def _envelope(body: Column) -> Column:
    """The ``error`` object of a body, null where it is not JSON or too long to be looked at."""
    return F.from_json(F.when(F.octet_length(body) <= PEEK_BYTES, body), _ENVELOPE)["error"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def classify_failure(df: DataFrame) -> DataFrame:
    """``df`` (provider, status, error_body, remaining_requests, remaining_tokens, retry_after, transport_error, ts) with failure_class.

    Transport errors are degraded, but a cancellation by the client is none; so is any status
    below 400.  From 500 on all is degraded.  429 depends on the provider: without remaining
    requests and tokens, or with a minute or more to wait, it is global, else localized;
    openai's is insufficient_quota by the body's code, and global without any header; gemini's
    is global if an exhausted resource's message names a quota.  Other providers' 429 and all
    other client errors are none.  A null status without an error (no response) is degraded.
    """
    status, said = F.col("status"), F.col("__said")
    left = [F.trim(_text(c)) for c in ("remaining_requests", "remaining_tokens")]
    waits = F.coalesce(parse_retry_after(F.col("retry_after").cast("string"), F.col("ts")), F.lit(0)) >= LONG_WAIT_S
    scope = F.when(((left[0] == "0") & (left[1] == "0")) | waits, "global_rate_limit").otherwise("localized_rate_limit")
    bare = (_text("remaining_requests") == "") & (_text("remaining_tokens") == "") & (_text("retry_after") == "")
    quota = (said["status"] == "RESOURCE_EXHAUSTED") & F.lower(said["message"]).contains("quota")
    limited = (
        F.when(F.col("provider") == "anthropic", scope)
        .when(F.col("provider") == "openai", F.when(said["code"] == "insufficient_quota", "insufficient_quota").when(bare, "global_rate_limit").otherwise(scope))
        .when(F.col("provider") == "gemini", F.when(quota, "global_rate_limit").otherwise("localized_rate_limit"))
        .otherwise("none")
    )
    failed = F.when(F.lower(_text("transport_error")).contains("context canceled"), "none").when(_text("transport_error") != "", "provider_degraded")
    answered = F.when(status.isNull() | (status >= 500), "provider_degraded").when(status == 429, limited).otherwise("none")
    return df.withColumn("__said", _envelope(F.col("error_body"))).withColumn("failure_class", F.coalesce(failed, answered)).drop("__said")


#: Kinds of transport errors by what their messages contain, the first that holds (fixed values).
TRANSPORT_KINDS = (
    ("timeout budget exceeded", "timeout_budget_exceeded"),
    ("context canceled", "client_canceled"),
    ("unexpected eof", "unexpected_eof"),
    ("connection reset", "connection_reset"),
    ("connection refused", "connection_refused"),
    ("tls handshake", "tls_handshake"),
    ("no such host", "dns_failure"),
    ("i/o timeout", "io_timeout"),
    ("context deadline exceeded", "client_deadline_exceeded"),
    ("handler timeout", "client_deadline_exceeded"),
)
#: Kinds that a provider's error body names, by provider, status, field and value (fixed values).
BODY_KINDS = (
    ("gemini", 503, "status", "UNAVAILABLE", "gemini_unavailable"),
    ("gemini", 429, "status", "RESOURCE_EXHAUSTED", "gemini_resource_exhausted"),
    ("gemini", 500, "status", "INTERNAL", "gemini_internal"),
    ("gemini", 504, "status", "DEADLINE_EXCEEDED", "gemini_deadline_exceeded"),
    ("anthropic", 529, "type", "overloaded_error", "anthropic_overloaded"),
    ("anthropic", 529, "type", "", "anthropic_overloaded"),
    ("anthropic", 429, "type", "rate_limit_error", "anthropic_rate_limit"),
    ("anthropic", 500, "type", "api_error", "anthropic_api_error"),
    ("anthropic", 504, "type", "timeout_error", "anthropic_timeout"),
    ("anthropic", 413, "type", "request_too_large", "anthropic_request_too_large"),
    ("openai", 429, "code", "insufficient_quota", "openai_insufficient_quota"),
)
#: Kinds by status alone (fixed values).
STATUS_KINDS = {500: "http_500", 502: "http_502", 503: "http_503", 504: "http_504", 529: "http_overloaded"}


def failure_kind(df: DataFrame) -> DataFrame:
    """``df`` (as for ``classify_failure``) with a fine-grained label of the failure, '' for none.

    A transport error is told by its message, a response by what its provider's error body
    names, else by its status; 429 by its failure class.
    """
    error, status, said = F.lower(_text("transport_error")), F.col("status"), F.col("__said")
    broken = F.when(error.rlike(r"(^|[\s:])eof$") & ~error.contains("unexpected eof"), "eof")
    for part, kind in TRANSPORT_KINDS:
        broken = broken.when(error.contains(part), kind)
    broken = broken.when(error.rlike(r"^(dial|read|write) (tcp|udp)"), "network_other").when(error != "", "unknown_transport")
    named = F.lit(None).cast("string")
    for provider, code, field, value, kind in BODY_KINDS:
        named = F.coalesce(named, F.when((F.col("provider") == provider) & (status == code) & (F.coalesce(said[field], F.lit("")) == value), kind))
    limited = F.when(F.col("__class") == "insufficient_quota", "http_429_quota").when(F.col("__class") == "global_rate_limit", "http_429_global").otherwise("http_429_local")
    plain = F.when(status.isNull(), "nil_response").when(status < 400, "").when(status == 429, limited)
    for code, kind in STATUS_KINDS.items():
        plain = plain.when(status == code, kind)
    plain = plain.when(status >= 500, "http_5xx_other").otherwise("http_4xx")
    own = df.columns
    classed = classify_failure(df).withColumn("__class", F.col("failure_class")).withColumn("__said", _envelope(F.col("error_body")))
    return classed.withColumn("failure_kind", F.coalesce(broken, named, plain)).select(*own, "failure_kind")


def error_detail(df: DataFrame, most: int = 200) -> DataFrame:
    """``df`` with error_code and error_detail (``CODE: message``, cut at ``most`` characters) of the error envelope in error_body."""
    code = F.coalesce(F.get_json_object("error_body", "$.error.code"), F.get_json_object("error_body", "$.error.type"), F.get_json_object("error_body", "$.error.status"), F.lit(""))
    message = F.coalesce(F.get_json_object("error_body", "$.error.message"), F.lit(""))
    whole = F.when(code == "", message).when(message == "", code).otherwise(F.concat(code, F.lit(": "), message))
    return df.withColumns({"error_detail": F.substring(F.trim(whole), 1, most), "error_code": code})


def parse_retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After value, a number or an HTTP date; the past is 0."""
    seconds = F.when(value.rlike(r"^\s*\d+\s*$"), F.trim(value).cast("long"))
    date = F.try_to_timestamp(F.regexp_extract(value, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return F.coalesce(seconds, F.greatest(F.lit(0), F.ceil(date.cast("double") - now.cast("timestamp").cast("double"))))


def failure_window_count(df: DataFrame, seconds: int = 120) -> DataFrame:
    """Failures with the number of failures of the same provider and model in the ``seconds`` up to each, the lower bound excluded.

    Time is cut into pieces of the window's length, and each failure is looked at in its own
    piece and in the one after: a task sorts two pieces of a key at most.
    """
    length = seconds * 1_000_000
    rows = df.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("__at", F.explode(F.array(F.struct((F.floor(F.col("__us") / length)).alias("piece"), F.lit(True).alias("own")), F.struct((F.floor(F.col("__us") / length) + 1).alias("piece"), F.lit(False).alias("own")))))
    w = W.partitionBy("provider", "model", "__at.piece").orderBy("__us").rangeBetween(-length + 1, 0)
    return rows.withColumn("failures", F.count("*").over(w)).filter("__at.own").drop("__us", "__at")


def force_open(attempts: DataFrame, cooldown_s: int = 300) -> DataFrame:
    """Quota failures: the bare provider, open for one cooldown each."""
    return attempts.filter("failure_class = 'insufficient_quota'").select("request_id", F.col("provider").alias("key"), F.col("ts").alias("opened_at"), (F.col("ts") + F.expr(f"INTERVAL {cooldown_s} SECONDS")).alias("open_until"))


def provider_health(states: DataFrame) -> DataFrame:
    """Per provider of rows (key, failures, state, cooldown_until): failures, the worst state and the earliest cooldown."""
    rank = F.when(F.col("state") == "open", 2).when(F.col("state") == "half_open", 1).otherwise(0)
    worst = F.max(rank)
    return states.groupBy(F.split("key", ":")[0].alias("provider")).agg(F.sum("failures").alias("failures"), F.when(worst == 2, "open").when(worst == 1, "half_open").otherwise("closed").alias("state"), F.min("cooldown_until").alias("cooldown_until"))


def provider_rollup_open(events: DataFrame, threshold: int, window_s: int = 300, bucket_s: int = 3600) -> DataFrame:
    """(request_id, provider, ts, open, count) at each opening: keys of the provider that opened within the window up to it and have not recovered.

    An opening holds from its time until the key opens again or recovers (``probe_closed``),
    for less than the window; the count is a running sum of such beginnings and ends.  With a
    threshold or window of 0 or less nothing is ever open.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kept = events.filter(F.col("kind").isin("opened", "probe_reopened", "probe_closed")).withColumn("__us", micros)
    of_key = W.partitionBy("provider", "key").orderBy("__us", "request_id")
    after = F.coalesce(F.lead("__us").over(of_key), F.lit((1 << 63) - 1))
    opened = kept.withColumn("__end", F.least(after, F.col("__us") + window_s * 1_000_000)).filter(F.col("kind") != "probe_closed")
    begins = opened.select("request_id", "provider", "ts", "__us", F.lit(1).alias("__n"))
    ends = opened.select(F.lit(None).cast(opened.schema["request_id"].dataType).alias("request_id"), "provider", F.col("ts"), F.col("__end").alias("__us"), F.lit(-1).alias("__n"))
    both = begins.unionByName(ends).withColumn("__bucket", F.floor(F.col("__us") / (bucket_s * 1_000_000)))
    # Sums of earlier buckets, then those within a bucket: no provider's log meets in one task.
    sums = both.groupBy("provider", "__bucket").agg(F.sum("__n").alias("__sum"))
    earlier = W.partitionBy("provider").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("provider").alias("__p"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    both = both.join(sums, both.provider.eqNullSafe(F.col("__p")) & (F.col("__bucket") == F.col("__b")))
    running = F.col("__before") + F.sum("__n").over(W.partitionBy("provider", "__bucket").orderBy("__us"))
    counted = both.withColumn("count", running if window_s > 0 else F.lit(0).cast("long")).filter("__n = 1")
    return counted.withColumn("open", (F.col("count") >= threshold) if threshold > 0 else F.lit(False)).select("request_id", "provider", "ts", "open", "count")


def timeout_credit_filter(attempts: DataFrame, hang_s: float) -> DataFrame:
    """``attempts`` with credited: a timeout counts as a failure unless the caller cut the budget and the hang was shorter than ``hang_s``."""
    return attempts.withColumn("credited", ~(F.col("caller_shortened") & (F.col("elapsed_s") < hang_s)))
