"""Queries of personal data over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollhouse.functions.surface import register_all
from tollhouse.operators import redact as X
from tollhouse.plans.registry import ORACLES, QUERIES


def _query(name: str, table: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
_TEST = "(lower(v) LIKE 'test@%' OR lower(v) LIKE 'dev@%' OR " + " OR ".join(f"lower(v) LIKE '%{d}'" for d in ("@example.com", "@example.org", "@example.net", "@test.com", "@localhost")) + ")"
_FOUND = f"SELECT doc_id, v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents) z"


@_query("pii_detect", "documents", f"SELECT doc_id, v AS value FROM ({_FOUND}) y")
def pii_detect(docs: DataFrame) -> DataFrame:
    return X.exploded(X.pii_detect(docs, "text", ["EMAIL_ADDRESS"]), "text").select("doc_id", "value")


@_query("pii_entities", "documents")
def pii_entities(docs: DataFrame) -> DataFrame:
    return X.exploded(X.span_threshold(X.pii_detect(docs, "text"), "text"), "text").groupBy("span.entity_type").agg(F.count("*").alias("n"))


@_query("entity_allowlist", "documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'US_SSN' ELSE 'all' END AS kept FROM documents")
def entity_allowlist(docs: DataFrame) -> DataFrame:
    asked = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("UK_NHS"), F.lit("US_SSN"))).otherwise(F.array(F.lit("UK_NHS")))
    kept = X.entity_allowlist(asked)
    return docs.select("doc_id", F.when(F.size(kept) == 14, "all").otherwise(F.array_join(kept, ",")).alias("kept"))


@_query("span_threshold", "documents", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n FROM documents WHERE length(text) >= 1")
def span_threshold(docs: DataFrame) -> DataFrame:
    made = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("PERSON").alias("entity_type"), F.when(F.col("doc_id") % 3 == 0, 0.4).otherwise(0.5).alias("score")))
    return X.span_threshold(docs.filter(F.length("text") >= 1).withColumn("spans", made.cast(X.SPANS)), "text").select("doc_id", F.size("spans").alias("n"))


@_query("allow_middle_ground", "documents", f"SELECT doc_id, v AS value, {_TEST} AS allowed, CASE WHEN {_TEST} THEN 'test_email' ELSE '' END AS reason FROM ({_FOUND}) y")
def allow_middle_ground(docs: DataFrame) -> DataFrame:
    return X.allow_middle_ground(X.exploded(X.pii_detect(docs, "text", ["EMAIL_ADDRESS"]), "text")).select("doc_id", "value", "allowed", "reason")


@_query("resolve_overlaps", "documents")
def resolve_overlaps(docs: DataFrame) -> DataFrame:
    spans = X.resolve_overlaps(X.span_threshold(X.pii_detect(docs, "text"), "text"))
    return spans.select("doc_id", F.to_json("spans").alias("spans"))


@_query("redact_text", "documents")
def redact_text(docs: DataFrame) -> DataFrame:
    return X.redact_text(docs, "text").select("doc_id", "redacted", F.to_json("entity_counts").alias("entity_counts"), "changed")


@_query("scrub_text", "documents")
def scrub_text(docs: DataFrame) -> DataFrame:
    return X.scrub_text(docs, "text").select("doc_id", "scrubbed", F.to_json("registry").alias("registry"))


def _masked_only(registry: str) -> F.Column:
    return ~F.exists(registry, lambda r: r["policy"] != "MASK")


@_query("restore_text", "documents")
def restore_text(docs: DataFrame) -> DataFrame:
    """What masking alone changed comes back whole."""
    back = X.restore_text(X.scrub_text(docs, "text"), "scrubbed")
    return back.select("doc_id", "restored_count", (F.col("restored") == F.col("text")).alias("whole"), _masked_only("registry").alias("masked_only"), F.col("scrubbed").contains("[REDACTED:").alias("redacted"))


@_query("leak_check", "documents", "SELECT doc_id, 0 AS leaked FROM documents")
def leak_check(docs: DataFrame) -> DataFrame:
    return X.leak_check(X.restore_text(X.scrub_text(docs, "text"), "scrubbed"), "restored").select("doc_id", "leaked")


@_query("reformat_placeholders", "documents", "SELECT doc_id, 'to [ PII_PERSON_' || doc_id || ' ], done' AS text FROM documents")
def reformat_placeholders(docs: DataFrame) -> DataFrame:
    given = F.concat(F.lit("to <PII_PERSON_"), F.col("doc_id").cast("string"), F.lit(">, done"))
    return docs.select("doc_id", X.reformat_placeholders(given, "[", "]", True).alias("text"))


@_query("dedupe_analyze", "documents", f"SELECT d.doc_id, count(y.v) AS n FROM documents d LEFT JOIN ({_FOUND}) y ON y.doc_id = d.doc_id GROUP BY 1")
def dedupe_analyze(docs: DataFrame) -> DataFrame:
    return X.dedupe_analyze(docs, "text").select("doc_id", F.size(F.filter("spans", lambda s: s["entity_type"] == "EMAIL_ADDRESS")).cast("long").alias("n"))


@_query("scan_outcome", "documents", "SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'oversize' WHEN doc_id % 7 = 0 THEN 'fail_closed' ELSE 'ok' END AS outcome FROM documents")
def scan_outcome(docs: DataFrame) -> DataFrame:
    return X.scan_outcome(docs, "text", F.col("doc_id") % 7 == 0, 4000, "closed").select("doc_id", "outcome")


_SCANS = "scans AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 5 AS INT) AS day, source, CASE WHEN strlen(text) > 4000 OR doc_id % 7 = 0 THEN 0 ELSE (SELECT count(*) FROM ({found}) y WHERE y.doc_id = d.doc_id) END AS n, CASE WHEN strlen(text) > 4000 THEN 'oversize' WHEN doc_id % 7 = 0 THEN 'fail_open' ELSE 'ok' END AS outcome FROM documents d)".format(found=_FOUND)


def _scanned(docs: DataFrame) -> DataFrame:
    """Documents with the outcome of their scan, too long and failed ones without their text."""
    return X.scanned_text(X.scan_outcome(docs, "text", F.col("doc_id") % 7 == 0, 4000), "text")


def _scans(docs: DataFrame) -> DataFrame:
    found = X.pii_detect(_scanned(docs), "text", ["EMAIL_ADDRESS"])
    counts = F.when(F.size("spans") > 0, F.create_map(F.lit("EMAIL_ADDRESS"), F.size("spans"))).otherwise(F.create_map().cast("map<string,int>"))
    return found.withColumns({"entity_counts": counts, "day": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))})


_DAILY = """SELECT day, count(*) AS requests_scanned, count(*) FILTER (n > 0) AS requests_with_pii, CAST(sum(n) AS BIGINT) AS entities_total, count(*) FILTER (outcome = 'fail_open') AS fail_open,
 count(*) FILTER (outcome = 'fail_closed') AS fail_closed, count(*) FILTER (outcome = 'oversize') AS oversize, CAST(count(*) FILTER (n > 0) AS DOUBLE) / count(*) FILTER (outcome = 'ok') AS detection_rate FROM scans GROUP BY 1"""
_query("pii_daily", "documents", f"WITH {_SCANS} {_DAILY}")(lambda docs: X.pii_daily(_scans(docs)))
_query("pii_by_entity", "documents", f"WITH {_SCANS} SELECT day, 'EMAIL_ADDRESS' AS name, CAST(sum(n) AS BIGINT) AS count FROM scans WHERE n > 0 GROUP BY 1")(lambda docs: X.pii_by_entity(_scans(docs)))
_query("pii_by_provider", "documents", f"WITH {_SCANS} SELECT day, source AS name, count(*) AS count FROM scans GROUP BY 1, 2")(lambda docs: X.pii_by(_scans(docs), "source"))
_query("pii_by_key", "documents", "SELECT DATE '2024-01-01' + CAST(doc_id % 5 AS INT) AS day, 'key-' || doc_id % 9 AS name, count(*) AS count FROM documents GROUP BY 1, 2")(
    lambda docs: X.pii_by(_scans(docs).withColumn("key", F.concat(F.lit("key-"), (F.col("doc_id") % 9).cast("string"))), "key")
)


@_query("range_detection_rate", "documents", f"WITH {_SCANS}, d AS ({_DAILY}), l AS (SELECT * FROM d ORDER BY day DESC LIMIT 3) SELECT CAST(sum(requests_with_pii) AS DOUBLE) / CAST(sum(requests_scanned - fail_open - fail_closed - oversize) AS DOUBLE) AS rate FROM l")
def range_detection_rate(docs: DataFrame) -> DataFrame:
    from tollhouse.operators.rollups import range_detection_rate as rate

    return rate(X.pii_daily(_scans(docs)), 3)


@_query("pii_tier_counts", "documents", "SELECT doc_id, CAST(doc_id % 4 AS INT) AS masked, CAST(doc_id % 3 AS INT) AS sealed, 2 AS redacted, CAST(doc_id % 4 + doc_id % 3 + 2 AS INT) AS detected FROM documents")
def pii_tier_counts(docs: DataFrame) -> DataFrame:
    counts = F.create_map(F.lit("PERSON"), (F.col("doc_id") % 4).cast("int"), F.lit("US_SSN"), (F.col("doc_id") % 3).cast("int"), F.lit("CREDIT_CARD"), F.lit(1), F.lit("SOMETHING_NEW"), F.lit(1))
    return X.pii_tier_counts(docs.withColumn("c", counts), "c").select("doc_id", "masked", "sealed", "redacted", "detected")


@_query("scrub_conversation", "conversations")
def scrub_conversation(turns: DataFrame) -> DataFrame:
    with_mail = turns.withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("write to c"), F.col("conv_id").cast("string"), F.lit("@corp.test or c"), (F.col("turn") % 2).cast("string"), F.lit("@corp.test"))))
    return X.scrub_conversation(with_mail, "conv_id", "turn", "text").select("conv_id", "turn", "scrubbed", F.max("originals").over(W.partitionBy("conv_id")).alias("originals"))


@_query("scrub_json", "conversations", """SELECT conv_id, turn, '{"model":"m","messages":[{"role":"' || role || '","content":"mail <PII_EMAIL_ADDRESS_1> now"}],"metadata":{"note":"a@corp.test"}}' AS scrubbed FROM conversations""")
def scrub_json(turns: DataFrame) -> DataFrame:
    body = F.concat(F.lit('{"model":"m","messages":[{"role":"'), "role", F.lit('","content":"mail x'), F.col("turn").cast("string"), F.lit('@corp.test now"}],"metadata":{"note":"a@corp.test"}}'))
    return X.scrub_json(turns.withColumn("body", body), "body").select("conv_id", "turn", "scrubbed")


@_query("mask_json_metadata", "conversations", """SELECT conv_id, turn, '{"     ":" ","        ":[{"    ":"' || repeat(' ', length(role)) || '","       ":"hi"}]}' AS masked FROM conversations""")
def mask_json_metadata(turns: DataFrame) -> DataFrame:
    body = F.concat(F.lit('{"model":"m","messages":[{"role":"'), "role", F.lit('","content":"hi"}]}'))
    return X.mask_json_metadata(turns.withColumn("body", body), "body").select("conv_id", "turn", "masked")


@_query("strip_images", "conversations", "SELECT conv_id, turn, 'a __IMAGE__ b' AS stripped, true AS whole FROM conversations")
def strip_images(turns: DataFrame) -> DataFrame:
    body = F.concat(F.lit("a "), F.repeat(F.lit("QUJD"), 300), F.lit(" b"))
    cut = X.strip_images(turns.withColumns({"body": body, "before": body}), "body")
    return X.unstrip_images(cut.withColumn("stripped", F.col("body")), "body").select("conv_id", "turn", "stripped", (F.col("body") == F.col("before")).alias("whole"))


@_query("extract_images", "conversations", "SELECT conv_id * 1000 + turn AS request_id, 0 AS index, 'ABCABC' AS bytes FROM conversations")
def extract_images(turns: DataFrame) -> DataFrame:
    body = F.lit('{"messages":[{"content":[{"type":"image_url","image_url":{"url":"data:image/png;base64,QUJDQUJD"}}]}]}')
    return X.extract_images(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), body.alias("body")), "body", 1 << 20).withColumn("bytes", F.col("bytes").cast("string"))


_GATE = "SELECT DISTINCT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN 'blocked' WHEN 1 THEN 'fail_open' ELSE 'cleared' END AS outcome, CASE doc_id % 3 WHEN 0 THEN 'US_PASSPORT' ELSE '' END AS entity_type FROM documents"


def _gate(docs: DataFrame) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, "passport no A12345678").otherwise("a cat on a mat")
    return X.gov_id_gate(docs.select(F.col("doc_id").alias("request_id"), text.alias("text"), (F.col("doc_id") % 3 == 1).alias("error")))


_query("gov_id_gate", "documents", _GATE)(lambda docs: _gate(docs).drop("score"))
_query("id_gate_daily", "documents", f"WITH g AS ({_GATE}) SELECT DATE '2024-01-01' + CAST(request_id % 5 AS INT) AS day, count(*) AS with_images, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'cleared') AS cleared, count(*) FILTER (outcome = 'fail_open') AS fail_open FROM g GROUP BY 1")(
    lambda docs: X.id_gate_daily(_gate(docs).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("request_id") % 5).cast("int"))))
)


# The same operators over whole texts with all pattern entities.  DuckDB cannot follow the scores and check digits, so these have no SQL.


def _all_scans(docs: DataFrame) -> DataFrame:
    found = X.span_threshold(X.pii_detect(_scanned(docs), "text"), "text")
    kinds = F.array_distinct(F.transform("spans", lambda s: s["entity_type"]))
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("spans", lambda s: s["entity_type"] == k))))
    return found.withColumns({"entity_counts": counts, "day": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))})


_query("pii_daily_all", "documents")(lambda docs: X.pii_daily(_all_scans(docs)))
_query("pii_by_entity_all", "documents")(lambda docs: X.pii_by_entity(_all_scans(docs)))
_query("pii_tier_counts_all", "documents")(lambda docs: X.pii_tier_counts(_all_scans(docs), "entity_counts").select("doc_id", "masked", "sealed", "redacted", "detected"))
_query("dedupe_analyze_all", "documents")(lambda docs: X.dedupe_analyze(docs, "text").select("doc_id", F.to_json("spans").alias("spans")))
_query("reformat_placeholders_all", "documents")(lambda docs: X.scrub_text(docs, "text").select("doc_id", X.reformat_placeholders(F.col("scrubbed"), "[", "]", True).alias("text")))


@_query("range_detection_rate_all", "documents")
def range_detection_rate_all(docs: DataFrame) -> DataFrame:
    from tollhouse.operators.rollups import range_detection_rate as rate

    return rate(X.pii_daily(_all_scans(docs)), 3)


def _text_gate(docs: DataFrame) -> DataFrame:
    return X.gov_id_gate(docs.select(F.col("doc_id").alias("request_id"), "text", (F.col("doc_id") % 3 == 1).alias("error")))


_query("gov_id_gate_all", "documents")(_text_gate)
_query("id_gate_daily_all", "documents")(lambda docs: X.id_gate_daily(_text_gate(docs).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("request_id") % 5).cast("int")))))


def _bodies(turns: DataFrame) -> DataFrame:
    """Chat bodies of the turns' own texts."""
    message = F.struct("role", F.coalesce("text", F.lit("")).alias("content"))
    return turns.withColumn("body", F.to_json(F.struct(F.lit("m").alias("model"), F.array(message).alias("messages"), F.struct(F.lit("a@corp.test").alias("note")).alias("metadata"))))


def _provider_bodies(turns: DataFrame) -> DataFrame:
    """Each turn's whole text as a request body in the format of one of four providers."""
    text = F.coalesce("text", F.lit(""))
    say = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    tool = say(toolUse=say(name=F.lit("find"), input=say(note=text)))
    bodies = (
        ("openai", say(model=F.lit("m"), input=F.array(text, F.lit("again")), metadata=say(note=text))),
        ("anthropic", say(system=text, messages=F.array(say(role=F.col("role"), content=F.array(say(type=F.lit("text"), text=text)))))),
        ("gemini", say(contents=F.array(say(parts=F.array(say(text=text, functionCall=say(name=F.lit("f"), args=say(who=text)))))))),
        ("bedrock", say(messages=F.array(say(role=F.col("role"), content=F.array(say(text=text), say(text=F.lit("end"))))), toolConfig=tool)),
    )
    which, body, provider = F.pmod(F.hash("conv_id", "turn"), F.lit(len(bodies))), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, value) in enumerate(bodies):
        body, provider = F.when(which == i, F.to_json(value)).otherwise(body), F.when(which == i, name).otherwise(provider)
    return turns.withColumns({"body": body, "provider": provider})


_query("scrub_json_all", "conversations")(lambda turns: X.scrub_json(_bodies(turns), "body").select("conv_id", "turn", "scrubbed"))
_query("scrub_json_by_provider", "conversations")(lambda turns: X.scrub_json(_provider_bodies(turns), "body", "provider").select("conv_id", "turn", "provider", "scrubbed"))
_query("mask_json_metadata_all", "conversations")(lambda turns: X.mask_json_metadata(_bodies(turns), "body").select("conv_id", "turn", "masked"))


def _payload() -> F.Column:
    return F.regexp_replace(F.base64(F.encode(F.repeat("text", 40), "UTF-8")), "[\r\n]", "")


@_query("strip_images_all", "conversations")
def strip_images_all(turns: DataFrame) -> DataFrame:
    body = F.concat_ws(" ", "text", _payload(), F.lit("end"))
    cut = X.strip_images(turns.withColumns({"body": body, "before": body}), "body")
    return X.unstrip_images(cut.withColumn("stripped", F.col("body")), "body").select("conv_id", "turn", "stripped", (F.col("body") == F.col("before")).alias("whole"))


@_query("extract_images_all", "conversations")
def extract_images_all(turns: DataFrame) -> DataFrame:
    part = F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("data:image/png;base64,"), _payload()).alias("url")).alias("image_url"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(part).alias("content"))).alias("messages")))
    return X.extract_images(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), body.alias("body")), "body", 1 << 20)


@_query("sql_spans", "documents", f"SELECT doc_id, v AS value, count(*) AS n FROM ({_FOUND}) y GROUP BY ALL")
def sql_spans(docs: DataFrame) -> DataFrame:
    """E-mail addresses as a table function gives them to SQL."""
    spark = docs.sparkSession
    register_all(spark)
    return spark.sql("SELECT doc_id, value, count(*) AS n FROM {docs}, LATERAL pii_spans(text) WHERE entity_type = 'EMAIL_ADDRESS' GROUP BY ALL", docs=docs.select("doc_id", "text"))


@_query("sql_redact_all", "documents")
def sql_redact_all(docs: DataFrame) -> DataFrame:
    """Whole texts redacted from SQL."""
    spark = docs.sparkSession
    register_all(spark)
    return spark.sql("SELECT doc_id, redact_text(text) AS redacted FROM {docs}", docs=docs.select("doc_id", "text"))
