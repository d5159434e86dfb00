"""Detection, redaction, scrubbing and restoration of personal data in text columns.

Texts go through vectorised helpers; filters, counts and joins around them are built in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tollhouse.functions import pii
from tollhouse.operators.replay import replayed

SPANS = "array<struct<start:int,end:int,entity_type:string,score:double>>"
REGISTRY = "array<struct<placeholder:string,original:string,policy:string>>"
MAX_BYTES = 1 << 20
#: Rows that are Python objects at a time, whatever batches Spark makes.
SLICE = 64


def _rowwise(helper: Callable, returned: str, *columns: Column) -> Column:
    """``helper`` of the values of a row, over slices of Arrow batches: a task never holds a whole batch as Python objects."""
    made = to_arrow_type(StructType.fromDDL(f"r {returned}")["r"].dataType)
    given = len(columns)

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in parts:
            for i in range(0, len(arrays[0]), SLICE):
                rows = zip(*(a.slice(i, SLICE).to_pylist() for a in arrays), strict=True)
                yield pa.array([helper(*r[:given]) for r in rows], made)

    run.__name__ = helper.__name__
    # A second column at least, as the function takes tuples.
    return F.arrow_udf(run, returned)(*columns, *([F.lit(None).cast("boolean")] if given == 1 else []))


def _records(x) -> list[dict]:
    return [] if x is None else [r.asDict() if hasattr(r, "asDict") else dict(r) for r in x]


def entity_allowlist(requested: Column) -> Column:
    """Requested entity types in scope; all types if none is."""
    scope = F.array(*map(F.lit, pii.POLICY))
    kept = F.array_intersect(requested, scope)
    return F.when(F.size(kept) > 0, kept).otherwise(scope)


def pii_detect(df: DataFrame, text_col: str, entities: list[str] | None = None, extra_spans: str | None = None) -> DataFrame:
    """``df`` with spans of the pattern entities and those of the column ``extra_spans``; null texts have none."""
    found = _rowwise(lambda t: pii.detect(t or "", entities), SPANS, F.col(text_col))
    return df.withColumn("spans", F.concat(found, F.coalesce(F.col(extra_spans), F.array().cast(SPANS))) if extra_spans else found)


def span_threshold(df: DataFrame, text_col: str, least: float = pii.MIN_SCORE) -> DataFrame:
    """``df`` with the spans of sufficient score and valid offsets."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn("spans", F.filter("spans", lambda s: (s["score"] >= least) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n)))


def exploded(df: DataFrame, text_col: str) -> DataFrame:
    """One row per span with its ``value``."""
    rows = df.withColumn("span", F.explode("spans"))
    return rows.withColumn("value", F.substr(F.col(text_col), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")))


def allow_middle_ground(rows: DataFrame, allow_test_emails: bool = True) -> DataFrame:
    """Rows of (value, span) with allowed and reason, on built-ins."""
    v, kind = F.lower(F.trim("value")), F.col("span.entity_type")
    street = F.lit(False)
    for t in pii._STREET:
        street = street | v.contains(t)
    private = v.rlike(r"^(localhost(:\d+)?|\[?::1\]?|\[?f[cd][0-9a-f]{0,2}:[0-9a-f:]*\]?|(10|127)(\.\d{1,3}){3}(:\d+)?|192\.168(\.\d{1,3}){2}(:\d+)?|172\.(1[6-9]|2\d|3[01])(\.\d{1,3}){2}(:\d+)?)$")
    test = v.startswith("test@") | v.startswith("dev@")
    for d in pii._TEST_DOMAINS:
        test = test | v.endswith(d)
    reason = (
        F.when((kind == "PERSON") & (F.size(F.split(F.trim("value"), r"\s+")) < 2), "single_token_person")
        .when((kind == "LOCATION") & ~(v.rlike("[0-9]") & street), "non_street_location")
        .when((kind == "IP_ADDRESS") & private, "private_ip")
        .when((kind == "EMAIL_ADDRESS") & test & F.lit(allow_test_emails), "test_email")
        .otherwise("")
    )
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason") != "")


def resolve_overlaps(df: DataFrame) -> DataFrame:
    """``df`` with spans that do not overlap."""
    return df.withColumn("spans", _rowwise(lambda s: pii.resolve(_records(s)), SPANS, F.col("spans")))


def redact_text(df: DataFrame, text_col: str, extra_spans: str | None = None) -> DataFrame:
    """``df`` with redacted, entity_counts and changed; null texts stay null."""

    def run(text: str | None, extra: list | None) -> dict:
        spans = [] if text is None else pii.final_spans(text, _records(extra))
        counts = Counter(s["entity_type"] for s in spans)
        return {"redacted": None if text is None else pii.redact(text, spans), "entity_counts": list(counts.items()), "changed": bool(spans)}

    extra = F.col(extra_spans) if extra_spans else F.lit(None).cast(SPANS)
    return df.withColumn("__r", _rowwise(run, "struct<redacted:string,entity_counts:map<string,int>,changed:boolean>", F.col(text_col), extra)).select(*[c for c in df.columns if c not in ("redacted", "entity_counts", "changed")], "__r.*")


def scrub_text(df: DataFrame, text_col: str, helper: Callable[[str, pii.Registry], str] = pii.scrub) -> DataFrame:
    """``df`` with scrubbed text and the registry of its placeholders, each row by itself."""

    def run(text: str | None) -> dict:
        registry = pii.Registry()
        return {"scrubbed": None if text is None else helper(text, registry), "registry": registry.rows()}

    scrubbed = _rowwise(run, f"struct<scrubbed:string,registry:{REGISTRY}>", F.col(text_col))
    return df.withColumn("__r", scrubbed).select(*[c for c in df.columns if c not in ("scrubbed", "registry")], "__r.*")


def scrub_json(df: DataFrame, body_col: str, provider_col: str | None = None) -> DataFrame:
    """``df`` with request bodies scrubbed where their provider's format holds text of users, and the registry of placeholders.

    Bodies are taken apart into such texts; each different text of the table is analysed
    once, whatever bodies have it; then bodies are put together again with the spans found.
    Without a provider, or one that is not known, the fields of all providers count.  A body that
    is not JSON, or is a single value, is a text; null stays null.  Equal bodies of a
    provider are taken apart once.
    """

    def leaves(body: str | None, provider: str | None) -> list[dict]:
        found = [] if body is None else pii.json_leaves(body, provider)[1]
        return [{"at": i, "text": text, "object": is_object} for i, (_, _, text, is_object) in enumerate(found)]

    def analysed(text: str, is_object: bool) -> list[dict]:
        return pii.leaf_spans(text, is_object)

    def put(body: str | None, provider: str | None, spans: list[dict]) -> dict:
        registry = pii.Registry()
        scrubbed = None if body is None else pii.put_leaves(body, provider, [x["spans"] for x in spans], registry)
        return {"scrubbed": scrubbed, "registry": registry.rows()}

    own = [c for c in df.columns if c not in ("scrubbed", "registry")]
    provider = F.col(provider_col) if provider_col else F.lit(None).cast("string")
    key = F.sha2(F.concat(F.coalesce(provider, F.lit("")), F.lit("\x00"), F.col(body_col)), 256)
    keyed = df.select(*own).withColumns({"__body": key, "__provider": provider})
    parts = keyed.filter(F.col(body_col).isNotNull()).select("__body", F.explode(_rowwise(leaves, "array<struct<at:int,text:string,object:boolean>>", F.col(body_col), F.col("__provider"))).alias("l"))
    parts = parts.select("__body", "l.at", "l.text", "l.object", F.sha2(F.concat(F.col("l.object").cast("string"), F.col("l.text")), 256).alias("__text"))
    once = parts.select("__text", "text", "object").dropDuplicates(["__text"]).select("__text", _rowwise(analysed, SPANS, F.col("text"), F.col("object")).alias("spans"))
    places = parts.select("__body", "at", "__text").distinct()
    found = places.join(once, "__text").groupBy("__body").agg(F.sort_array(F.collect_list(F.struct("at", "spans"))).alias("__spans"))
    spans = F.coalesce("__spans", F.array().cast(f"array<struct<at:int,spans:{SPANS}>>"))
    joined = keyed.join(found, "__body", "left").withColumn("__r", _rowwise(put, f"struct<scrubbed:string,registry:{REGISTRY}>", F.col(body_col), F.col("__provider"), spans))
    return joined.select(*own, "__r.*")


def scrub_conversation(df: DataFrame, conv_col: str, order_col: str, text_col: str) -> DataFrame:
    """(conversation, turn, scrubbed, registry, originals): a placeholder stands for one original through a conversation.

    ``registry`` has the placeholders of the turn itself; those of all turns are the
    conversation's.  ``originals`` counts the conversation's up to this turn.  Turns stream in
    order of ``order_col`` (ties by text), so a task holds a conversation's originals and none
    of its turns.  Null texts stay null; turns without a conversation are one conversation.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (conv_col, order_col)}

    def fresh() -> Callable[[tuple], tuple]:
        registry = pii.Registry()

        def decide(row: tuple) -> tuple:
            conv, order, text = (v if v == v else None for v in row)
            scrubbed = None if text is None else pii.scrub(text, registry)
            return conv, order, scrubbed, registry.taken(), len(registry.known)

        return decide

    schema = f"__conv {kinds[conv_col]}, __turn {kinds[order_col]}, scrubbed string, registry {REGISTRY}, originals int"
    turns = df.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("turn"), F.col(text_col).alias("text"))
    return replayed(turns, ["conv"], ["turn", "text"], fresh, schema).withColumnsRenamed({"__conv": conv_col, "__turn": order_col})


def restore_text(df: DataFrame, text_col: str, registry_col: str = "registry", json_escape: bool = False) -> DataFrame:
    """``df`` with restored and restored_count."""

    def run(text: str | None, registry: list | None) -> dict:
        restored, n = (None, 0) if text is None else pii.restore(text, _records(registry), json_escape)
        return {"restored": restored, "restored_count": n}

    back = _rowwise(run, "struct<restored:string,restored_count:int>", F.col(text_col), F.col(registry_col))
    return df.withColumn("__r", back).select(*[c for c in df.columns if c not in ("restored", "restored_count")], "__r.*")


def leak_check(df: DataFrame, text_col: str, registry_col: str = "registry") -> DataFrame:
    """``df`` with leaked: MASK placeholders that are still there."""

    left = _rowwise(lambda t, r: 0 if t is None else pii.leaked(t, _records(r)), "int", F.col(text_col), F.col(registry_col))
    return df.withColumn("leaked", left)


def reformat_placeholders(text: Column, open_: str, close: str, spaced: bool = False) -> Column:
    """Placeholders in other delimiters."""
    gap = " " if spaced else ""
    return F.regexp_replace(text, r"<(PII_[A-Z][A-Z0-9_]*_[0-9]+)>", f"{'' if open_.isalnum() else chr(92)}{open_}{gap}$1{gap}{close}")


def dedupe_analyze(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with spans, each different text analysed once; the text is keyed by its SHA-256."""
    keyed = df.withColumn("__k", F.sha2(F.col(text_col), 256))
    once = pii_detect(keyed.select("__k", text_col).dropDuplicates(["__k"]), text_col).select("__k", "spans")
    return keyed.join(once, "__k", "left").drop("__k")


def scan_outcome(df: DataFrame, text_col: str, failed: Column, max_bytes: int = MAX_BYTES, fail_mode: str = "open") -> DataFrame:
    """``df`` with outcome: oversize, fail_open or fail_closed for failed scans, else ok."""
    return df.withColumn("outcome", F.when(F.octet_length(text_col) > max_bytes, "oversize").when(failed, f"fail_{fail_mode}").otherwise("ok"))


def scanned_text(df: DataFrame, text_col: str, outcome_col: str = "outcome") -> DataFrame:
    """``df`` with its text only where the scan went well: what was too long or failed has no findings."""
    return df.withColumn(text_col, F.when(F.col(outcome_col) == "ok", F.col(text_col)))


def gov_id_gate(images: DataFrame, least: float = 0.4) -> DataFrame:
    """(request_id, outcome, entity_type, score) of rows (request_id, text, error): a passport or licence blocks, whatever else failed."""
    spans = pii_detect(images, "text", ["US_PASSPORT", "US_DRIVER_LICENSE"])
    hit = F.array_max(F.transform(F.filter("spans", lambda s: s["score"] >= least), lambda s: F.struct(s["score"], s["entity_type"])))
    best = spans.withColumn("hit", hit).groupBy("request_id").agg(F.max("hit").alias("hit"), F.bool_or("error").alias("error"))
    outcome = F.when(F.col("hit").isNotNull(), "blocked").when(F.col("error"), "fail_open").otherwise("cleared")
    return best.select("request_id", outcome.alias("outcome"), F.coalesce("hit.entity_type", F.lit("")).alias("entity_type"), F.coalesce("hit.score", F.lit(0.0)).alias("score"))


def extract_images(df: DataFrame, body_col: str, max_bytes: int) -> DataFrame:
    """(request_id, index, bytes) of base64 images in request bodies."""

    found = _rowwise(lambda b: pii.images(b or "", max_bytes), "array<string>", F.col(body_col))
    return df.select("request_id", F.posexplode(found).alias("index", "data")).select("request_id", "index", F.unbase64("data").alias("bytes"))


def strip_images(df: DataFrame, body_col: str) -> DataFrame:
    """``df`` with long base64 payloads cut out as numbered sentinels and kept in ``images``, for ``unstrip_images``."""
    pattern = "[A-Za-z0-9+/]{1024,}={0,2}"
    return df.withColumn("images", F.regexp_extract_all(body_col, F.lit(f"({pattern})"), 1)).withColumn(body_col, F.regexp_replace(body_col, pattern, "__IMAGE__"))


def unstrip_images(df: DataFrame, body_col: str) -> DataFrame:
    """Puts the payloads of ``strip_images`` back in order."""
    parts = F.split(body_col, "__IMAGE__")
    woven = F.zip_with(parts, "images", lambda p, i: F.concat(p, F.coalesce(i, F.lit(""))))
    return df.withColumn(body_col, F.array_join(woven, "")).drop("images")


def mask_json_metadata(df: DataFrame, body_col: str) -> DataFrame:
    """``df`` with keys and schema strings of JSON bodies blanked, offsets kept, as ``masked``."""

    return df.withColumn("masked", _rowwise(lambda b: None if b is None else pii.mask_json_metadata(b), "string", F.col(body_col)))


def tier_of(kind: Column) -> Column:
    """MASK, SEAL or REDACT of an entity type."""
    out = F.lit("REDACT")
    for k, tier in pii.POLICY.items():
        out = F.when(kind == k, tier).otherwise(out)
    return out


def pii_tier_counts(df: DataFrame, counts_col: str) -> DataFrame:
    """``df`` with masked, sealed, redacted and detected of a map of entity counts."""
    entries = F.map_entries(F.col(counts_col))
    total = lambda tier: F.aggregate(F.filter(entries, lambda e: tier_of(e["key"]) == tier), F.lit(0), lambda a, e: a + e["value"])
    return df.withColumns({"masked": total("MASK"), "sealed": total("SEAL"), "redacted": total("REDACT")}).withColumn("detected", F.col("masked") + F.col("sealed") + F.col("redacted"))


# Rollups of scans (day, provider, key_id, entity_counts, outcome)


def pii_daily(scans: DataFrame) -> DataFrame:
    """Scans, findings and failures of each day, and the share of scans with findings."""
    total = F.aggregate(F.map_values("entity_counts"), F.lit(0), lambda a, v: a + v)
    n = lambda c: F.count(F.when(c, 1))
    out = scans.withColumn("__t", F.coalesce(total, F.lit(0))).groupBy("day").agg(
        F.count("*").alias("requests_scanned"), n(F.col("__t") > 0).alias("requests_with_pii"), F.sum("__t").cast("long").alias("entities_total"), *[n(F.col("outcome") == o).alias(o) for o in ("fail_open", "fail_closed", "oversize")]
    )
    good = F.col("requests_scanned") - F.col("fail_open") - F.col("fail_closed") - F.col("oversize")
    return out.withColumn("detection_rate", F.when(good > 0, F.col("requests_with_pii") / good).otherwise(F.lit(0.0)))


def pii_by_entity(scans: DataFrame) -> DataFrame:
    """Entities found per day and type."""
    return scans.select("day", F.explode("entity_counts").alias("name", "n")).groupBy("day", "name").agg(F.sum("n").cast("long").alias("count"))


def pii_by(scans: DataFrame, column: str) -> DataFrame:
    """Scans per day and member, empty ones left out."""
    return scans.filter(F.col(column) != "").groupBy("day", F.col(column).alias("name")).agg(F.count("*").alias("count"))


def id_gate_daily(gate: DataFrame) -> DataFrame:
    """Outcomes of the gate per day."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    return gate.groupBy("day").agg(F.count("*").alias("with_images"), n("blocked"), n("cleared"), n("fail_open"))


