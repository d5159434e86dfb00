"""Joins of traffic, keys, catalogues and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollhouse.operators.rollups import key_daily_series


def _names(table: DataFrame, *columns: str) -> DataFrame:
    """Rows of a catalogue by model name and by alias."""
    own = table.select("provider", F.col("model").alias("name"), F.col("model").alias("canonical"), *columns)
    alias = table.filter("alias <> ''").select("provider", F.col("alias").alias("name"), F.col("model").alias("canonical"), *columns)
    return own.unionByName(alias).dropDuplicates(["provider", "name"]).withColumnRenamed("name", "model")


def model_status(usage: DataFrame, catalog: DataFrame, retired: DataFrame) -> DataFrame:
    """``usage`` with status retired, deprecated, unknown or ok, the canonical name and the replacement."""
    known = _names(catalog, "deprecated", "replacement")
    gone = _names(retired, "replacement").select("provider", "model", F.col("canonical").alias("__gone"), F.col("replacement").alias("__next"))
    both = usage.join(known, ["provider", "model"], "left").join(gone, ["provider", "model"], "left")
    status = F.when(F.col("__gone").isNotNull(), "retired").when(F.col("deprecated"), "deprecated").when(F.col("canonical").isNull(), "unknown").otherwise("ok")
    return both.withColumn("status", status).withColumns(
        {"canonical": F.coalesce("__gone", "canonical", "model"), "replacement": F.coalesce("__next", "replacement", F.lit(""))}
    ).drop("__gone", "__next", "deprecated")


def retired_traffic(usage: DataFrame, retired: DataFrame) -> DataFrame:
    """Requests to retired models."""
    return usage.join(_names(retired), ["provider", "model"], "left_semi")


def unknown_traffic(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests to models that no catalogue lists."""
    return usage.join(_names(catalog), ["provider", "model"], "left_anti")


def key_usage_join(keys: DataFrame, cost: DataFrame, day: str) -> DataFrame:
    """``keys`` with spend and requests of one day, 0 for unused ones."""
    today = cost.filter(F.col("day") == F.lit(day).cast("date")).groupBy("key_id").agg(F.sum("total_e4").alias("spend_e4"), F.count("*").alias("requests"))
    return keys.join(today, "key_id", "left").fillna(0, ["spend_e4", "requests"])


def first_request_at(usage: DataFrame) -> DataFrame:
    """(key_id, first_request_at)."""
    return usage.filter("key_id <> ''").groupBy("key_id").agg(F.min("ts").alias("first_request_at"))


def credential_registry(scans: DataFrame, cost: DataFrame, bans: DataFrame) -> DataFrame:
    """Credentials seen in scans, in cost or banned, with sums, their sources and whether banned."""
    zero = F.lit(0).cast("long")
    parts = [
        scans.select("provider", "key_id", F.lit(1).cast("long").alias("s"), zero.alias("r"), zero.alias("e"), F.lit("pii").alias("source")),
        cost.select("provider", "key_id", zero.alias("s"), F.lit(1).cast("long").alias("r"), F.col("total_e4").alias("e"), F.lit("cost").alias("source")),
        bans.select("provider", "key_id", zero.alias("s"), zero.alias("r"), zero.alias("e"), F.lit("ban").alias("source")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("provider", "key_id").agg(
        F.sum("s").alias("pii_scans"), F.sum("r").alias("cost_requests"), F.sum("e").alias("spend_e4"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"), F.bool_or(F.col("source") == "ban").alias("banned")
    )


def masked_id_lookup(ids: DataFrame, keys: DataFrame) -> DataFrame:
    """``ids`` (prefix, hash) with the key of that hash whose name begins so, and how many match; none if ambiguous."""
    given = keys.select(F.col("key_id").alias("pk"), "hash")
    found = ids.join(given, "hash", "left").withColumn("__hit", F.col("pk").startswith(F.col("prefix")))
    return found.groupBy("prefix", "hash").agg(F.count(F.when(F.col("__hit"), 1)).alias("n_matches"), F.min(F.when(F.col("__hit"), F.col("pk"))).alias("pk")).withColumn("pk", F.when(F.col("n_matches") == 1, F.col("pk")))


def merge_snapshots_max(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Field-wise maxima of two snapshots of the same counters; a missing row counts as zeros."""
    left = a.select(*keys, *[F.col(f).alias(f"__a_{f}") for f in fields])
    right = b.select(*keys, *[F.col(f).alias(f"__b_{f}") for f in fields])
    both = left.join(right, keys, "full_outer")
    return both.select(*keys, *[F.greatest(F.coalesce(f"__a_{f}", F.lit(0)), F.coalesce(f"__b_{f}", F.lit(0))).alias(f) for f in fields])


def spend_limit_utilisation(keys: DataFrame, spend: DataFrame, limit: str = "daily_limit_cents") -> DataFrame:
    """``keys`` with percent (0 to 100) and level of their cap: normal, warning from 0.8, error from 0.95, unlimited without one."""
    rows = keys.join(spend.select("key_id", "spend_e4"), "key_id", "left").fillna(0, ["spend_e4"])
    share: Column = F.col("spend_e4") / (F.col(limit) * 100)
    level = F.when(F.col(limit) <= 0, "unlimited").when(share >= 0.95, "error").when(share >= 0.8, "warning").otherwise("normal")
    return rows.withColumns({"percent": F.when(F.col(limit) > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), share * 100))).otherwise(F.lit(0.0)), "level": level})


def keys_by_owner(keys: DataFrame, owner: str, provider: str | None = None) -> DataFrame:
    """Keys of an owner, of one provider if given."""
    mine = keys.filter(F.col("owner_email") == owner)
    return mine if provider is None else mine.filter(F.col("provider") == provider)


def backfill_key_limits(keys: DataFrame, from_cents: int, to_cents: int, dry_run: bool = True) -> DataFrame:
    """Personal keys whose monthly cap is ``from_cents``: listed, or all keys with theirs raised."""
    hit = F.col("personal") & (F.col("monthly_limit_cents") == from_cents)
    return keys.filter(hit) if dry_run else keys.withColumn("monthly_limit_cents", F.when(hit, to_cents).otherwise(F.col("monthly_limit_cents")))


def key_day_report(keys: DataFrame, cost: DataFrame, scans: DataFrame, day: str, series_days: int = 7) -> DataFrame:
    """One row a key: the day's and month's spend, the day's scans and the spend of the last days as an array."""
    at = F.lit(day).cast("date")
    per_day = cost.groupBy("key_id", "day").agg(F.sum("total_e4").alias("spend_e4"))
    today = per_day.filter(F.col("day") == at).select("key_id", F.col("spend_e4").alias("day_e4"))
    month = per_day.filter((F.date_trunc("month", "day") == F.date_trunc("month", at)) & (F.col("day") <= at)).groupBy("key_id").agg(F.sum("spend_e4").alias("month_e4"))
    seen = scans.filter(F.col("day") == at).groupBy("key_id").agg(F.count("*").alias("pii_scans"))
    series = key_daily_series(per_day, keys, "spend_e4", day, series_days).groupBy("key_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("day", "value"))), lambda x: x["value"].cast("string"))).alias("series"))
    out = keys.select("key_id", "provider").join(today, "key_id", "left").join(month, "key_id", "left").join(seen, "key_id", "left").join(series, "key_id", "left")
    return out.fillna(0, ["day_e4", "month_e4", "pii_scans"])


def key_policy(df: DataFrame, keys: DataFrame, global_flag: bool, column: str = "redact_pii") -> DataFrame:
    """``df`` with the key's own setting, else the global one, as ``flag``."""
    own = keys.select("key_id", F.col(column).alias("__own"))
    return df.join(own, "key_id", "left").withColumn("flag", F.coalesce("__own", F.lit(global_flag))).drop("__own")
