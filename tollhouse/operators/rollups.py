"""Rollups of cost and usage by UTC day, hour and month and by dimension.

Sums are over whole numbers and combine before the shuffle; a hot key costs one row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Measures of cost and the column that each sums; none: rows are counted.
MEASURES = {"spend_e4": "total_e4", "input_spend_e4": "input_e4", "output_spend_e4": "output_e4", "requests": None, "input_tokens": "input_tokens", "output_tokens": "output_tokens"}


def measures() -> list[Column]:
    """``MEASURES`` as aggregates."""
    return [(F.sum(c) if c else F.count("*")).alias(name) for name, c in MEASURES.items()]


def cost_totals_daily(cost: DataFrame) -> DataFrame:
    """Money, requests and tokens of each day."""
    return cost.groupBy("day").agg(*measures())


def cost_by(cost: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """The same by day and member of a dimension; empty members are left out."""
    return cost.filter((F.col(column) != "") & F.col(column).isNotNull()).groupBy("day", F.concat(F.lit(prefix), column).alias("member")).agg(*measures())


def cost_by_provider(cost: DataFrame) -> DataFrame:
    """By provider."""
    return cost_by(cost, "provider")


def cost_by_key(cost: DataFrame) -> DataFrame:
    """By key."""
    return cost_by(cost, "key_id")


def cost_by_user(cost: DataFrame) -> DataFrame:
    """By user, as ``user:<id>``."""
    return cost_by(cost, "user_id", "user:")


def _used(usage: DataFrame) -> DataFrame:
    return usage.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens")).filter("tokens > 0")


def usage_totals_daily(usage: DataFrame) -> DataFrame:
    """Requests and tokens of each day; requests without tokens do not count."""
    return _used(usage).groupBy("day").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def usage_grouping_sets(usage: DataFrame) -> DataFrame:
    """(day, dim, member, requests, tokens) of totals and every dimension.

    Aggregated once at the finest grain, then expanded: the rows that the grouping sets
    multiply are those of the aggregate, not of the log.
    """
    fine = _used(usage).groupBy("day", "model", "provider", "key_id", "user_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    sets = fine.groupingSets([("day",), ("day", "model"), ("day", "provider"), ("day", "key_id"), ("day", "user_id")], "day", "model", "provider", "key_id", "user_id").agg(
        F.sum("n").alias("requests"), F.sum("t").alias("tokens"), *[F.grouping(c).alias(f"g_{c}") for c in ("model", "provider", "key_id", "user_id")]
    )
    dim, member = F.lit("total"), F.lit("")
    for c, name in (("model", "model"), ("provider", "provider"), ("key_id", "key"), ("user_id", "user")):
        dim = F.when(F.col(f"g_{c}") == 0, name).otherwise(dim)
        member = F.when(F.col(f"g_{c}") == 0, F.when(F.col(c) == "", "").otherwise(F.concat(F.lit(f"{name}:"), c))).otherwise(member)
    return sets.select("day", dim.alias("dim"), member.alias("member"), "requests", "tokens").filter("dim = 'total' OR member <> ''")


def usage_by_scope(usage: DataFrame) -> DataFrame:
    """The dimensions of ``usage_grouping_sets`` without totals."""
    return usage_grouping_sets(usage).filter("dim <> 'total'").drop("dim")


def rollup_hourly(cost: DataFrame, metric: str = "cost") -> DataFrame:
    """Totals of each hour."""
    return cost.groupBy("day", "hour").agg(*measures()).withColumn("metric", F.lit(metric))


def rollup_monthly_key_spend(cost: DataFrame) -> DataFrame:
    """Spend of each key and month."""
    return cost.filter("key_id <> ''").groupBy(F.date_format("day", "yyyy-MM").alias("month"), "key_id").agg(F.sum("total_e4").alias("spend_e4"))


def long_form(wide: DataFrame, metric: str, dim: str, member: str | None, fields: list[str]) -> DataFrame:
    """(metric, day, dim, member, field, value) of a wide rollup."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("value")) for f in fields])).alias("p")
    return wide.select(F.lit(metric).alias("metric"), "day", F.lit(dim).alias("dim"), (F.col(member) if member else F.lit("")).alias("member"), pairs).select("metric", "day", "dim", "member", "p.field", "p.value")


def merge_deltas(*deltas: DataFrame) -> DataFrame:
    """Sums of additive deltas of many writers."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), deltas)
    return both.groupBy("metric", "day", "dim", "member", "field").agg(F.sum("value").alias("value"))


def split_member_field(deltas: DataFrame, fields: list[str], column: str = "member_field") -> DataFrame:
    """``member|field`` parted at the first bar, fields as columns."""
    parted = deltas.withColumn("member", F.substring_index(column, "|", 1)).withColumn("field", F.expr(f"substring(`{column}`, length(member) + 2)"))
    return parted.groupBy("metric", "day", "dim", "member").pivot("field", fields).agg(F.sum("value"))


def topn(df: DataFrame, by: list[str], value: str, name: str, n: int) -> DataFrame:
    """The ``n`` largest members of each group, ties by name; all if ``n`` is not positive."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), name)))
    return ranked.filter(F.col("rank") <= n) if n > 0 else ranked


def topn_with_other(df: DataFrame, by: list[str], value: str, name: str, n: int, kind: str) -> DataFrame:
    """The ``n`` largest members and the sum of the rest as ``other_<kind>``; ``df`` is an aggregate."""
    ranked = topn(df, by, value, name, 0)
    label = F.when(F.col("rank") <= n, F.col(name)).otherwise(F.lit(f"other_{kind}")) if n > 0 else F.col(name)
    return ranked.groupBy(*by, label.alias(name)).agg(F.sum(value).alias(value))


def topn_collapse_all_measures(df: DataFrame, name: str, value: str, measures: list[str], n: int = 10) -> DataFrame:
    """The display form: the rest under ``(and k others)`` with all its measures summed.

    ``df`` is an aggregate, a row a member.  The ``n`` largest are a limit, and so small
    enough to broadcast; nothing sorts all members.  A null member among them keeps its row.
    """
    top = df.orderBy(F.desc(value), name).limit(n).select(F.struct(F.col(name).alias("name")).alias("__top"))
    marked = df.join(F.broadcast(top), F.col(name).eqNullSafe(F.col("__top.name")), "left")
    folded = marked.groupBy("__top").agg(*[F.sum(m).alias(m) for m in measures], F.count("*").alias("__k"))
    others = F.concat(F.lit("(and "), F.col("__k").cast("string"), F.lit(" others)"))
    return folded.select(F.when(F.col("__top").isNull(), others).otherwise(F.col("__top.name")).alias(name), *measures)


def donut_slices(df: DataFrame, name: str, value: str, n: int = 8) -> DataFrame:
    """The ``n`` largest members and the sum of the rest."""
    return topn_collapse_all_measures(df, name, value, [value], n)


def share_of_total(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` with each positive member's share of its group."""
    return df.filter(F.col(value) > 0).withColumn("share", F.col(value) / F.sum(value).over(W.partitionBy(*by)))


def last_days(daily: DataFrame, last_n: int) -> DataFrame:
    """Rows of the last ``last_n`` days that are there (not calendar days)."""
    days = daily.select("day").distinct().withColumn("__rn", F.row_number().over(W.orderBy(F.desc("day")))).filter(F.col("__rn") <= last_n).select("day")
    return daily.join(days, "day", "left_semi")


def range_totals(daily: DataFrame, fields: list[str], last_n: int) -> DataFrame:
    """Sums over the last days present."""
    return last_days(daily, last_n).agg(*[F.sum(f).alias(f) for f in fields])


def range_peaks(daily: DataFrame, fields: list[str], last_n: int) -> DataFrame:
    """Maxima over the last days present."""
    return last_days(daily, last_n).agg(*[F.max(f).alias(f) for f in fields])


def range_by(daily: DataFrame, member: str, fields: list[str], last_n: int) -> DataFrame:
    """Sums by member over the last days present."""
    return last_days(daily, last_n).groupBy(member).agg(*[F.sum(f).alias(f) for f in fields])


def range_detection_rate(daily: DataFrame, last_n: int) -> DataFrame:
    """Scans with findings among scans that did not fail, over the last days present."""
    sums = range_totals(daily, ["requests_scanned", "requests_with_pii", "fail_open", "fail_closed", "oversize"], last_n)
    scanned = F.col("requests_scanned") - F.col("fail_open") - F.col("fail_closed") - F.col("oversize")
    return sums.select(F.when(scanned > 0, F.col("requests_with_pii") / scanned).otherwise(F.lit(0.0)).alias("rate"))


def key_daily_series(daily: DataFrame, keys: DataFrame, value: str, end_day: str, days: int = 7) -> DataFrame:
    """(key_id, day, value) of each key and each of the last ``days`` days, 0 where nothing is."""
    calendar = F.explode(F.sequence(F.date_sub(F.lit(end_day).cast("date"), days - 1), F.lit(end_day).cast("date")))
    grid = keys.select("key_id").distinct().withColumn("day", calendar)
    return grid.join(daily.select("key_id", "day", F.col(value).alias("value")), ["key_id", "day"], "left").fillna(0, ["value"])


def daily_history(daily: DataFrame, end_day: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` calendar days; days without data are absent."""
    return daily.filter((F.col("day") <= F.lit(end_day).cast("date")) & (F.col("day") > F.date_sub(F.lit(end_day).cast("date"), days)))


def recent_events(df: DataFrame, n: int = 50, by: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows, of each group if any, newest first."""
    if not by:
        return df.orderBy(F.desc("ts"), F.desc("request_id")).limit(n)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts"), F.desc("request_id")))).filter(F.col("rank") <= n)


def circuit_peaks(snaps: DataFrame, bucket: list[str]) -> DataFrame:
    """Of a gauge, per bucket and provider: largest failures, whether ever open, and the last state."""
    return snaps.groupBy(*bucket, "provider").agg(F.max("failures").alias("failures"), F.bool_or("rollup_open").alias("rollup_open"), F.max_by("state", F.struct("ts", "request_id")).alias("state"))


def provider_failure_series(peaks: DataFrame, providers: list[str]) -> DataFrame:
    """Days by providers of failures, 0 where none."""
    return peaks.groupBy("day").pivot("provider", providers).agg(F.max("failures")).fillna(0)
