"""Prices, costs and token estimates.

Prices are small tables (a row a provider, model and tier): their joins need no shuffle of
the requests where Spark finds them small enough to broadcast.  Money is kept as whole
ten-thousandths of a dollar (``*_e4``), so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pricing_rows(config: DataFrame) -> DataFrame:
    """(provider, model, tier_no, threshold, price_in, price_out) of rows (provider, model, tiers array<struct<threshold, input, output>>)."""
    return config.select("provider", "model", F.posexplode("tiers").alias("tier_no", "t")).select("provider", "model", "tier_no", F.col("t.threshold").alias("threshold"), F.col("t.input").alias("price_in"), F.col("t.output").alias("price_out"))


def tier_lists(pricing: DataFrame) -> DataFrame:
    """One row per provider and model with its tiers in listed order: a join then never multiplies requests."""
    tier = F.struct("tier_no", "threshold", "price_in", "price_out")
    return pricing.groupBy("provider", "model").agg(F.array_sort(F.collect_list(tier)).alias("tiers"))


def resolve_alias(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """``usage`` with ``canonical``: the model itself where listed, else the one that has it as an alias, else its own name."""
    names = catalog.select("provider", F.col("model").alias("name"), "model").unionByName(catalog.select("provider", F.col("alias").alias("name"), "model"))
    names = names.filter("name <> ''").groupBy("provider", F.col("name")).agg(F.max(F.struct((F.col("name") == F.col("model")).alias("own"), "model")).alias("m"))
    found = names.select("provider", F.col("name").alias("model"), F.col("m.model").alias("canonical"))
    return usage.join(found, ["provider", "model"], "left").withColumn("canonical", F.coalesce("canonical", "model"))


def _tier(tiers: Column, tokens: Column) -> Column:
    return F.filter(tiers, lambda t: (t["threshold"] == 0) | (tokens <= t["threshold"]))[0]


def price_tiered(usage: DataFrame, pricing: DataFrame, order: str = "listed", model_col: str = "model") -> DataFrame:
    """``usage`` with the first tier that takes its input tokens; ``order="descending"`` looks from the highest threshold down, 0 last."""
    lists = tier_lists(pricing).withColumnRenamed("model", model_col)
    if order == "descending":
        lists = lists.withColumn("tiers", F.array_sort("tiers", lambda a, b: (b["threshold"] - a["threshold"]).cast("int")))
    priced = usage.join(lists, ["provider", model_col], "left").withColumn("__t", F.when(F.size("tiers") > 0, F.get(F.filter("tiers", lambda t: (t["threshold"] == 0) | (F.col("input_tokens") <= t["threshold"])), F.lit(0))))
    return priced.withColumns({"price_in": F.col("__t.price_in"), "price_out": F.col("__t.price_out")}).drop("tiers", "__t")


def price_tiered_desc(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """``price_tiered`` from the highest threshold down."""
    return price_tiered(usage, pricing, "descending")


def price_exact(usage: DataFrame, pricing: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``usage`` with the price of exactly its model; an override for the name beats the tiers."""
    priced = price_tiered(usage, pricing)
    if overrides is None:
        return priced
    own = overrides.select("provider", "model", F.col("price_in").alias("__in"), F.col("price_out").alias("__out"))
    return priced.join(own, ["provider", "model"], "left").withColumns({"price_in": F.coalesce("__in", "price_in"), "price_out": F.coalesce("__out", "price_out")}).drop("__in", "__out")


def fuzzy_model_match(models: DataFrame, catalog: DataFrame, tenths: int = 7) -> DataFrame:
    """(provider, model, matched_model, distance): the most similar listed name, if similarity is ``tenths`` / 10 or more; ties by name.

    Runs over distinct names, never over requests.
    """
    names = models.select("provider", "model").distinct()
    listed = catalog.select("provider", F.col("model").alias("matched_model")).distinct()
    pairs = names.join(listed, "provider").withColumn("distance", F.levenshtein(F.lower("model"), F.lower("matched_model"))).withColumn("__l", F.greatest(F.length("model"), F.length("matched_model")))
    close = pairs.filter(10 * (F.col("__l") - F.col("distance")) >= tenths * F.col("__l"))
    best = W.partitionBy("provider", "model").orderBy(F.desc((F.col("__l") - F.col("distance")) / F.col("__l")), "matched_model")
    return close.withColumn("__rn", F.row_number().over(best)).filter("__rn = 1").select("provider", "model", "matched_model", "distance")


def price_with_fallback(usage: DataFrame, pricing: DataFrame, catalog: DataFrame) -> DataFrame:
    """``usage`` with matched_model, is_estimate and prices: alias or exact first, then fuzzy, else none."""
    names = resolve_alias(usage.select("provider", "model").distinct(), catalog)
    listed = pricing.select("provider", F.col("model").alias("canonical")).distinct()
    exact = names.join(listed, ["provider", "canonical"], "left_semi").select("provider", "model", F.col("canonical").alias("matched_model"), F.lit(False).alias("is_estimate"))
    rest = names.join(listed, ["provider", "canonical"], "left_anti").select("provider", "model")
    near = fuzzy_model_match(rest, pricing).select("provider", "model", "matched_model", F.lit(True).alias("is_estimate"))
    matched = usage.join(exact.unionByName(near), ["provider", "model"], "left").withColumn("is_estimate", F.coalesce("is_estimate", F.lit(False)))
    return price_tiered(matched, pricing, model_col="matched_model")


def request_cost(priced: DataFrame) -> DataFrame:
    """``priced`` with input_e4, output_e4 and total_e4, each rounded up by itself; unpriced requests cost 0."""
    one = F.col("input_tokens") / F.lit(1e6) * F.col("price_in")
    two = F.col("output_tokens") / F.lit(1e6) * F.col("price_out")
    up = lambda c: F.ceil(F.coalesce(c, F.lit(0.0)) * F.lit(1e4)).cast("long")
    return priced.withColumns({"input_e4": up(one), "output_e4": up(two), "total_e4": up(one + two)})


def cost_records(usage: DataFrame, pricing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Full cost rows; an unpriced model has an empty matched_model."""
    return request_cost(price_with_fallback(usage, pricing, catalog)).withColumns({"matched_model": F.coalesce("matched_model", F.lit("")), "total_tokens": F.col("input_tokens") + F.col("output_tokens")})


def cost_reconcile(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts and totals of two sets of cost rows, side by side."""
    one = observed.agg(F.count("*").alias("n_obs"), F.coalesce(F.sum("total_e4"), F.lit(0)).alias("total_obs"))
    two = expected.agg(F.count("*").alias("n_exp"), F.coalesce(F.sum("total_e4"), F.lit(0)).alias("total_exp"))
    return one.crossJoin(two)


def estimate_tokens(df: DataFrame, chars_col: str, bytes_col: str, chars_per_token: int = 4, bytes_per_token: int = 4, max_sample: int = 200_000) -> DataFrame:
    """``df`` with est_tokens: characters of the messages, else bytes of the body, per token; long bodies by bytes alone."""
    chars = F.when(F.col(bytes_col) <= max_sample, F.expr(f"`{chars_col}` div {chars_per_token}"))
    return df.withColumn("est_tokens", F.when(chars > 0, chars).otherwise(F.expr(f"`{bytes_col}` div {bytes_per_token}")))


def token_stats(df: DataFrame, by: list[str], tokens: str = "tokens", chars: str = "chars") -> DataFrame:
    """Mean, median (element n // 2), 95th percentile (element ceil(0.95 n) - 1), population deviation and tokens per 1,000 characters.

    Rows are counted per group and value before they move; ranks are running counts over the
    distinct values, so a group is as large as its values differ.  Null values stand first in
    rank and count in nothing else.
    """
    w = W.partitionBy(*by)
    counted = df.groupBy(*by, tokens).agg(F.count("*").alias("__n"), F.sum(chars).alias("__chars"))
    placed = counted.withColumns({
        "__upto": F.sum("__n").over(w.orderBy(tokens)),
        "__all": F.sum("__n").over(w),
        "__known": F.when(F.col(tokens).isNotNull(), F.col("__n")),
        "__sum": F.col(tokens) * F.col("__n"),
    })
    placed = placed.withColumn("__mean", F.sum("__sum").over(w) / F.sum("__known").over(w))
    at = lambda place: F.max(F.when((F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place), F.col(tokens)))
    return placed.groupBy(*by).agg(
        F.first("__mean").alias("mean"),
        at(F.expr("__all div 2")).alias("p50"),
        at(F.expr("(95 * __all + 99) div 100 - 1")).alias("p95"),
        F.sqrt(F.sum(F.col("__n") * F.pow(F.col(tokens) - F.col("__mean"), 2)) / F.sum("__known")).alias("stdev"),
        (F.sum("__sum") * 1000 / F.sum("__chars")).alias("per_1k_chars"),
    )


def estimate_request_cost(df: DataFrame, pricing: DataFrame, catalog: DataFrame, out_tokens: int = 1024) -> DataFrame:
    """``df`` with est_e4: the cost of its estimated input and an assumed output."""
    assumed = df.withColumns({"__in": F.col("input_tokens"), "__out": F.col("output_tokens"), "input_tokens": F.col("est_tokens"), "output_tokens": F.lit(out_tokens).cast("long")})
    return request_cost(price_with_fallback(assumed, pricing, catalog)).withColumns({"est_e4": F.col("total_e4"), "input_tokens": F.col("__in"), "output_tokens": F.col("__out")}).drop("__in", "__out", "input_e4", "output_e4", "total_e4")


def reconcile_request_cost(df: DataFrame) -> DataFrame:
    """``df`` (status, tokens, est_e4, total_e4) with actual_e4: nothing for server faults, the estimate without token counts, else the cost."""
    return df.withColumn("actual_e4", F.when(F.col("status") >= 500, 0).when(F.col("input_tokens") + F.col("output_tokens") <= 0, F.col("est_e4")).otherwise(F.col("total_e4")).cast("long"))
