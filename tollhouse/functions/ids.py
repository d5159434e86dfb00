"""Masked ids, keys of breakers and scopes: column functions on built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Families of vendor keys, longest first (fixed values).
FAMILIES = ("sk-ant-api03-", "sk-ant-", "sk-proj-", "sk-svcacct-", "sk-or-", "sk-", "AIza", "AKIA", "ASIA", "gsk_", "xai-")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text in eight hexadecimal digits."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(2166136261).cast("long"), lambda a, b: (a.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def mask_key_id(key: Column) -> Column:
    """Short keys as they are, others as their first 12 characters, an ellipsis and the hash of the whole."""
    return F.when(F.length(key) <= 12, key).otherwise(F.concat(F.substring(key, 1, 12), F.lit("…"), fnv1a(key)))


def mask_provider_credential(key: Column) -> Column:
    """The longest known family prefix, else four characters, an ellipsis and the hash."""
    prefix = F.substring(key, 1, 4)
    for family in reversed(FAMILIES):
        prefix = F.when(key.startswith(family), F.lit(family)).otherwise(prefix)
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("")).otherwise(F.concat(prefix, F.lit("…"), fnv1a(key)))


def parse_masked_id(masked: Column) -> Column:
    """(prefix, hash) of a masked id with ``…`` or ``...``; nulls where the hash is not eight hexadecimal digits."""
    pattern = r"^(.*?)(?:…|\.\.\.)([0-9a-f]{8})$"
    hit = masked.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(masked, pattern, 1)).alias("prefix"), F.when(hit, F.regexp_extract(masked, pattern, 2)).alias("hash"))


def parse_breaker_key(key: Column) -> Column:
    """(provider, model, scope) of ``provider:model``; scope is ``provider`` without a model."""
    parts = F.split(key, ":", 2)
    model = F.when(F.size(parts) > 1, parts[1]).otherwise("")
    return F.struct(parts[0].alias("provider"), model.alias("model"), F.when(model == "", "provider").otherwise("model").alias("scope"))


def scope_kind_label(scope: Column) -> Column:
    """(kind, label) of a scope key; keys are masked and addresses cut."""
    kind = F.substring_index(scope, ":", 1)
    rest = F.regexp_replace(scope, r"^[^:]*:?", "")
    label = F.when(kind == "key", mask_key_id(rest)).when(rest.startswith("ip:"), F.concat(F.regexp_extract(rest, r"^(ip:\d+\.\d+)", 1), F.lit(".x.x"))).otherwise(rest)
    return F.struct(kind.alias("kind"), F.when(kind == scope, scope).otherwise(label).alias("label"))
