"""Deterministic identifiers and keyed pseudonyms, all from native hash functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def short_sha(text: Column, digits: int = 20) -> Column:
    return F.upper(F.substring(F.sha2(text, 256), 1, digits))


def pair_id(zone: Column, left_kind: Column, left_id: Column, right_kind: Column, right_id: Column, prefix: str = "PAIR-") -> Column:
    return F.concat(F.lit(prefix), short_sha(F.concat_ws("|", zone, F.concat_ws(":", left_kind, left_id), F.concat_ws(":", right_kind, right_id))))


def correlation_id(scenario: Column, scope: Column, entity: Column, event_ids: Column) -> Column:
    return F.concat_ws("-", F.lit("CORR"), scenario, scope, entity, F.array_join(F.array_sort(F.array_distinct(event_ids)), "-"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a text column, composed from sha2 over binary concatenation."""
    import hashlib
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    pad = lambda byte: F.unhex(F.lit(bytes(b ^ byte for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def pseudonym(key: bytes, prefix: str, value: Column) -> Column:
    """PREFIX-XXXXXXXXXX; blank, NONE and UNKNOWN stay as they are."""
    keep = value.isNull() | F.upper(value).isin("", "UNKNOWN", "NONE")
    token = F.concat(F.lit(prefix + "-"), F.upper(F.substring(hmac_sha256(key, F.concat(F.lit(prefix + ":"), value)), 1, 10)))
    return F.when(keep, value).otherwise(token)


# Identifier patterns in free text.
IPV4_WORD = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PERSON_WORD = r"\bP\d{3,8}\b"


def mask_text(key: bytes, text: Column) -> Column:
    """Free text with addresses and person IDs replaced by tokens; longer matches first, so none is cut."""
    def replace_all(t, prefix, pattern):
        found = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
        return F.when(t.rlike(pattern), F.aggregate(found, t, lambda acc, m: F.replace(acc, m, pseudonym(key, prefix, m)))).otherwise(t)
    return replace_all(replace_all(text, "IP", IPV4_WORD), "PERSON", PERSON_WORD)


def token_table(key: bytes, df, text: str):
    """(token, original): the mapping that makes masking reversible, one row per distinct identifier."""
    spots = df.select(F.explode(F.array_union(
        F.transform(F.regexp_extract_all(text, F.lit(IPV4_WORD), F.lit(0)), lambda m: F.struct(F.lit("IP").alias("p"), m.alias("original"))),
        F.transform(F.regexp_extract_all(text, F.lit(PERSON_WORD), F.lit(0)), lambda m: F.struct(F.lit("PERSON").alias("p"), m.alias("original"))))).alias("x")).select("x.*").distinct()
    return spots.select(F.when(F.col("p") == "IP", pseudonym(key, "IP", F.col("original"))).otherwise(pseudonym(key, "PERSON", F.col("original"))).alias("token"), "original")
