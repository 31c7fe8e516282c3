"""Column helpers for text, channels, fields and checksums."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import channels as ch
from ..dims import fields as fl


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space at both ends (tabs and line breaks too)."""
    return F.btrim(col(c), F.lit(" \t\n\r\x0b\x0c"))


def contains_any(c, words) -> Column:
    """True when the text holds one of the literal words (codegen, no lambda)."""
    c = col(c)
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def starts_with_any(c, words) -> Column:
    c = col(c)
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(w)) for w in words])


def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def normalize_channel(c) -> Column:
    """``final_output``, ``C1_final_output`` and ``c1`` become ``C1``; unknown names become ``C1``."""
    names = {}
    for cid, long_name, *_ in ch.CHANNELS:
        names[cid.lower()] = cid
        names[long_name.lower()] = cid
        names[long_name.lower().split("_", 1)[1]] = cid
    return F.coalesce(F.element_at(literal_map(names.items()), F.lower(F.trim(col(c)))), F.lit("C1"))


def channel_weight(c, profile: str = "channel", overrides: dict | None = None) -> Column:
    weights = {**ch.WEIGHT_PROFILES[profile], **(overrides or {})}
    return F.coalesce(F.element_at(literal_map(weights.items()), col(c)), F.lit(ch.DEFAULT_WEIGHT[profile]))


def clearance_level(c) -> Column:
    return F.element_at(literal_map(ch.CLEARANCE.items()), F.lower(col(c)))


def is_allowed(field, allowed, forbidden) -> Column:
    """A field may be disclosed when it is allowed and not forbidden; forbidden wins."""
    f = col(field)
    return ~F.coalesce(F.array_contains(col(forbidden), f), F.lit(False)) & F.coalesce(
        F.array_contains(col(allowed), f), F.lit(False)
    )


def is_contextual_only(field) -> Column:
    """Field names that only matter in context: a substring test against two lists."""
    f = F.lower(col(field))
    return contains_any(f, fl.CONTEXTUAL_FIELDS) & ~contains_any(f, fl.ALWAYS_SENSITIVE_FIELDS)


def is_digits(c) -> Column:
    return col(c).rlike("^[0-9]+$")


def normalized_digits(c) -> Column:
    return F.replace(F.replace(col(c), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def normalized_amount(c) -> Column:
    """Trimmed lower-case text without hyphens, blanks, commas and currency signs."""
    return F.regexp_replace(F.lower(strip(c)), r"[-, $€£]", "")


def thousands(c) -> Column:
    """188000 -> 188,000 (digits of any length; leading zeros go)."""
    return F.regexp_replace(bare_number(c), "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")


def bare_number(c) -> Column:
    """Digits without leading zeros."""
    return F.regexp_replace(col(c), "^0+(?=[0-9])", "")


def preview(c, n: int = 200) -> Column:
    return F.substring(col(c), 1, n)


def sha_prefix(c, n: int = 16) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, n)


def rate(k, n) -> Column:
    """k / n as a double, 0 when n is 0."""
    return F.coalesce(F.try_divide(col(k).cast("double"), col(n).cast("double")), F.lit(0.0))


def luhn_ok(c) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(col(c), "[^0-9]", ""))


def iban_ok(c) -> Column:
    """Mod-97 checksum: the first four characters move to the end, letters count 10..35."""
    s = F.upper(F.regexp_replace(col(c), r"\s", ""))
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    chars = F.split(moved, "(?<=.)(?=.)")
    def step(acc, x):
        digit = F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
        return ((acc * F.when(digit > 9, 100).otherwise(10)) + digit) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


def octets_ok(c) -> Column:
    return F.forall(F.split(col(c), r"\."), lambda x: x.cast("int") <= 255)


def split_react(c) -> tuple[Column, Column]:
    """(thought, json) of ``THOUGHT: .. JSON: ..``; without a JSON mark all is JSON."""
    c = col(c)
    has_json = F.contains(c, F.lit("JSON:"))
    json_part = F.when(has_json, strip(F.regexp_extract(c, r"(?s)JSON:\s*(.*)", 1))).otherwise(c)
    thought = F.when(has_json, strip(F.regexp_extract(c, r"(?s)THOUGHT:\s*(.*?)(?:JSON:|$)", 1))).otherwise(F.lit(""))
    return thought, json_part


def count_tokens(c) -> Column:
    """Rough token count: one token per four characters."""
    return F.floor(F.length(col(c)) / 4).cast("bigint")
