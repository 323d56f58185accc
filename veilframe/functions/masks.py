"""Hashes, masks, pseudonyms and generalizations of one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CATEGORY_LIMIT
from . import parse


def _hex_to_long(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def hash_keep_length(c: Column) -> Column:
    """SHA-256 hex cut to the length of the text."""
    text = c.cast("string")
    return F.substr(F.sha2(text, 256), F.lit(1), F.length(text))


def pseudonym(c: Column) -> Column:
    """Stable ``Person_nnnnn`` name.

    The first 64 bits of the digest modulo 100000, computed from two 32-bit
    halves so that it stays in long arithmetic.
    """
    hashed = F.sha2(c.cast("string"), 256)
    high = _hex_to_long(F.substring(hashed, 1, 8)) % 100000
    low = _hex_to_long(F.substring(hashed, 9, 8))
    number = (high * F.lit(2**32 % 100000) + low) % 100000
    return F.concat(F.lit("Person_"), F.lpad(number.cast("string"), 5, "0"))


def mask_email(c: Column) -> Column:
    """Two leading characters, stars, and the part after the first ``@``."""
    text = c.cast("string")
    at = F.instr(text, "@")
    local = F.substr(text, F.lit(1), at - 1)
    domain = F.substr(text, at)
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(local) - 2))
    masked = F.concat(F.substring(local, 1, 2), stars, domain)
    return F.when(at > 0, masked).when(text.isNotNull(), F.lit("[MASKED]"))


def mask_phone(c: Column) -> Column:
    """Stars and the last four characters, separators dropped."""
    text = F.translate(c.cast("string"), "-() ", "")
    masked = F.concat(F.repeat(F.lit("*"), F.length(text) - 4), F.right(text, F.lit(4)))
    return F.when(F.length(text) >= 10, masked).when(text.isNotNull(), F.lit("[MASKED]"))


def mask_aadhaar(c: Column) -> Column:
    """All but the last four digits replaced; the spaced form stays spaced."""
    digits = F.regexp_replace(c, r"\D", "")
    last = F.right(digits, F.lit(4))
    return (
        F.when(F.length(digits) < 4, F.repeat(F.lit("X"), F.length(c)))
        .when(F.instr(c, " ") > 0, F.concat(F.lit("XXXX XXXX "), last))
        .otherwise(F.concat(F.repeat(F.lit("X"), F.length(digits) - 4), last))
    )


def mask_pan(c: Column) -> Column:
    """Middle part of a tax number replaced by stars."""
    text = F.upper(parse.strip(c))
    n = F.length(text)
    return (
        F.when(n == 10, F.concat(F.substring(text, 1, 5), F.lit("****"), F.right(text, F.lit(1))))
        .when(n > 6, F.concat(F.substring(text, 1, 3), F.repeat(F.lit("*"), n - 6), F.right(text, F.lit(3))))
        .otherwise(F.repeat(F.lit("*"), n))
    )


def district_alias(c: Column) -> Column:
    """One of ten district names, chosen by digest."""
    number = _hex_to_long(F.substring(F.md5(F.lower(c)), 1, 8)) % 10 + 1
    return F.concat(F.lit("District "), number.cast("string"))


def java_hash(c: Column) -> Column:
    """``hash_`` and the hex magnitude of the 32-bit polynomial string hash.

    The hash runs over UTF-16 units, so a character beyond the basic plane
    contributes its two surrogates.
    """
    wrap = 4294967295

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("bigint")
        beyond = code - 65536
        first = (acc * 31 + F.lit(55296) + F.shiftright(beyond, 10)).bitwiseAND(F.lit(wrap))
        pair = (first * 31 + F.lit(56320) + beyond.bitwiseAND(F.lit(1023))).bitwiseAND(F.lit(wrap))
        unit = (acc * 31 + code).bitwiseAND(F.lit(wrap))
        return F.when(code > 65535, pair).otherwise(unit)

    chars = F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    h = F.aggregate(chars, F.lit(0).cast("bigint"), step)
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return F.when(c.isNotNull(), F.concat(F.lit("hash_"), F.lower(F.hex(F.abs(signed)))))


def generalize_date(c: Column) -> Column:
    """The first year 1900-2099 in the text, else ``[DATE]``."""
    text = c.cast("string")
    year = F.regexp_extract(text, r"(?U)\b(19|20)\d{2}\b", 0)
    return F.when(year != "", year).when(text.isNotNull(), F.lit("[DATE]"))


def generalize_location(c: Column) -> Column:
    """``[REGION]`` for every known value."""
    return F.when(c.isNotNull(), F.lit("[REGION]"))


def generalize_category(c: Column, distinct: Column, limit: int = CATEGORY_LIMIT) -> Column:
    """``[CATEGORY]`` for every value of a column with more than ``limit`` values."""
    text = c.cast("string")
    return F.when((distinct > limit) & text.isNotNull(), F.lit("[CATEGORY]")).otherwise(text)


def redact(c: Column) -> Column:
    """``[REDACTED]`` for every known value."""
    return F.when(c.isNotNull(), F.lit("[REDACTED]"))


def suppress(c: Column) -> Column:
    """Null text."""
    return F.lit(None).cast("string")
