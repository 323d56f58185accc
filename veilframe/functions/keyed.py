"""Keyed randomness.

Every random draw is a function of (secret, operation, column, row key), never
``rand()``: a retried or speculative task then yields the same noise, a
released table can be rebuilt, and results are testable. One digest per
(row, column) serves up to four draws.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_DRAW_DIGITS = 13  # 52 bits, exact in a double
_DRAW_RANGE = float(2**52)


_REDACTION = "spark.sql.redaction.string.regex"


def hide(*texts: str) -> None:
    """Have Spark replace these texts wherever it prints a plan of the active session."""
    session = SparkSession.getActiveSession()
    if session is None:
        return
    known = session.conf.get(_REDACTION, None) or ""
    new = [re.escape(t) for t in texts if t and re.escape(t) not in known]
    if new:
        session.conf.set(_REDACTION, "|".join(filter(None, [known, *new])))


def digest(secret: str, operation: str, column: str, key: Column) -> Column:
    """SHA-256 hex of ``secret|operation|column|key``; the secret is kept out of printed plans."""
    hide(secret)
    return F.sha2(F.concat(F.lit(f"{secret}|{operation}|{column}|"), key.cast("string")), 256)


def draw(hexdigest: Column, slot: int = 0) -> Column:
    """A 52-bit integer from one of the four 13-digit slots of a digest."""
    part = F.substring(hexdigest, 1 + _DRAW_DIGITS * slot, _DRAW_DIGITS)
    return F.conv(part, 16, 10).cast("bigint")


def uniform_of(hexdigest: Column, slot: int = 0) -> Column:
    """Uniform in the open interval (0, 1) from a digest slot."""
    return (draw(hexdigest, slot) + F.lit(0.5)) / F.lit(_DRAW_RANGE)


def uniform(secret: str, operation: str, column: str, key: Column, slot: int = 0) -> Column:
    """Keyed uniform in (0, 1)."""
    return uniform_of(digest(secret, operation, column, key), slot)


def pick(options: list, u: Column) -> Column:
    """The option a uniform selects; every option equally likely."""
    choices = F.array(*[F.lit(o) for o in options])
    return F.element_at(choices, (F.floor(u * F.lit(len(options))) + 1).cast("int"))


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace(0, scale) by inverse distribution function."""
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    centred = u - F.lit(0.5)
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def gaussian(u1: Column, u2: Column, sigma: Column | float) -> Column:
    """Normal(0, sigma) from two uniforms (Box-Muller)."""
    sigma = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma
    return sigma * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def laplace_cdf(x: Column, scale: Column) -> Column:
    """Distribution function of Laplace(0, scale)."""
    tail = F.lit(0.5) * F.exp(-F.abs(x) / scale)
    return F.when(x < 0, tail).otherwise(F.lit(1.0) - tail)


def bounded_laplace(value: Column, u: Column, scale: Column, lower: Column, upper: Column) -> Column:
    """Laplace around ``value`` conditioned on [lower, upper].

    Inverse distribution function of the truncated density, so one draw is
    enough and no resampling loop is needed.
    """
    low = laplace_cdf(lower - value, scale)
    high = laplace_cdf(upper - value, scale)
    p = low + u * (high - low)
    x = F.when(p < 0.5, scale * F.log(F.lit(2.0) * p)).otherwise(
        -scale * F.log(F.lit(2.0) * (F.lit(1.0) - p))
    )
    return F.when(value.isNotNull(), F.least(F.greatest(value + x, lower), upper))


def bounded_laplace_scale(epsilon: Column | float, sensitivity: Column, width: Column) -> Column:
    """Noise scale of the bounded-domain Laplace mechanism.

    Truncation changes the normalising constant between neighbouring inputs,
    so sensitivity/epsilon is too small; the scale solves
    ``b = sensitivity / (epsilon - log C(b))`` (Holohan et al., "The Bounded
    Laplace Mechanism in Differential Privacy"). Doubling finds an upper end
    and bisection the solution; it runs on aggregated rows only.
    """
    reach = F.least(sensitivity, width)
    epsilon = F.lit(epsilon) if isinstance(epsilon, (int, float)) else epsilon

    def too_small(b: Column) -> Column:
        top = F.lit(2.0) - F.exp(-reach / b) - F.exp((reach - width) / b)
        room = epsilon - F.log(top / (F.lit(1.0) - F.exp(-width / b)))
        return b * room < sensitivity

    start = sensitivity / epsilon
    high = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), start, lambda b, _: F.when(too_small(b), b * 2.0).otherwise(b)
    )

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2.0
        small = too_small(middle)
        return F.struct(
            F.when(small, middle).otherwise(state["low"]).alias("low"),
            F.when(small, state["high"]).otherwise(middle).alias("high"),
        )

    bracket = F.struct(start.alias("low"), high.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), bracket, halve, lambda s: s["high"])


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 hex; the key pads are folded on the driver."""
    block = key.encode("utf-8")
    if len(block) > 64:
        import hashlib

        block = hashlib.sha256(block).digest()
    block = block.ljust(64, b"\0")
    pads = [bytes(b ^ pad for b in block) for pad in (0x36, 0x5C)]
    hide(*[form for pad in pads for form in (pad.hex().upper(), pad.hex())])
    inner, outer = (F.lit(bytearray(pad)) for pad in pads)
    inner_hash = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, inner_hash), 256)


def rotation_window(ts: Column, hours: int = 24) -> Column:
    """Name of the seed rotation window of a UTC timestamp."""
    if hours == 24:
        return F.date_format(ts, "yyyy-MM-dd'-00'")
    if hours == 1:
        return F.date_format(ts, "yyyy-MM-dd-HH")
    if hours == 168:
        # weeks start on Sunday; days before the first Sunday are week 00
        week = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7)
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    bucket = F.floor(F.unix_timestamp(ts) / F.lit(3600 * hours))
    return F.concat(F.lit("bucket-"), bucket.cast("string"))


def seed_digest(key: str, query_id: Column, window: Column) -> Column:
    """Seed of one query in one rotation window."""
    return hmac_sha256(key, F.concat(query_id.cast("string"), F.lit("||"), window))


def seed32(seed_hex: Column) -> Column:
    """The first four bytes of a seed as an unsigned integer."""
    return F.conv(F.substring(seed_hex, 1, 8), 16, 10).cast("bigint")
