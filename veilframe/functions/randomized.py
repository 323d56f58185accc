"""Randomized response and perturbation of one value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import keyed, parse


def rr_boolean(c: Column, secret: str, column: str, key: Column, p: float = K.TRUTH_PROBABILITY) -> Column:
    """The true value with probability p, else a fair coin."""
    hexdigest = keyed.digest(secret, "rr_boolean", column, key)
    truthful = keyed.uniform_of(hexdigest, 0) < p
    coin = keyed.uniform_of(hexdigest, 1) < 0.5
    return F.when(c.isNotNull(), F.when(truthful, c).otherwise(coin))


def rr_categorical(
    c: Column, categories: list, secret: str, column: str, key: Column, p: float = K.TRUTH_PROBABILITY
) -> Column:
    """The true value with probability p, else one of the declared categories.

    For a public, declared list. When the categories come from the data, use
    ``operators.anonymize.k_anonymize``, which keeps them in a table.
    """
    hexdigest = keyed.digest(secret, "rr_categorical", column, key)
    truthful = keyed.uniform_of(hexdigest, 0) < p
    other = keyed.pick(categories, keyed.uniform_of(hexdigest, 1))
    return F.when(c.isNotNull(), F.when(truthful, c).otherwise(other))


def rr_epsilon(p: float, categories: int = 2) -> float:
    """Privacy loss of randomized response; two categories for the boolean form."""
    lie = (1.0 - p) / categories
    return math.log((p + lie) / lie)


def rr_share(observed_share: Column, categories: Column | int, p: float = K.TRUTH_PROBABILITY) -> Column:
    """Unbiased estimate of the true share of a category from its observed share."""
    k = F.lit(float(categories)) if isinstance(categories, int) else categories.cast("double")
    return (observed_share - F.lit(1.0 - p) / k) / F.lit(p)


def is_currency(name: str) -> bool:
    """Whether a column name denotes money."""
    return parse.has_any(name, K.CURRENCY_WORDS)


def pool_noise(c: Column, name: str, secret: str, key: Column) -> Column:
    """Nearest integer plus an offset from the fixed pool of the column's kind.

    Money takes large offsets and may become negative. Other columns take
    offsets up to 3 and stay at or above zero; their negative values are codes
    and keep their value. Bounded support, so this is perturbation and gives
    no differential-privacy guarantee.
    """
    rounded = F.rint(c).cast("bigint")
    u = keyed.uniform(secret, "pool_noise", name, key)
    if is_currency(name):
        return rounded + keyed.pick(K.CURRENCY_POOL, u)
    moved = F.greatest(F.lit(0).cast("bigint"), rounded + keyed.pick(K.INTEGER_POOL, u))
    return F.when(c < 0, rounded).when(c.isNotNull(), moved)


def numeric_release(c: Column, name: str, secret: str, key: Column, affordable: bool = True) -> Column:
    """A number column's released value: rounded score, pool noise, or plain rounding."""
    if not affordable:
        return F.rint(c).cast("bigint")
    if parse.has_any(name, K.ROUNDED_WORDS):
        return F.bround(c, 1)
    return pool_noise(c, name, secret, key)


def laplace_record(c: Column, epsilon: float, secret: str, name: str, key: Column) -> Column:
    """Text number plus Laplace noise of scale 1/epsilon, two decimals; other text unchanged."""
    number = F.regexp_extract(c, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    value = F.nullif(number, F.lit("")).try_cast("double")
    u = keyed.uniform(secret, "laplace_record", name, key)
    noisy = F.format_string("%.2f", value + keyed.laplace(u, 1.0 / epsilon))
    return F.when(value.isNull(), c).otherwise(noisy)
