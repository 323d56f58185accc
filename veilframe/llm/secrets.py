"""Secrets in texts: fixed patterns, and tokens that read as random under character Markov models.

Three kinds of spans come from patterns, leftmost and non-overlapping per kind:
assignments to a password, token or key, access key ids, and long hex strings. The
models add a fourth kind, ``random``: a token of at least 16 characters whose
log-likelihood ratio, random strings against ordinary identifiers, is at least
``threshold``, unless it overlaps a pattern's span.

Both models are first-order chains over the printable ASCII characters that fall back on
the characters' frequencies where a transition is rare. The labelled samples are bounded: up to ``max_secrets``
distinct values found by the patterns (random) and the tokens of up to ``max_documents``
documents apart from the patterns' spans (ordinary), each those with the smallest hash.
The transition counts are summed by Spark; the driver sees 96 x 96 of them at most.

Spans are code point ranges, end exclusive. A pattern's matches and the pieces between
them give the positions, so all of it is DataFrame functions.

Defined results: null text is empty and has no spans; without any labelled sample both
models are uniform and nothing is added; repeated documents have the same spans; rows
without an id have spans but are not sampled; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, table

# The patterns, the least length of what they must hold, and the order of kinds.
ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
WORD = "[A-Za-z0-9+/_-]{4,}"
MAX_SECRETS = 20_000
MAX_DOCUMENTS = 2_000
THRESHOLD = 12.0
_SYMBOLS = 96  # characters 32 to 127; 32 also stands for the start of a token
_FLOOR = 0.5  # weight of every character besides its count
_BACK = 2.0  # weight of the character frequencies beside a character's transitions

_SPAN = "array<struct<start:int,o:int,end:int,value:string>>"


def _empty() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, order: int, values: Column | None = None) -> Column:
    """Ranges of all matches of a pattern, from the matches and the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = found if values is None else values
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("match"), values.alias("value"))
    # the last piece has no match after it
    parts = F.filter(parts, lambda p: p["match"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), _empty().alias("spans"))

    def add(seen: Column, part: Column) -> Column:
        begin = seen["at"] + F.length(part["gap"])
        end = begin + F.length(part["match"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("o"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(seen["spans"], span).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(parts, start, add, lambda seen: seen["spans"])).otherwise(_empty())


def with_base_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents with ``_vf_text`` and the patterns' spans ``_vf_assign``, ``_vf_access``, ``_vf_hex``."""
    base = documents.withColumn("_vf_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    source = F.col("_vf_text")

    def long_enough(spans: Column, least: int) -> Column:
        return F.filter(spans, lambda s: F.length(s["value"]) >= least)

    values = F.regexp_extract_all(source, F.lit(ASSIGN), F.lit(2))
    return base.withColumns(
        {
            "_vf_assign": long_enough(_spans(source, ASSIGN, 0, values), MIN_ASSIGN),
            "_vf_access": long_enough(_spans(source, ACCESS, 1), MIN_ACCESS),
            # runs are maximal, so a shorter run cannot hide a longer one
            "_vf_hex": _spans(source, HEX[:-1] + f"{{{MIN_HEX},}}", 2),
        }
    )


def _transitions(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters in distinct tokens of column ``token``."""
    codes = F.transform(F.split("token", ""), lambda c: F.ascii(c))
    pairs = F.zip_with(
        F.concat(F.array(F.lit(32)), F.slice("codes", 1, F.size("codes") - 1)), "codes", lambda a, b: a * 128 + b
    )
    counted = (
        tokens.where(F.length("token") > 0)
        .select(codes.alias("codes"))
        .select(F.explode(pairs).alias("pair"))
        .groupBy("pair")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per pair of the 96 characters
    return {(r["pair"] // 128, r["pair"] % 128): r["n"] for r in counted.collect()}


def _log_model(counts: dict[tuple[int, int], int]) -> list[list[float]]:
    """Log probabilities of every transition; rare contexts fall back on the characters' frequencies."""
    symbols = range(32, 32 + _SYMBOLS)
    alone = {b: _FLOOR for b in symbols}
    for (_, b), n in counts.items():
        alone[b] = alone.get(b, _FLOOR) + n
    total = sum(alone[b] for b in symbols)
    rows = []
    for a in symbols:
        row = [counts.get((a, b), 0) + _BACK * alone[b] / total for b in symbols]
        rows.append([math.log(x / sum(row)) for x in row])
    return rows


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", max_secrets: int = MAX_SECRETS, max_documents: int = MAX_DOCUMENTS) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every transition (96 x 96, row by row)."""
    found = with_base_spans(documents.select(key, text), text)
    # of an assignment the value alone; the other kinds are whole matches
    values = F.transform(F.concat("_vf_assign", "_vf_access", "_vf_hex"), lambda s: s["value"])
    secrets = found.select(F.explode(values).alias("token")).distinct()
    secrets = secrets.orderBy(F.xxhash64("token"), "token").limit(max_secrets)
    ids = documents.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(max_documents)
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for pattern in (ASSIGN, ACCESS, HEX[:-1] + f"{{{MIN_HEX},}}"):
        plain = F.regexp_replace(plain, pattern, " ")
    # at most max_documents ids
    sample = documents.select(key, text).join(F.broadcast(ids), key, "left_semi")
    ordinary = sample.select(F.explode(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))).alias("token")).distinct()
    random_, usual = _log_model(_transitions(secrets)), _log_model(_transitions(ordinary))
    return [r - u for one, other in zip(random_, usual) for r, u in zip(one, other)]


def log_ratio(value: Column, table_: Column) -> Column:
    """Sum of the transitions' ratios along a token."""
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("sum"))

    def add(seen: Column, c: Column) -> Column:
        code = F.ascii(c) - 32
        return F.struct((code * _SYMBOLS).alias("row"), (seen["sum"] + F.get(table_, seen["row"] + code)).alias("sum"))

    return F.aggregate(F.split(value, ""), start, add, lambda seen: seen["sum"])


def find_secrets(
    documents: DataFrame, ratios: list[float], threshold: float = THRESHOLD, text: str = "text"
) -> DataFrame:
    """Documents with ``base`` (the patterns' spans) and ``spans`` (all), sorted by start and kind.

    A span is a struct of ``start``, ``o`` (place of its kind in ``KINDS``), ``end`` and the ``value`` found.
    """
    table_ = F.expr("array(" + ",".join(f"{r:.6f}D" for r in ratios) + ")")
    found = with_base_spans(documents, text).withColumn("_vf_tokens", _spans(F.col("_vf_text"), TOKEN, 3))
    found = found.withColumn("base", F.array_sort(F.concat("_vf_assign", "_vf_access", "_vf_hex")))

    def added(span: Column) -> Column:
        overlaps = F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return ~overlaps & (log_ratio(span["value"], table_) >= threshold)

    more = F.when(F.size("_vf_tokens") > 0, F.filter("_vf_tokens", added)).otherwise(_empty())
    result = found.withColumn("spans", F.array_sort(F.concat("base", more)))
    return result.drop("_vf_text", "_vf_assign", "_vf_access", "_vf_hex", "_vf_tokens")


def listed(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(kinds, s["o"]), s["start"], s["end"])), ",")


@query("op7_secret_spans")
def op7_secret_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(docs))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["o"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
