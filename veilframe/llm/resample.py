"""Importance resampling towards a target distribution of hashed word n-grams.

Texts are lower-cased (A-Z only) and cut into words of digits, letters a-z and non-ASCII
characters. Features are all runs of one to ``n`` words; a feature's bucket is the crc32 of
its bytes modulo ``buckets``. A bucket's gain is the log ratio of its smoothed share in the
target to that in the documents, in thousandths, rounded down; a document's weight is the
mean of its features' gains, rounded down. A keyed Gumbel draw added to the weight gives the
score, so that the highest scores are a sample without replacement in proportion to the
weights, and a rerun draws the same documents.

Bucket counts are summed within each task before they are shuffled; the driver sees one
number per bucket. The gains travel as one array of ``buckets`` numbers. Scores are
written once to the shared folder. The score of the last drawn document is found by
bisection: every job counts the rows above the thresholds that the next ``LEVELS`` halvings
could ask for, so no sort, no sample and no quantile sketch decides; documents tied at that
score are cut by id in the same way, and repeated rows of one id by their place in the
written table. Only drawn rows are range-partitioned to get their ranks.

Defined results: null and empty texts have no features, weight 0 and a score from the draw
alone; a null id draws as the empty text and stands last among ties; repeated ids are
scored and drawn row by row; an empty target or empty table of documents gives gains from
the smoothing alone, or no rows. Columns of the input that are called like a result
(``n_features``, ``weight``, ``score``, ``rank``) are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from ..session import materialize
from .common import CRC32_SQL, by_text, query, table, utf8
from .decontaminate import words_of

BUCKETS = 10_000
N_WORDS = 2
SCALE = 1000
LEVELS = 4
SEED = 7
MIN_WORDS = 20
PERCENT = 25

_WEIGHT = "struct<n_words:bigint,n_features:bigint,weight:bigint>"
_WEIGHT_ARROW = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def feature_buckets(words: list[bytes], n: int = N_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every run of one to ``n`` words; a run's crc32 goes on from that of the run without its last word."""
    runs = list(map(crc32, words))
    spaced = [b" " + w for w in words]
    found = [runs]
    for size in range(2, n + 1):
        runs = list(map(crc32, spaced[size - 1 :], runs))
        found.append(runs)
    total = sum(map(len, found))
    return np.fromiter(chain.from_iterable(found), np.int64, total) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", n: int = N_WORDS, buckets: int = BUCKETS) -> list[int]:
    """Number of features per bucket over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                sums += np.bincount(feature_buckets(words_of(value), n, buckets), minlength=buckets)
        (filled,) = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(filled, pa.int64()), "n": pa.array(sums[filled], pa.int64())})

    parts = texts.select(utf8(text).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    result = [0] * buckets
    for bucket, number in parts.groupBy("bucket").agg(F.sum("n")).collect():  # at most one row per bucket
        result[bucket] = number
    return result


def gains(source: list[int], target: list[int]) -> list[int]:
    """Log ratio of the smoothed target share to the smoothed source share per bucket, in thousandths, rounded down."""
    buckets, all_source, all_target = len(source), float(sum(source)), float(sum(target))
    return [
        math.floor(SCALE * math.log((t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets))))
        for s, t in zip(source, target)
    ]


def weigh(table_of_gains: list[int], n: int = N_WORDS) -> Callable[[Column], Column]:
    """A column function: number of words and features of a text, and its mean gain rounded down."""
    array = np.array(table_of_gains, np.int64)

    def make():
        def score(value: bytes) -> dict:
            words = words_of(value)
            found = feature_buckets(words, n, len(array))
            mean = int(array[found].sum()) // len(found) if len(found) else 0
            return {"n_words": len(words), "n_features": len(found), "weight": mean}

        return score

    return by_text(make, _WEIGHT, _WEIGHT_ARROW)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """A Gumbel draw keyed by seed and key, in thousandths, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def score_documents(
    documents: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", n: int = N_WORDS,
    buckets: int = BUCKETS, seed: int = SEED, target_text: str = "text",
) -> DataFrame:
    """The documents with ``n_features``, ``weight``, ``score`` and the helper ``_vf_words``, their number of words."""
    table_of_gains = gains(
        bucket_counts(documents, text, n, buckets), bucket_counts(target, target_text, n, buckets)
    )
    weighed = documents.withColumn("_vf_weight", weigh(table_of_gains, n)(utf8(text)))
    for name, field in (("_vf_words", "n_words"), ("n_features", "n_features"), ("weight", "weight")):
        weighed = weighed.withColumn(name, F.col("_vf_weight")[field])
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col(key), seed)).drop("_vf_weight")


def kth_smallest(rows: DataFrame, value: Column, k: int, levels: int = LEVELS) -> tuple[int, int]:
    """The ``k``-th smallest value (from 1) of a whole-number column and how many rows are smaller, by counts alone."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    smaller, parts = 0, 2**levels
    while low < high:
        marks = sorted({low + (high - low) * i // parts for i in range(1, parts)})
        counts = rows.agg(*[F.count(F.when(value <= m, 1)) for m in marks]).first()
        for mark, number in zip(marks, counts):
            if number >= k:
                high = mark
                break
            low, smaller = mark + 1, number
    return low, smaller


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, key: str = "doc_id") -> DataFrame:
    """Add ``rank``: 1, 2, 3 ... by falling score for the drawn rows, null for the others.

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred (rounded down) are drawn.
    """
    rows = materialize(
        scored.drop("rank")
        .withColumn("_vf_fall", -F.col("score"))
        .withColumn("_vf_key", F.coalesce(F.col(key).cast("bigint"), F.lit(2**63 - 1)))
        .withColumn("_vf_place", F.monotonically_increasing_id())
    )
    able = rows.where(F.col("_vf_words") >= min_words)
    wanted = able.count() * percent // 100
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("bigint")).drop("_vf_words", "_vf_fall", "_vf_key", "_vf_place")
    order = ["_vf_fall", "_vf_key", "_vf_place"]
    tied, left, before = able, wanted, F.lit(False)
    for name in order:  # rows before the cut, then those tied with it, level by level
        value, smaller = kth_smallest(tied, F.col(name), left)
        before = before | ((F.col(name) < value) if tied is able else (at & (F.col(name) < value)))
        at = (F.col(name) == value) if tied is able else (at & (F.col(name) == value))
        left -= smaller
        tied = able.where(at)
        if tied.count() == left:
            break
    chosen = (F.col("_vf_words") >= min_words) & (before | at)
    ranked = with_position(rows.where(chosen), order, "_vf_rank").withColumn("rank", F.col("_vf_rank") + 1)
    rest = rows.where(~chosen).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.drop("_vf_rank").unionByName(rest).drop("_vf_words", *order)


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **more) -> DataFrame:
    """The drawn documents with their scores and ranks."""
    key = more.get("key", "doc_id")
    return draw(score_documents(documents, target, **more), percent, min_words, key).where(F.col("rank").isNotNull())


_WORD_RUN = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all({_LOWERED}, '{_WORD_RUN}') AS w FROM documents),
item AS (SELECT regexp_extract_all({_LOWERED}, '{_WORD_RUN}') AS w FROM benchmark),
doc_f AS (SELECT i, f, count(*) AS n FROM (SELECT i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM doc) GROUP BY ALL),
item_f AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM item) GROUP BY ALL),
crc AS (SELECT f, {CRC32_SQL.format("f")} % 10000 AS b FROM (SELECT f FROM doc_f UNION SELECT f FROM item_f)),
src AS (SELECT b, sum(n) AS s FROM doc_f JOIN crc USING (f) GROUP BY b),
tgt AS (SELECT b, sum(n) AS t FROM item_f JOIN crc USING (f) GROUP BY b),
total AS (SELECT CAST((SELECT coalesce(sum(s), 0) FROM src) AS DOUBLE) AS ss, CAST((SELECT coalesce(sum(t), 0) FROM tgt) AS DOUBLE) AS tt),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (tt + 10000)))) AS BIGINT) AS g
         FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN src USING (b) LEFT JOIN tgt USING (b), total),
mean AS (SELECT i, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
         FROM doc_f JOIN crc USING (f) JOIN gain USING (b) GROUP BY i),
scored AS (SELECT i, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM doc LEFT JOIN mean USING (i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, i) AS r, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""


@query("op11_importance_resampling", OP11_SQL)
def op11_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")
