"""Benchmark decontamination: a broadcast set of normalised test n-grams.

Texts are lower-cased (A-Z only) and cut into words of digits, letters a-z and
non-ASCII characters. A window is ``n`` consecutive words of a benchmark item; an
item with fewer words, but at least one, is one window. A document word inside
any occurrence of a window is hit.

The windows are counted first. Up to ``max_windows`` of them travel as one
broadcast; a larger benchmark is cut by window hash into parts of about that size. Each
part has a pass of its own over the documents: its hits, one row per different text that is
hit, are written and its broadcast is released before the next part is read. The hits of all
parts are then joined to the documents by two hashes of the text.

Defined results: null and empty texts have no words and no hits; benchmark rows
with a null id or text take no part; repeated items and repeated documents are
each treated by themselves, equal windows of several items count for all of them;
empty tables give no hits or no rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_text, map_batches, query, table, utf8

N_WORDS = 10
MAX_WINDOWS = 500_000

# ASCII characters outside 0-9, A-Z and a-z separate words.
_SEPARATORS = bytes.maketrans(
    bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128))
)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

_HITS = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"
_HITS_ARROW = pa.struct(
    [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.lower().translate(_SEPARATORS).split()


def windows(benchmark: DataFrame, n: int = N_WORDS, key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per item and distinct window: ``item``, ``gram`` (words joined by a space)."""

    def make():
        def cut(batch):
            items, grams = [], []
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(value)
                for i in range(max(1, len(words) - n + 1) if words else 0):
                    items.append(item)
                    grams.append(b" ".join(words[i : i + n]))
            return {"item": items, "gram": grams}

        return cut

    rows = benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("string"), utf8(text))
    cut = map_batches(rows, make, "item string, gram binary", pa.schema([("item", pa.string()), ("gram", pa.binary())]))
    return cut.distinct()


class WindowSet:
    """Windows as sequences of word numbers, by length, with sorted hashes for lookup."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[bytes, list[str]] = {}
        for item, gram in rows:
            owners.setdefault(bytes(gram), []).append(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        self.items: dict[tuple[int, ...], list[str]] = {}
        for gram, items in owners.items():
            numbers = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in gram.split(b" "))
            self.items[numbers] = items
            by_length.setdefault(len(numbers), []).append(numbers)
        self.hashes = {}
        for length, grams in by_length.items():
            self.hashes[length] = np.unique(self.rolled(np.array(grams, np.int64).T))

    @staticmethod
    def rolled(columns) -> np.ndarray:
        """One number per window from its word numbers, given place by place."""
        total = np.zeros(len(columns[0]), np.uint64)
        for numbers in columns:
            total = (total + numbers.astype(np.uint64) + np.uint64(1)) * _MIX
            total ^= total >> np.uint64(29)
        return total

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges hit by a window, and the items whose windows occur."""
        look = self.vocabulary.get
        numbers = np.fromiter((look(w, -1) for w in words), np.int64, len(words))
        unknown = np.concatenate(([0], np.cumsum(numbers < 0)))
        found, items = [], set()
        for length, hashes in self.hashes.items():
            if length > len(words):
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(starts):
                continue
            rolled = self.rolled([numbers[starts + k] for k in range(length)])
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for start in starts[hashes[at] == rolled].tolist():
                owners = self.items.get(tuple(numbers[start : start + length].tolist()))
                if owners:  # the hash is only a filter, the word numbers decide
                    found.append((start, start + length))
                    items.update(owners)
        merged: list[tuple[int, int]] = []
        for start, end in sorted(found):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return merged, items


def _share(grams: DataFrame) -> Broadcast:
    rows = [(r[0], r[1]) for r in grams.collect()]  # at most about max_windows rows
    return grams.sparkSession.sparkContext.broadcast(WindowSet(rows))


def _scan(shared: Broadcast, text: Column) -> Column:
    def make():
        known = shared.value

        def scan(value: bytes) -> dict:
            words = words_of(value)
            spans, items = known.find(words) if words else ([], set())
            return {
                "n_words": len(words),
                "starts": [s for s, _ in spans],
                "ends": [e for _, e in spans],
                "items": sorted(items),
            }

        return scan

    return by_text(make, _HITS, _HITS_ARROW)(text)


def find_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = N_WORDS,
    text: str = "text",
    max_windows: int = MAX_WINDOWS,
    item_key: str = "item_id",
    item_text: str = "text",
    name: str = "hits",
) -> DataFrame:
    """Documents with the column ``name``: number of words, hit word ranges (sorted, per part merged) and item ids."""
    grams = windows(benchmark, n, item_key, item_text)
    parts = max(1, -(-grams.count() // max_windows))
    if parts == 1:
        return documents.withColumn(name, _scan(_share(grams), utf8(text)))
    grams = materialize(grams)
    part = F.pmod(F.xxhash64("gram"), F.lit(parts))
    keys = {"_vf_h1": F.xxhash64(utf8(text)), "_vf_h2": F.xxhash64(F.lit(parts), utf8(text))}
    texts = documents.select(utf8(text).alias("_vf_text"), *[c.alias(k) for k, c in keys.items()])
    found = []
    for k in range(parts):
        shared = _share(grams.where(part == k))
        scanned = texts.select(*keys, _scan(shared, F.col("_vf_text")).alias("_vf_hits"))
        found.append(materialize(scanned.where(F.size("_vf_hits.starts") > 0).dropDuplicates(list(keys))))
        shared.unpersist()
    # a row per text and part
    united = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.collect_list("_vf_hits").alias("_vf_hits"))
    words = by_text(lambda: lambda value: len(words_of(value)), "bigint", pa.int64())(utf8(text))

    def put_together(field: str, kind: str) -> Column:
        return F.coalesce(F.flatten(F.transform("_vf_hits", lambda h: h[field])), F.array().cast(f"array<{kind}>"))

    hits = F.struct(
        words.alias("n_words"),
        put_together("starts", "bigint").alias("starts"),
        put_together("ends", "bigint").alias("ends"),
        F.array_sort(F.array_distinct(put_together("items", "string"))).alias("items"),
    )
    joined = documents.withColumns(keys).join(united, list(keys), "left")
    return joined.withColumn(name, hits).drop(*{*keys, "_vf_hits"} - {name})


def n_hit(hits: Column) -> Column:
    """Number of words inside the ranges; those of several parts may overlap."""
    ranges = F.array_sort(F.arrays_zip(hits["starts"].alias("s"), hits["ends"].alias("e")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))

    def add(seen: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["e"] - F.greatest(span["s"], seen["end"]))
        return F.struct((seen["n"] + fresh).alias("n"), F.greatest(seen["end"], span["e"]).alias("end"))

    return F.aggregate(ranges, start, add, lambda seen: seen["n"])


def without_spans(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """The text without the words of the given ranges and what stands between them."""
    if not starts:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in sorted(zip(starts, ends)):
        kept.append(text[at : max(at, places[start][0])])
        at = max(at, places[end - 1][1])
    return "".join([*kept, text[at:]])


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, n: int = N_WORDS, drop: str = "documents", text: str = "text", **more
) -> DataFrame:
    """Documents without contamination: whole ``documents`` with a hit go, or only the hit ``spans``."""
    found = find_hits(documents, benchmark, n, text, name="_vf_hits", **more)
    if drop == "documents":
        return found.where(F.size("_vf_hits.starts") == 0).drop("_vf_hits")
    if drop != "spans":
        raise ValueError("drop is 'documents' or 'spans'")
    cut = F.arrow_udf(
        lambda t, s, e: pa.array(
            [without_spans(*row) for row in zip(t.to_pylist(), s.to_pylist(), e.to_pylist())], pa.string()
        ),
        "string",
    )
    return found.withColumn(text, cut(F.col(text).cast("string"), "_vf_hits.starts", "_vf_hits.ends")).drop("_vf_hits")


_ALNUM = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS w
              FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_at AS (SELECT item_id, w, unnest(range(greatest(len(w) - {N_WORDS - 1}, 1))) AS i FROM item WHERE len(w) > 0),
gram AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + {N_WORDS}], ' ') AS g,
                len(w[i + 1 : i + {N_WORDS}]) AS n FROM item_at),
doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}'), []) AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM gram),
doc_at AS (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM doc, lengths),
found AS (SELECT doc_id, i, gram.n, item_id FROM doc_at JOIN gram
          ON gram.n = doc_at.n AND array_to_string(w[i + 1 : i + doc_at.n], ' ') = g),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit(F.col("hits")).alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.size("hits.starts") > 0).alias("contaminated"),
    )
