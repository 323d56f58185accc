"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's size is its number of words. Sources, by code point and null last, weigh
1, 2, 3, 1, ... and share the total of all sizes; a target stops at ``max_epochs`` times
its source's size and the excess is shared again by weight until none is above.

Every source's documents are laid end to end in a keyed random order. A source with
target T is drawn as the first T words of that line, repeated; the drawn line is cut into
blocks of ``block`` words. A binary tree deals the blocks to output shards: at each node
the left half's share of every source is one multivariate-hypergeometric draw from the
node's exact quotas, seeded by the node, so shards receive disjoint runs of blocks, their
sources vary as in a full shuffle, and all quotas are met exactly. Any task can rebuild
the part of the tree it needs from the quotas alone; nothing is lost with an executor.
Inside a shard, rows are ordered by a keyed hash.

The only rows that reach the driver are one per source, at most ``MAX_SOURCES``.

Defined results: null text has size 0; documents of size 0 are not drawn; a source
without words has target 0; rows that repeat are separate documents; empty tables give
no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_running_total
from ..session import materialize
from .common import by_row, by_text, query, table, utf8

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK = 64
SHARD_WORDS = 1 << 20
SEED = 20
MAX_SOURCES = 100_000
_MAX_BLOCKS = 1 << 29  # the draw's counts must stay below 10**9

_WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes: list[int], weights: list[float], max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Words wanted of each source."""
    result = [0.0] * len(sizes)
    open_, rest = [k for k, n in enumerate(sizes) if n > 0], float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in open_)
        above = [k for k in open_ if rest * weights[k] / total > max_epochs * sizes[k]]
        if not above:
            for k in open_:
                result[k] = rest * weights[k] / total
            break
        for k in above:
            result[k] = float(max_epochs * sizes[k])
            rest -= result[k]
        open_ = [k for k in open_ if k not in set(above)]
    return result


class SplittingTree:
    """Deals the blocks of every source to shards; nodes are drawn when first needed."""

    def __init__(self, quotas: list[int], shards: int, seed: int = SEED):
        self.quotas, self.shards, self.seed = np.array(quotas, np.int64), shards, seed
        self.left: dict[tuple[int, int], np.ndarray] = {}
        self.total = int(self.quotas.sum())

    def _edge(self, shard: int) -> int:
        """Blocks in all shards before this one."""
        return self.total * shard // self.shards

    def _left(self, low: int, high: int, have: np.ndarray) -> np.ndarray:
        node = (low, high)
        if node not in self.left:
            rng = np.random.default_rng([self.seed, low, high])
            size = self._edge((low + high) // 2) - self._edge(low)
            self.left[node] = rng.multivariate_hypergeometric(have, size, method="marginals")
        return self.left[node]

    def runs(self, source: int, start: int, end: int) -> list[tuple[int, int, int]]:
        """The shards that hold blocks ``start`` to ``end`` of a source's drawn line, with the blocks of each."""
        found, todo = [], [(0, self.shards, 0, self.quotas)]
        while todo:
            low, high, before, have = todo.pop()
            first, last = max(start, before), min(end, before + int(have[source]))
            if first >= last:
                continue
            if high - low == 1:
                found.append((low, first, last))
                continue
            left, middle = self._left(low, high, have), (low + high) // 2
            todo.append((middle, high, before + int(left[source]), have - left))
            todo.append((low, middle, before, left))
        return found


_PIECES = "array<struct<shard:int,epoch:int,start:bigint,end:bigint>>"
_PIECES_ARROW = pa.list_(
    pa.struct([("shard", pa.int32()), ("epoch", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
)


def _pieces(lengths: list[int], drawn: list[int], block: int, shards: int, seed: int):
    """Where a document's words go, from its source, size and place in the source's line."""

    def make():
        tree = SplittingTree([-(-n // block) for n in drawn], shards, seed)

        def pieces(source: int, size: int, place: int) -> list[dict]:
            found = []
            for epoch in range(-(-drawn[source] // lengths[source]) if size else 0):
                shift = epoch * lengths[source] + place
                start, end = shift, min(shift + size, drawn[source])
                if start >= end:
                    continue
                for shard, first, last in tree.runs(source, start // block, -(-end // block)):
                    low, high = max(start, first * block), min(end, last * block)
                    if low < high:
                        found.append({"shard": shard, "epoch": epoch, "start": low - shift, "end": high - shift})
            return found

        return pieces

    return by_row(make, _PIECES, _PIECES_ARROW)


def n_words(text: str = "text"):
    """Number of words of a text column."""
    return by_text(lambda: lambda t: len(t.split()), "bigint", pa.int64())(utf8(text))


def plan(
    documents: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``key``, ``source``, ``size``, ``source_size``, ``target``, ``pieces`` and a 128-bit row hash.

    A piece is a range of the document's words that goes to a shard in an epoch of its source.
    """
    own = [key, source, text]
    rows = materialize(
        documents.select(
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            n_words(text).alias("size"),
            F.xxhash64(*own).alias("h1"),
            F.xxhash64(F.lit(seed), *own).alias("h2"),
        )
    )
    known = rows.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.asc_nulls_last("source")).limit(MAX_SOURCES + 1).collect()
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    lengths = [r["n"] for r in known]
    wanted = targets(lengths, [weights[k % len(weights)] for k in range(len(known))], max_epochs)
    drawn = [round(t) for t in wanted]
    block = max(block, -(-sum(drawn) // _MAX_BLOCKS))
    shards = max(1, round(sum(drawn) / shard_words))
    spark = documents.sparkSession
    before = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tolist()
    table_ = spark.createDataFrame(
        [(k, r["source"], before[k], lengths[k], wanted[k]) for k, r in enumerate(known)],
        "s int, source string, before bigint, source_size bigint, target double",
    )
    # one row per source
    placed = rows.join(F.broadcast(table_), rows["source"].eqNullSafe(table_["source"])).drop(table_["source"])
    placed = placed.withColumn("random", F.xxhash64(F.lit(seed), "h1", "h2"))
    placed = with_running_total(placed, ["s", "random", "key"], {"upto": F.col("size")})
    place = F.col("upto") - F.col("size") - F.col("before")
    return placed.select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        _pieces(lengths, drawn, block, shards, seed)(F.col("s"), F.col("size"), place).alias("pieces"),
        "h1",
        "h2",
    )


def taken(pieces: str = "pieces"):
    """Words the mix takes of a document, repeats counted."""
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda n, p: n + p["end"] - p["start"])


def _cut(text: str, start: int, end: int, size: int) -> str:
    if (start, end) == (0, size):
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    return text[spans[start][0] : spans[end - 1][1]]


def mix(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, **how) -> DataFrame:
    """The mixed corpus: the documents' columns with the pieces' text, ``shard``, ``epoch`` and ``place`` in the shard.

    Rows lie in their shards' order. ``n_chars``, where given, is that of the piece.
    """
    own = [key, source, text]
    planned = plan(documents, key, source, text, seed=seed, **how)
    pieces = planned.select("h1", "h2", "size", F.explode("pieces").alias("p")).select(
        F.col("h1").alias("_vf_h1"), F.col("h2").alias("_vf_h2"), F.col("size").alias("_vf_size"),
        *[F.col(f"p.{c}").alias(f"_vf_{c}") for c in ("shard", "epoch", "start", "end")],
    )
    hashed = documents.withColumn("_vf_h1", F.xxhash64(*own)).withColumn("_vf_h2", F.xxhash64(F.lit(seed), *own))
    # rows that repeat have a plan row each and meet one copy of their text
    joined = hashed.dropDuplicates(["_vf_h1", "_vf_h2"]).join(pieces, ["_vf_h1", "_vf_h2"])
    cut = F.arrow_udf(
        lambda *columns: pa.array([_cut(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.string()), "string"
    )
    result = joined.withColumn(text, cut(F.col(text).cast("string"), "_vf_start", "_vf_end", "_vf_size"))
    if "n_chars" in documents.columns:
        result = result.withColumn("n_chars", F.length(text).cast("bigint"))
    result = result.withColumns(
        {
            "shard": F.col("_vf_shard"),
            "epoch": F.col("_vf_epoch"),
            "place": F.xxhash64(F.lit(seed), "_vf_h1", "_vf_epoch", "_vf_start"),
        }
    )
    result = result.drop(*[c for c in result.columns if c.startswith("_vf_")])
    return result.repartition("shard").sortWithinPartitions("shard", "place")


@query("op8_source_mix")
def op8_source_mix(spark, sf_dir):
    planned = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", taken().alias("taken"))
