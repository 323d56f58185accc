"""SimHash near-duplicates through pigeonhole blocks.

A text's fingerprint has a bit set when more than half of its 3-word shingle hashes
have it. Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
links make groups.

Fingerprints are counted once each. The 64 bits are cut into ``blocks`` blocks; two
linked fingerprints differ in at most ``max_bits`` of them, so they agree in some
choice of ``blocks - max_bits`` blocks. Each choice is a join key of about
64 * (blocks - max_bits) / blocks bits; with six blocks a key has 32 bits, and more blocks
give longer keys for larger collections. Keys of one fingerprint end there. Keys with
more than ``piece`` fingerprints are cut into pieces that meet piece by piece, so a
task holds two pieces at most, compares them with XOR and bit counts, and reports a
spanning forest of the links it finds instead of all pairs.

Defined results: null and wordless texts have fingerprint 0 and are linked like any
other; with fewer than three words the whole word sequence is the one shingle; equal texts
share a fingerprint; rows without an id get no say in a group's smallest id and are
never dropped; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_text, query, table, utf8
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BLOCKS = 6
PIECE = 4096
_SLICE = 1 << 16


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        bits = np.unpackbits(hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str = "text", shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array([fingerprint_of(t, shingle) for t in array.to_pylist()], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")(utf8(text))


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _masks(blocks: int, max_bits: int) -> list[int]:
    """For each choice of blocks, the bits of those blocks, as signed numbers."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    masks = [sum(choice) for choice in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect all values connected by pairs within the distance."""
    left, found = values, []
    while len(left):
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            one = wave.pop()
            near = np.bitwise_count(left ^ one) <= max_bits
            if near.any():
                found.extend((one, other) for other in left[near])
                wave.extend(left[near])
                left = left[~near]
    return found


def _links_of(keys: np.ndarray, values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys."""
    begin = np.flatnonzero(np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)]))
    sizes = np.diff(np.append(begin, len(values)))
    pair = begin[sizes == 2]
    near = pair[np.bitwise_count(values[pair] ^ values[pair + 1]) <= max_bits]
    a, b = [values[near]], [values[near + 1]]
    for at, size in zip(begin[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if links := forest(np.unique(values[at : at + size]), max_bits):
            both = np.array(links, np.uint64)
            a.append(both[:, 0])
            b.append(both[:, 1])
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(
    fingerprints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, piece: int = PIECE
) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints (distinct values of column ``fp``) within the distance."""
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(_masks(blocks, max_bits))])
    keys = fingerprints.select("fp", F.explode(masks).alias("c")).select(
        "fp", F.col("c.k").alias("k"), F.col("fp").bitwiseAND(F.col("c.m")).alias("key")
    )
    shared = keys.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = keys.join(shared, ["k", "key"]).withColumn("pieces", F.ceil(F.col("n") / F.lit(piece)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    members = members.withColumn("own", own).select(
        "fp", "k", "key", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    )
    members = members.select("k", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    together = members.repartition("k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

        def out(keys, values):
            a, b = _links_of(keys, values, max_bits)
            return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)}, schema=schema)

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            held_keys = np.concatenate([held_keys, np.stack(columns[:4], axis=1)])
            held = np.concatenate([held, columns[4].view(np.uint64)])
            if not len(held):
                continue
            last = np.flatnonzero(np.any(held_keys != held_keys[-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last key may go on in the next batch
            if cut:
                yield out(held_keys[:cut], held[:cut])
                held_keys, held = held_keys[cut:], held[cut:]
        if len(held):
            yield out(held_keys, held)

    return together.mapInArrow(run, "a bigint, b bigint")


def group_table(
    prints: DataFrame, key: str = "doc_id", max_bits: int = MAX_BITS, blocks: int = BLOCKS, links: DataFrame | None = None
) -> DataFrame:
    """For fingerprints with company: ``fp`` and ``component`` (the group's smallest id).

    ``prints`` has one row per document, with columns ``key`` and ``fp``; ``links`` between
    fingerprints may be given instead of the distance.
    """
    values = materialize(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")))
    if links is None:
        links = fingerprint_links(values.select("fp"), max_bits, blocks)
    linked = connected_components(links)
    rooted = values.join(linked.withColumnRenamed("node", "fp"), "fp")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    grouped = rooted.join(smallest, "root").select("fp", "component")
    alone = values.where(F.col("n") > 1).join(linked.select(F.col("node").alias("fp")), "fp", "left_anti")
    return grouped.unionByName(alone.select("fp", F.col("first").alias("component")))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: ``key``, ``fp`` and ``component`` (the smallest id reachable over links)."""
    prints = materialize(documents.select(key, fingerprint(text).alias("fp")))
    groups = materialize(group_table(prints, key, **how))
    return prints.join(groups, "fp", "left").select(key, "fp", F.coalesce("component", F.col(key)).alias("component"))


def keep_one(
    documents: DataFrame, key: str = "doc_id", text: str = "text", find: Callable[..., DataFrame] = near_duplicates, **how
) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of rows repeating an id one stays."""
    grouped = materialize(find(documents, key, text, **how))
    drop = grouped.where(F.col(key) != F.col("component")).select(key).distinct()
    kept = documents.join(drop, key, "left_anti")
    repeated = grouped.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > 1).select(key)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, key, "left_semi").dropDuplicates([key])
    return kept.join(repeated, key, "left_anti").unionByName(once)


@query("op4_simhash_groups")
def op4_simhash_groups(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
