"""Near copies by five-word similarity: SimHash fingerprints under several seeds propose, shingle sets decide.

Two texts are linked when the sets of their 5-word shingles have a Jaccard similarity of
at least 4/5; links make groups. At that similarity one SimHash fingerprint differs in about
10 of 64 bits, too many for one fingerprint's pigeonhole blocks. A text therefore has
``SEEDS`` fingerprints with independent seeds, each cut into ``BLOCKS`` blocks of 16 bits. A pair
within three bits on any seed agrees in a block for certain; with bits that differ at a rate of 0.15, which
is that of similarity 0.8, it agrees in one of the 80 blocks with probability 0.997, and 0.9999 at 0.85.
Texts of a few shingles vary more: four shingles against five are found with 0.95.

Texts that agree in a block are compared by XOR and bit counts on 96 bits of the next two seeds, which one random
pair in 5,000 passes, and the pairs that pass by exact counts of common shingles; nothing below 4/5 is linked. Equal
texts are settled first, by digest, and only texts of passing pairs travel.

A block value that many texts share is cut into pieces that meet piece by piece. Where most of a
block's pairs pass (a large group of near copies), each text first meets the smallest of its block only; once those
links are known, the block is read again and its texts that pass with a text of another group meet in one task, which
counts common shingles exactly and reports a spanning forest. So a large group costs a few pairs a text, a text travels once
a block at most, and no link is lost.

Defined results: words are split at white space, ASCII letters compare without case; with
one to four words the whole word sequence is the one shingle; null and wordless texts are
alike; ids are treated as in ``simhash``; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import utf8
from .components import connected_components
from .simhash import group_table

SHINGLE = 5
SEEDS, BLOCKS = 20, 4
# bits that may differ on 64 bits of the next seed and on 32 of the one after it
NEAR_64, NEAR_32 = 20, 12
PIECE = 4096
SMALL = 64  # runs of so few texts are compared many at once
PAIRS_A_TEXT = 1  # with more passing pairs a run is hot
SEED = 42
_SLICE = 255 * 8
_ROWS = 1 << 16
_LOW = np.uint64(0x0101010101010101)


def shingles_of(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) > SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64))


_DRAWS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (SEEDS, 1), np.uint64)


def seeded(shingles: np.ndarray) -> np.ndarray:
    """A row of hashes for each seed."""
    x = (shingles[None, :] ^ _DRAWS) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def fingerprints_of(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each seed: a bit is set when more than half of the seed's hashes have it."""
    ones = np.zeros((SEEDS, 8, 8), np.int64)  # seed, byte, bit
    for at in range(0, len(shingles), _SLICE):
        hashes = seeded(shingles[at : at + _SLICE])
        runs = np.arange(0, hashes.shape[1], 255)  # a byte counts to 255
        for bit in range(8):
            counts = np.add.reduceat((hashes >> np.uint64(bit)) & _LOW, runs, axis=1)
            ones[:, :, bit] += counts.view(np.uint8).reshape(SEEDS, len(runs), 8).sum(axis=1, dtype=np.int64)
    return np.packbits(ones.reshape(SEEDS, 64) * 2 > len(shingles), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(text: str = "text") -> Column:
    """The fingerprints of a text column; texts without words have none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            found = [shingles_of(t) for t in array.to_pylist()]
            yield pa.array([fingerprints_of(s).view(np.int64) if len(s) else [] for s in found], pa.list_(pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<bigint>")(utf8(text))


def set_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links, by place, that connect all sets connected by pairs of similarity 4/5 or more."""
    sizes = np.array([len(s) for s in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(words), bool)
    left, found = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        wave = [first] if left[first] else []
        left[first] = False
        while wave and left.any():
            one = wave.pop()
            own = at[begin[one] : begin[one + 1]]
            marked[own] = True
            common = np.bincount(owner[marked[at]], minlength=len(sets))
            marked[own] = False
            near = np.flatnonzero(left & (9 * common >= 4 * (sizes + sizes[one])))
            left[near] = False
            found.extend((one, other) for other in near.tolist())
            wave.extend(near.tolist())
    return found


def _near(word, more, a, b):
    near = np.bitwise_count(word[a] ^ word[b]) <= NEAR_64
    return near & (np.bitwise_count(more[a] ^ more[b]) <= NEAR_32)


def _pairs(word: np.ndarray, more: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the passing pairs of each run of rows, by rising distance of the places."""
    rows, end = _spread(begin, size), np.zeros(len(word), np.int64)
    end[rows] = np.repeat(begin + size, size)
    for step in range(1, int(size.max())):
        rows = rows[rows + step < end[rows]]
        near = _near(word, more, rows, rows + step)
        yield rows[near], rows[near] + step


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, many at once, with every run of equal block and part whole."""
    held: list[list[np.ndarray]] = []
    count = 0

    def joined():
        return [np.concatenate(parts) for parts in zip(*held)]

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += batch.num_rows
        if count >= _ROWS:
            whole = joined()
            other = np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last run may go on
            if cut:
                yield [c[:cut] for c in whole]
            held = [[c[cut:] for c in whole]]
            count = 0
    if held and len((whole := joined())[0]):
        yield whole


def _runs(block: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (part[1:] != part[:-1])]))
    return begin, np.diff(np.append(begin, len(block)))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("block", pa.int32()), ("part", pa.int32())])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passing pairs; of hot runs every row ``b`` with its run, and the first row as ``a`` if the two pass."""

    def out(a, b, **run):
        run = {k: pa.nulls(len(a), pa.int32()) if k not in run else run[k] for k in ("block", "part")}
        return pa.RecordBatch.from_pydict({"a": a, "b": b, **run}, schema=_FOUND)

    for block, part, one, word, more in _blocks(batches):
        word, more = word.view(np.uint64), more.view(np.uint32)
        begin, size = _runs(block, part)
        hot = np.zeros(len(size), bool)
        few = np.flatnonzero((size > 1) & (size <= SMALL))
        if len(few):
            run_of = np.repeat(np.arange(len(size)), size)
            a, b = (np.concatenate(x) for x in zip(*_pairs(word, more, begin[few], size[few])))
            hot = np.bincount(run_of[a], minlength=len(size)) > PAIRS_A_TEXT * size
            cold = ~hot[run_of[a]]
            yield out(one[a[cold]], one[b[cold]])
        for k in np.flatnonzero(size > SMALL).tolist():
            at, n, found, total = int(begin[k]), int(size[k]), [], 0
            for a, b in _pairs(word[at : at + n], more[at : at + n], np.array([0]), np.array([n])):
                found.append((a, b))
                total += len(a)
                if total > PAIRS_A_TEXT * n:
                    hot[k] = True
                    break
            else:
                a, b = (np.concatenate(x) + at for x in zip(*found))
                yield out(one[a], one[b])
        if hot.any():
            rows, first = _spread(begin[hot], size[hot]), np.repeat(begin[hot], size[hot])
            passing = _near(word, more, first, rows) & (first != rows)
            yield out(pa.array(one[first], mask=~passing), one[rows], block=block[rows], part=part[rows])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each run that pass with a text of another group."""
    for block, part, one, word, more, root in _blocks(batches):
        word, more = word.view(np.uint64), more.view(np.uint32)
        marked = np.zeros(len(one), bool)
        for at, n in zip(*(x.tolist() for x in _runs(block, part))):
            group, mark = root[at : at + n], marked[at : at + n]
            if (group == group[0]).all():
                continue
            for a, b in _pairs(word[at : at + n], more[at : at + n], np.array([0]), np.array([n])):
                apart = group[a] != group[b]
                mark[a[apart]] = mark[b[apart]] = True
                if mark.all():
                    break
        yield pa.RecordBatch.from_arrays([pa.array(x[marked]) for x in (block, part, one)], names=["block", "part", "one"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each run of sorted rows, found from the texts."""
    run, names, sets = None, [], []

    def out():
        links = set_forest(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_pydict({"a": [names[a] for a, _ in links], "b": [names[b] for _, b in links]}, schema=_LINKS)

    for batch in batches:
        for *now, name, text in zip(*(column.to_pylist() for column in batch.columns)):
            if now != run:
                yield out()
                run, names, sets = now, [], []
            names.append(name)
            sets.append(shingles_of(text))
    yield out()


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of similarity 4/5 or more; rows come sorted by the first text."""
    name, own = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for k, first in enumerate(a):
            if first != name:
                name, own = first, shingles_of(batch.column(2)[k].as_py())
            other = shingles_of(batch.column(3)[k].as_py())
            common = len(np.intersect1d(own, other, assume_unique=True))
            keep.append(9 * common >= 4 * (len(own) + len(other)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def block_rows(values: DataFrame, piece: int = PIECE, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each text (``one``, ``prints``) and block: the block with its value, the pieces that meet, and the bits compared."""
    blocks = F.array(*[
        F.struct(
            (F.lit((seed * BLOCKS + k) << 16) + F.shiftrightunsigned(F.get("prints", F.lit(seed)), 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int").alias("block"),
            F.get("prints", F.lit((seed + 1) % SEEDS)).alias("word"),
            F.shiftright(F.get("prints", F.lit((seed + 2) % SEEDS)), 32).cast("int").alias("more"),
        )
        for seed in range(SEEDS) for k in range(BLOCKS)
    ])
    rows = values.where(F.size("prints") > 0).select("one", *keep, F.inline(blocks))
    large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece)
    # at most a row per ``piece`` rows, so the table of large blocks is small
    cut = rows.join(F.broadcast(large), "block", "left").withColumn("pieces", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(piece)).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("one"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    met = cut.select("block", "one", "word", "more", "own", *keep, other)
    part = F.shiftleft(F.least("own", "other"), 15).bitwiseOR(F.greatest("own", "other")).alias("part")
    return met.select("block", part, "one", "word", "more", *keep)


def in_runs(rows: DataFrame) -> DataFrame:
    return rows.repartition("block", "part").sortWithinPartitions("block", "part", "one")


def texts_of(named: DataFrame, values: DataFrame, ids: DataFrame) -> DataFrame:
    """``one`` and ``text`` of the texts in ``ids``."""
    wanted = named.join(values.join(ids.distinct(), "one").select("one", "fp"), "fp")
    return materialize(wanted.groupBy("one").agg(F.first(utf8("text")).alias("text")))


def exact_links(named: DataFrame, values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the proposed ``pairs``, those whose texts are near copies."""
    texts = texts_of(named, values, pairs.select(F.explode(F.array("a", "b")).alias("one")))
    both = pairs.join(texts.select(F.col("one").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("one").alias("b"), F.col("text").alias("text_b")), "b")
    ready = both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    return materialize(ready.mapInArrow(_exact, "a bigint, b bigint"))


def links_across(named: DataFrame, values: DataFrame, rows: DataFrame) -> DataFrame:
    """Links that connect the near copies of different groups (``root``) in the same run of ``rows``."""
    met = materialize(in_runs(rows).mapInArrow(_across, "block int, part int, one bigint"))
    texts = texts_of(named, values, met.select("one"))
    together = met.join(texts, "one").select("block", "part", "one", "text")
    together = together.repartition("block", "part").sortWithinPartitions("block", "part")
    return materialize(together.mapInArrow(_forests, "a bigint, b bigint").distinct())


def copy_links(named: DataFrame, prints: DataFrame, piece: int = PIECE) -> DataFrame:
    """Links ``a``, ``b`` that connect all near copies of ``named`` (``fp``, ``text``), given the ``prints`` of each ``fp``."""
    once = prints.dropDuplicates(["fp"]).withColumn("one", F.monotonically_increasing_id())
    values = materialize(once.select("one", "fp", "prints"))
    found = materialize(in_runs(block_rows(values, piece)).mapInArrow(_propose, "a bigint, b bigint, block int, part int"))
    ordinary = found.where("block IS NULL").select("a", "b").distinct()
    least = found.where("block IS NOT NULL AND a IS NOT NULL").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = exact_links(named, values, materialize(ordinary.unionByName(least).distinct()))
    hot = found.where("block IS NOT NULL")
    if not hot.isEmpty():
        linked = connected_components(links).withColumnRenamed("node", "one")
        again = values.join(hot.select(F.col("b").alias("one")).distinct(), "one", "left_semi")
        grouped = again.join(linked, "one", "left").select("one", "prints", F.coalesce("root", "one").alias("root"))
        rows = block_rows(grouped, piece, ("root",)).join(hot.select("block").distinct(), "block", "left_semi")
        links = links.unionByName(links_across(named, values, rows.select("block", "part", "one", "word", "more", "root")))
    by_one = values.select("one", "fp")
    first = links.join(by_one.select(F.col("one").alias("a"), F.col("fp").alias("fp_a")), "a")
    second = first.join(by_one.select(F.col("one").alias("b"), F.col("fp").alias("fp_b")), "b")
    return second.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per document: ``key``, ``fp`` (digest of the text) and ``component`` (the smallest id reachable over links)."""
    worded = utf8(text).cast("string").rlike("[^\\x20\\x09-\\x0D]")
    named = documents.select(
        F.col(key), F.unhex(F.md5(F.when(worded, utf8(text)).otherwise(F.lit(b"")))).alias("fp"), F.col(text).alias("text")
    )
    prints = materialize(named.select(key, "fp", fingerprints("text").alias("prints")))
    links = copy_links(named.select("fp", "text"), prints.select("fp", "prints"), piece)
    groups = materialize(group_table(prints.select(key, "fp"), key, links=links))
    return prints.join(groups, "fp", "left").select(key, "fp", F.coalesce("component", F.col(key)).alias("component"))
