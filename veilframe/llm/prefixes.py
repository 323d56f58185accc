"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

Every turn is a 16-byte digest of (role, text), and a conversation the concatenation of its
turns' digests, so sorting the conversations as bytes puts equal beginnings side by side and a
beginning before what goes on from it. The number of turns that neighbours share is an edge
between them. Taken by falling depth, each edge unites the two components it joins: the
union is the branching node at that depth, and what a component had above is the chain of
unbranched turns down to it.

Sorted rows are range-partitioned on (digests, id), so a conversation that a third of the
rows repeat is spread like any other, and read in blocks of bounded size; each block
is a forest of its own. Only the prefixes that its first or last conversation shares with
the neighbouring blocks are open, at most two spines a block; all other nodes are complete.
The open nodes of all blocks are contracted to one row each with their sums, and merged by the
digest of their prefix; children of an open node look its result up by (block, prefix). No
node, no first turn and no repeated conversation is gathered.

Every sum is one of parts: a node counts for its parent, with its text, in the first
block that holds it; a conversation is a leaf in the block where its last copy stands. The
digest of the ids that end at a node is hashed block-wise as it is read; a run of equal
conversations that crosses partitions leaves pieces of 1 MiB of ids, which one task hashes in
their order without keeping them, as a hash cannot be split.

Defined results: a null id takes no part; null roles and texts are empty; turns are ordered
by number, null first, and equal numbers by role and text digest, repeated rows being turns
of their own; an empty table has no nodes. Other columns are not read. One row holds one
conversation's digests, 24 bytes a turn; texts never leave the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import CRC32_SQL, query, table

WIDTH = 16  # bytes of a digest
BLOCK_ROWS = 20_000
BLOCK_BYTES = 32 * 1024 * 1024
PIECE_BYTES = 1024 * 1024
SHARE_EVERY = 100
SHARE_TURNS = 6

_EMPTY = hashlib.sha256(b"").hexdigest()
_FIELDS = [
    ("block", pa.int64()), ("kind", pa.int8()), ("node", pa.binary()), ("parent", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("pieces", pa.bool_()), ("piece", pa.string()), ("place", pa.int64()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = (
    "block bigint, kind tinyint, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, pieces boolean, "
    "piece string, place bigint"
)
DONE, WAITING, OPEN, PIECE = range(4)  # complete; complete but for the parent's id; part of an open node; ids


def shared(a: bytes, b: bytes) -> int:
    """Number of leading turns that two conversations share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def prefix_key(path: bytes, depth: int) -> bytes:
    """Digest of the first ``depth`` turns."""
    return hashlib.blake2b(path[: depth * WIDTH], digest_size=WIDTH).digest()


class Run:
    """Equal conversations: how many, the smallest id, and the hash of their ids in order."""

    __slots__ = ("path", "sizes", "full", "n", "least", "ends", "pieces", "waiting", "held")

    def __init__(self, path: bytes, sizes: list[int], full: int):
        self.path, self.sizes, self.full = path, sizes, full
        self.n, self.least, self.ends = 0, None, hashlib.sha256()
        self.pieces, self.waiting, self.held = 0, [], 0

    def add(self, conv: int) -> str | None:
        """Take an id; returns a full piece of joined ids, if there is one."""
        self.least = conv if self.least is None else self.least
        name = str(conv)
        self.ends.update(f",{name}".encode() if self.n else name.encode())
        self.n += 1
        self.waiting.append(name)
        self.held += len(name) + 1
        return self.flush() if self.held >= self.full else None

    def flush(self) -> str:
        """The ids since the last piece."""
        piece = ",".join(self.waiting)
        self.pieces, self.waiting, self.held = self.pieces + 1, [], 0
        return piece


class Forest:
    """The nodes of one block of sorted, distinct conversations.

    ``left`` and ``right`` are the numbers of turns that the first and the last one share with the
    neighbouring blocks, -1 where there is none.
    """

    def __init__(self, block: int, runs: list[Run], edges: list[int], left: int, right: int):
        self.block, self.runs, self.left, self.right = block, runs, left, right
        count = len(runs)
        self.above = list(range(count))  # union-find, the root is a component's first conversation
        self.last = list(range(count))  # the rest by component
        self.depth = [len(r.sizes) for r in runs]
        self.n = [r.n for r in runs]
        self.least = [r.least for r in runs]
        after = [*edges, right]
        self.leaves = [int(len(r.sizes) > after[i]) for i, r in enumerate(runs)]
        self.children = [0] * count
        self.saved = [0] * count
        self.rows: list[dict] = []
        self.node = [self._node(i, end=i) for i in range(count)]
        for i in sorted(range(count - 1), key=lambda i: (-edges[i], i)):
            self._unite(self._find(i), self._find(i + 1), edges[i])
        if count:
            self._sink(0, -1)

    def _find(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    def _owned(self, c: int) -> bool:
        return c != 0 or self.depth[c] > self.left

    def _node(self, c: int, end: int | None = None) -> int:
        self.rows.append({"depth": self.depth[c], "end": end, "above": None})
        return len(self.rows) - 1

    def _finish(self, c: int) -> None:
        """Close the component's present node: all of its block's rows below it are known."""
        row, depth = self.rows[self.node[c]], self.depth[c]
        if depth:
            size = self.runs[c].sizes[depth - 1]
            self.saved[c] += self.n[c] * size - (size if self._owned(c) else 0)
        row["open"] = (c == 0 and depth <= self.left) or (self.last[c] == len(self.runs) - 1 and depth <= self.right)
        row["first"] = c
        row["values"] = (self.least[c], self.n[c], self.children[c], self.leaves[c], self.saved[c])

    def _sink(self, c: int, depth: int) -> None:
        """Go down the chain of unbranched turns until the present node stands just above ``depth``."""
        while self.depth[c] > depth + 1:
            self._finish(c)
            below, counted = self.node[c], int(self._owned(c))
            self.depth[c] -= 1
            self.children[c] = counted
            self.node[c] = self.rows[below]["above"] = self._node(c)
        if depth < 0:
            self._finish(c)

    def _unite(self, a: int, b: int, depth: int) -> None:
        """Join component ``b`` to the node of ``a``, its left neighbour, at ``depth``."""
        self._sink(a, depth - 1)
        self._sink(b, depth)
        self._finish(b)
        self.rows[self.node[b]]["above"] = self.node[a]
        self.children[a] += int(self._owned(b))
        self.above[b] = a
        self.last[a] = self.last[b]
        self.n[a] += self.n[b]
        self.least[a] = min(self.least[a], self.least[b])
        self.leaves[a] += self.leaves[b]
        self.saved[a] += self.saved[b]

    def table(self, split: set[int]) -> pa.RecordBatch:
        """One row per node; ``split`` are the conversations whose ids are hashed from pieces."""
        columns: dict[str, list] = {name: [] for name, _ in _FIELDS}
        for row in self.rows:
            least, n, children, leaves, saved = row["values"]
            above = self.rows[row["above"]] if row["above"] is not None else None
            path, depth, end = self.runs[row["first"]].path, row["depth"], row["end"]
            kind = OPEN if row["open"] else WAITING if above and above["open"] else DONE
            look_up = above is not None and kind != DONE
            values = {
                "block": self.block, "kind": kind, "node": prefix_key(path, depth) if kind == OPEN else None,
                "parent": prefix_key(path, depth - 1) if look_up else None, "conv_id": least, "depth": depth,
                "parent_conv_id": above["values"][0] if above and kind == DONE else None, "n_convs": n,
                "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
                "ends_sha256": None if end is None or end in split else self.runs[end].ends.hexdigest(),
                "pieces": end in split, "piece": None, "place": None,
            }
            if kind != OPEN and values["ends_sha256"] is None:
                values["ends_sha256"] = _EMPTY
            for name, value in values.items():
                columns[name].append(value)
        return pa.RecordBatch.from_pydict(columns, schema=_SCHEMA)


def _piece_row(block: int, run: Run, text: str) -> pa.RecordBatch:
    row = {name: [None] for name, _ in _FIELDS}
    row |= {"block": [block], "kind": [PIECE], "node": [prefix_key(run.path, len(run.sizes))], "piece": [text], "place": [run.pieces]}
    return pa.RecordBatch.from_pydict(row, schema=_SCHEMA)


def _blocks(borders: dict[int, tuple[int, int, bool, bool]], limits: tuple[int, int, int]):
    """From sorted rows (partition, digests, sizes, id) to node rows, block by block."""
    rows_at_most, bytes_at_most, piece_bytes = limits

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, runs, edges, held, left = None, 0, [], [], 0, -1

        def cut(right: int, last: bool) -> Iterator[pa.RecordBatch]:
            block = (part << 33) + number
            split = set()
            if borders[part][2] and number == 0:
                split.add(0)
            if borders[part][3] and last:
                split.add(len(runs) - 1)
            for i in sorted(split):
                yield _piece_row(block, runs[i], runs[i].flush())
            yield Forest(block, runs, edges, left, right).table(split)

        for batch in batches:
            for of, path, sizes, conv in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if of != part:
                    if runs:
                        yield from cut(borders[part][1], True)
                    part, number, runs, edges, held, left = of, 0, [], [], 0, borders[of][0]
                if not runs or runs[-1].path != path:
                    if runs:
                        common = shared(runs[-1].path, path)
                        if len(runs) >= rows_at_most or held >= bytes_at_most:
                            yield from cut(common, False)
                            number, runs, edges, held, left = number + 1, [], [], 0, common
                        else:
                            edges.append(common)
                    runs.append(Run(path, sizes, piece_bytes))
                    held += len(path)
                piece = runs[-1].add(conv)
                if piece is not None:
                    yield _piece_row((part << 33) + number, runs[-1], piece)
        if runs:
            yield from cut(borders[part][1], True)

    return forests


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash pieces that come sorted by node and place; keeps no piece."""
    node, digest = None, None
    for batch in batches:
        done = []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(piece.encode())
            elif piece:
                digest.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"node": [k for k, _ in done], "hashed": [h for _, h in done]})
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "hashed": [digest.hexdigest()]})


def _neighbours(placed: DataFrame) -> dict[int, tuple[int, int, bool, bool]]:
    """Per partition: turns shared with the one before and behind (-1: none), and whether a conversation goes on there."""

    def edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = None, None, None
        for batch in batches:
            for of, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != part:
                    if part is not None:
                        yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [last]})
                    part, first = of, path
                last = path
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [last]})

    heads = placed.select("part", "path").mapInArrow(edges_of, "part bigint, first binary, last binary")
    # one row per partition: bounded by the number of partitions
    order = Window.orderBy("part")
    common = F.arrow_udf(
        lambda a, b: pa.array([None if y is None else shared(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64()), "bigint"
    )
    beside = heads.select("part", "last", F.lead("first").over(order).alias("next"))
    found = beside.select("part", common("last", "next"), F.coalesce(F.col("last") == F.col("next"), F.lit(False))).orderBy("part").collect()
    borders, left, goes_on = {}, -1, False
    for part, right, same in found:
        right = -1 if right is None else right
        borders[part] = (left, right, goes_on, same)
        left, goes_on = right, same
    return borders


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation its turns in order: ``conv_id`` and ``turns``, an array of (digest, size)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length tells where it ends
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).alias("size")
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns")
    )


def share_beginnings(sequences: DataFrame, every: int = SHARE_EVERY, turns: int = SHARE_TURNS) -> DataFrame:
    """Each conversation ``c`` with its first crc32(c) % ``turns`` turns taken from conversation ``c - c % every``."""
    own = sequences.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % turns).cast("int"))
    bases = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, turns - 1).alias("start")
    )
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(bases, "base", "left")
    none = F.array().cast(sequences.schema["turns"].dataType)
    start = F.when(F.col("h") > 0, F.slice(F.coalesce("start", none), 1, F.col("h"))).otherwise(none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(start, rest).alias("turns"))


def prefix_trie(
    sequences: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """One row per distinct prefix of the conversations ``conv_id``, ``turns`` (as ``digests`` gives them)."""
    keyed = sequences.select(
        F.concat(F.lit(b""), F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("hexed"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
        "conv_id",
    ).select(F.unhex(F.col("hexed").cast("string")).alias("path"), "sizes", "conv_id")
    ranged = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    placed = materialize(ranged.select(F.spark_partition_id().cast("bigint").alias("part"), "path", "sizes", "conv_id"))
    borders = _neighbours(placed)
    parts = materialize(placed.mapInArrow(_blocks(borders, (block_rows, block_bytes, piece_bytes)), _DDL))
    opened = parts.where(F.col("kind") == OPEN)
    hashed = (
        parts.where(F.col("kind") == PIECE).select("node", "piece", "block", "place")
        .repartition("node").sortWithinPartitions("node", "block", "place")
        .select("node", "piece").mapInArrow(_ends, "node binary, hashed string")
    )
    merged = (
        opened.groupBy("node")
        .agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends"), F.max("pieces").alias("pieces"),
        )
        .join(hashed, "node", "left")
        .withColumn("ends_sha256", F.when(F.col("pieces"), F.col("hashed")).otherwise(F.coalesce("ends", F.lit(_EMPTY))))
    )
    merged = materialize(merged.drop("ends", "hashed", "pieces"))
    found = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    upper = merged.join(found, "parent", "left").withColumn("parent_conv_id", F.col("found"))
    here = opened.select("block", F.col("node").alias("parent")).join(found, "parent")
    waiting = parts.where(F.col("kind") == WAITING).join(here, ["block", "parent"]).withColumn("parent_conv_id", F.col("found"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    done = parts.where(F.col("kind") == DONE)
    return done.select(*columns).unionByName(waiting.select(*columns)).unionByName(upper.select(*columns))


OP12_SQL = f"""
WITH turns AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
               FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(r := r, t := t) ORDER BY i) AS s FROM turns GROUP BY c),
cut AS (SELECT c, s, CAST({CRC32_SQL.format("CAST(c AS VARCHAR)")} % {SHARE_TURNS} AS BIGINT) AS h FROM own),
built AS (SELECT cut.c, list_concat(coalesce(base.s, [])[1 : h], cut.s[h + 1 :]) AS s FROM cut LEFT JOIN own AS base ON base.c = cut.c - cut.c % {SHARE_EVERY}),
prefix AS (SELECT c, d, s[1 : d] AS p, d = len(s) AS ending FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ending), '')) AS ends_sha256,
                CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].t) ELSE 0 END AS saved
         FROM prefix GROUP BY p, d),
child AS (SELECT p[1 : d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
linked AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (p)),
below AS (SELECT p[1 : k] AS p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
          FROM (SELECT p, saved, n_children, unnest(range(d + 1)) AS k FROM linked) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM linked AS n JOIN below USING (p) LEFT JOIN node AS up ON n.d > 0 AND up.p = n.p[1 : n.d - 1]
"""


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(share_beginnings(digests(table(spark, sf_dir, "conversations"))))
