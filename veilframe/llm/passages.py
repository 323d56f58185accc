"""Substring dedup: passages of ``window`` words that started in an earlier document.

A window is ``window`` (13) consecutive words of one document. Every word covered by a
window whose word sequence also starts in a document with a smaller id is removed;
windows are judged on the input, not on what is left.

Anchors: position p of a document is a cover position when p modulo 7 is 1, 2 or 4, a
difference cover of 7: for any two positions some shift below 7 makes both of them
cover positions. Two equal 13-word windows therefore hold an equal 7-word anchor at
cover positions of both documents, so three positions in seven are hashed and lose no
match. Anchors found in two documents are extended: only windows around them are hashed
in full (96 bits) and compared. A document that repeats the whole text of one with a
smaller id takes no part, as all its windows occur there.

Rows travel as one per hash and Arrow batch of documents with the ids that hold it, so
a passage in a third of all documents costs a row per batch; the decision per hash is a
window function over sorted, spillable partitions. Texts are shuffled once, by id, for
the extension and for the cut.

Defined results: null text has no words; rows without an id are neither cut nor
searched; rows repeating an id are judged by that id and cut each by its own text; equal
texts under one id stay; documents with fewer than 13 words are never cut; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_row, map_batches, query, table, utf8

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)  # every difference modulo 7 is a difference of two of these
# Anchor hashes only propose candidates; 48 bits keep false ones rare and rows short.
_ANCHOR_BITS = np.uint64((1 << 48) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, hence invertible modulo 2**64


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1024, 2 * n)
            steps = np.full((2, size), [[self.base], [self.inverse]], np.uint64)
            steps[:, 0] = 1
            self.up, self.down = np.multiply.accumulate(steps, axis=1)
        return self.up[:n], self.down[:n]


class Hasher:
    """Hashes of all windows of some width, from running sums over word hashes."""

    def __init__(self, window: int = WINDOW):
        self.window, self.width = window, window - PERIOD + 1
        self.powers = [_Powers(b) for b in _BASES]

    @staticmethod
    def words(text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def rolled(self, words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        n = len(words)
        if n < width:
            return np.zeros(0, np.uint64)
        up, down = self.powers[which].upto(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
        value = (sums[width:] - sums[:-width]) * down[: n - width + 1]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(29))

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions with a whole anchor, and the anchors' hashes."""
        if len(words) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rolled = self.rolled(words, self.width)
        at = np.flatnonzero(np.isin(np.arange(len(rolled)) % PERIOD, COVER))
        return at, rolled[at] & _ANCHOR_BITS

    def candidates(self, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a shared anchor."""
        at, hashes = self.anchors(words)
        near = at[np.isin(hashes, shared)]
        last = len(words) - self.window
        starts = (near[:, None] - np.arange(PERIOD)).ravel()
        return np.unique(starts[(starts >= 0) & (starts <= last)])


def _rows_by_hash(hashes: list[np.ndarray], ids: list[int]) -> dict:
    """One row per distinct hash: its smallest id and, if there are more, the other ids."""
    if not hashes:
        return {"h": [], "doc": [], "others": []}
    sizes = [len(h) for h in hashes]
    values, owners = np.concatenate(hashes), np.repeat(np.array(ids, np.int64), sizes)
    order = np.lexsort((owners, *np.atleast_2d(values.T)))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1] if values.ndim == 1 else np.any(values[1:] != values[:-1], axis=1)
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(values)))
    others: list = [None] * len(begin)
    for k in np.flatnonzero(sizes > 1).tolist():
        found = np.unique(owners[begin[k] : begin[k] + sizes[k]])
        others[k] = found[1:].tolist() or None
    return {"h": values[begin], "doc": owners[begin], "others": others}


_ROW = "doc bigint, others array<bigint>"
_ROW_ARROW = [("doc", pa.int64()), ("others", pa.list_(pa.int64()))]


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def make():
        hasher = Hasher(window)

        def rows(batch):
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, hashes = hasher.anchors(hasher.words(text))
                if len(hashes):
                    ids.append(doc)
                    found.append(hashes)
            out = _rows_by_hash(found, ids)
            return {**out, "h": _signed(np.asarray(out["h"], np.uint64))}

        return rows

    schema = pa.schema([("h", pa.int64()), *_ROW_ARROW])
    return map_batches(docs, make, f"h bigint, {_ROW}", schema)


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """Full hashes of the windows around shared anchors; ``docs`` has id, text and anchor hashes."""

    def make():
        hasher = Hasher(window)

        def rows(batch):
            ids, found = [], []
            for doc, text, shared in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = hasher.words(text)
                starts = hasher.candidates(words, np.array(shared, np.int64).view(np.uint64))
                if len(starts):
                    ids.append(doc)
                    found.append(np.stack([hasher.rolled(words, window, k)[starts] for k in (0, 1)], axis=1))
            out = _rows_by_hash(found, ids)
            pairs = np.asarray(out["h"], np.uint64).reshape(-1, 2)
            return {"h": _signed(pairs[:, 0]), "h2": (pairs[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc": out["doc"], "others": out["others"]}

        return rows

    schema = pa.schema([("h", pa.int64()), ("h2", pa.int32()), *_ROW_ARROW])
    return map_batches(docs, make, f"h bigint, h2 int, {_ROW}", schema)


def _copies(docs: DataFrame) -> DataFrame:
    """``doc`` and ``digest`` of texts that a document with a smaller id holds as a whole."""
    first = docs.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = first.where(F.col("first") < F.col("last")).select("digest", "first")
    return docs.select("doc", "digest").join(shared, "digest").where(F.col("doc") > F.col("first")).select("doc", "digest")


def removals(documents: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per id what is to go: hashes of its ``windows`` and digests of whole ``copies``."""
    docs = _texts(documents, key, text)
    copies = _copies(docs.select("doc", F.md5("text").alias("digest")))
    by_doc = copies.groupBy("doc").agg(F.collect_set("digest").alias("copies"))
    own = docs.join(by_doc, "doc", "left").where(~_is_copy()).select("doc", "text")
    anchors = _anchor_rows(own, window)
    same = Window.partitionBy("h")
    several = F.max(F.col("others").isNotNull()).over(same)
    shared = anchors.select(
        "*", (several | (F.min("doc").over(same) != F.max("doc").over(same))).alias("shared")
    ).where("shared")
    holders = F.concat(F.array("doc"), F.coalesce("others", F.array().cast("array<bigint>")))
    listed = shared.select("h", F.explode(holders).alias("doc")).groupBy("doc").agg(F.collect_list("h").alias("shared"))
    around = docs.join(listed, "doc").join(by_doc, "doc", "left").where(~_is_copy())
    windows = _window_rows(around.select("doc", "text", "shared"), window)
    same = Window.partitionBy("h", "h2")
    judged = windows.select("h", F.min("doc").over(same).alias("first"), F.explode(holders).alias("doc"))
    late = judged.where(F.col("doc") > F.col("first")).select("doc", "h", F.lit(None).cast("string").alias("digest"))
    both = late.unionByName(copies.select("doc", F.lit(None).cast("bigint").alias("h"), "digest"))
    return both.groupBy("doc").agg(F.collect_list("h").alias("windows"), F.collect_set("digest").alias("copies"))


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Ids and texts of all rows with an id; every join by ``doc`` on it shares one shuffle of the texts."""
    return documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), utf8(text).alias("text"))


def _is_copy() -> Column:
    return F.coalesce(F.array_contains("copies", F.md5("text")), F.lit(False))


_CUT = "struct<n_words:bigint,n_removed:bigint,kept:binary>"
_CUT_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _cutter(window: int, digest: bool):
    """Cut one text; returns counts and the kept words, or their SHA-256 in hex."""

    def make():
        hasher = Hasher(window)

        def cut(text: bytes, windows: list | None, whole: bool) -> dict:
            words = text.split()
            n, gone = len(words), 0
            if n >= window and whole:
                gone, words = n, []
            elif n >= window and windows:
                hashes = hasher.rolled(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n), window)
                starts = np.flatnonzero(np.isin(hashes, np.array(windows, np.int64).view(np.uint64)))
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + window, -1)
                keep = np.cumsum(edges)[:n] == 0
                gone = int(n - keep.sum())
                words = [w for w, k in zip(words, keep.tolist()) if k]
            kept = b" ".join(words)
            return {"n_words": n, "n_removed": gone, "kept": hashlib.sha256(kept).hexdigest().encode() if digest else kept}

        return cut

    return by_row(make, _CUT, _CUT_ARROW)


def dedup_passages(
    documents: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", digest: bool = False
) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and the kept words joined by spaces (``text``, or ``kept_sha256``)."""
    gone = removals(documents, window, key, text)
    joined = _texts(documents, key, text).join(gone, "doc", "left").select("doc", "text", "windows", _is_copy().alias("whole"))
    nameless = documents.where(F.col(key).isNull()).select(
        F.col(key).alias("doc"), utf8(text).alias("text"), F.lit(None).cast("array<bigint>").alias("windows"), F.lit(False).alias("whole")
    )
    cutter = _cutter(window, digest)(F.col("text"), F.col("windows"), F.col("whole"))
    cut = joined.unionByName(nameless).select(F.col("doc").alias(key), cutter.alias("c"))
    kept = F.col("c.kept").cast("string").alias("kept_sha256" if digest else text)
    return cut.select(key, "c.n_words", "c.n_removed", kept)


_WORD = "[^\\x20\\x09-\\x0D]+"
OP5_SQL = f"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 0))) AS i FROM doc),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS g FROM starts),
owner AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
late AS (SELECT doc_id, i FROM win JOIN owner USING (g) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM late),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM doc),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS kept FROM word
         LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op5_passage_dedup", OP5_SQL)
def op5_passage_dedup(spark, sf_dir):
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
