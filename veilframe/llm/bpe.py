"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A text is cut by a pattern into pieces, and every piece is encoded by itself. A piece that
is a token is that token. For any other, a table holds for each of its byte prefixes the
last token of that prefix's encoding, which is unique: a token may follow the last token of
a shorter prefix only if merging the bytes of the two gives back exactly these two.
Whether it does is found by taking the two apart again and remembered, so the table is filled in
one pass from left to right over the tokens that end at each byte, longest first, and the ids are read off it backwards. Bytes appended to a piece
extend the table without a look at what stands before the longest token, and cutting the
piece cuts the table.

Between pieces the same holds: a place before white space and behind none always parts two
pieces, so ``edit`` re-encodes only from the last such place before an edit to the first one
behind it, and keeps all other ids.

Ids are stored as little-endian unsigned 32-bit integers in one binary value. Texts stay in
their tasks; each task keeps a bounded memory of pieces and of pairs of tokens. The ranks
are read on the driver and broadcast: their size is that of the vocabulary file.

Defined results: null and empty texts have no tokens and decode to the empty text; bytes that
are not UTF-8 count as U+FFFD; repeated rows are encoded alike; an empty table stays empty.
Columns of the input that are called like a result are replaced by it. Unknown ids end
the job.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_row, by_text, query, table, utf8

PIECES = 300_000  # pieces a task remembers before it begins a new memory; the one before is kept beside it
PIECE_BYTES = 64  # longer pieces are not remembered
PAIRS = 1_000_000  # remembered pairs of tokens a task
_ID = np.dtype("<u4")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file with a base64 token and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Tokens by rank, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must hold all 256 single bytes")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        # finds the tokens that end at every byte, longest first; a byte counts as the character of its number
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.ending.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids by the merges alone: the adjacent pair of lowest rank first, the left one on ties. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token`` last; None for a byte or a token that merges do not make."""
        if token not in self._parts:
            data, found = self.tokens[token], None
            pieces = [data[i : i + 1] for i in range(len(data))]
            while len(pieces) > 1:
                joins = [(self.ranks[x + y], i) for i, (x, y) in enumerate(zip(pieces, pieces[1:])) if x + y in self.ranks]
                if not joins:
                    break
                _, i = min(joins)
                if len(pieces) == 2:
                    found = (self.ranks[pieces[0]], self.ranks[pieces[1]])
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            self._parts[token] = found
        return self._parts[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand behind ``before``, or first if that is -1."""
        known = self._pairs.get((before, token))
        if known is None:
            whole = len(self.tokens[token]) == 1 or self.parts(token) is not None
            known = whole and (before < 0 or not self._joined(before, token))
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[before, token] = known
        return known

    def _joined(self, left: int, right: int) -> bool:
        """Whether merges join the last part of ``left`` to the first part of ``right`` before both are whole.

        Looked at backwards in time: the later made of the two is taken apart, and the parts now at
        the border stood side by side until it was made. A join of lower rank came first; so did one of equal rank,
        unless the other merge stood to its left.
        """
        end, ends_left = None, False
        while True:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right])
            if rank is not None and (end is None or rank < end or (rank == end and not ends_left)):
                return True
            apart_left, apart_right = self.parts(left), self.parts(right)
            if apart_left is None and apart_right is None:
                return False
            if apart_right is None or (apart_left is not None and left > right):
                end, ends_left, left = left, True, apart_left[1]
            else:
                end, ends_left, right = right, False, apart_right[0]


class PrefixTable:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last = [-1]  # by length of the prefix
        self.append(data)

    def append(self, more: bytes) -> None:
        """Go on with the bytes ``more``; earlier entries stay as they are."""
        old, known = len(self.data), self.vocabulary
        self.data += more
        self.last.extend([-1] * len(more))
        last, pairs, done = self.last, known._pairs.get, old
        begin = max(0, old - known.longest + 1)
        for end, (back, token) in known.ending.iter(self.data[begin:].decode("latin-1")):
            end += begin + 1
            if end > done:
                before = last[end - back - 1]
                fits = pairs((before, token))
                if fits or (fits is None and known.follows(before, token)):
                    last[end] = token
                    done = end

    def cut(self, size: int) -> None:
        """Keep the first ``size`` bytes."""
        del self.data[size:]
        del self.last[size + 1 :]

    def ids(self) -> list[int]:
        """Ids of the whole piece, read backwards."""
        found, end, last, sizes = [], len(self.data), self.last, self.vocabulary.sizes
        while end:
            token = last[end]
            found.append(token)
            end -= sizes[token]
        return found[::-1]


class Encoder:
    """Encodes and decodes texts; remembers the ids of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        cut = regex.compile(pattern)
        self.find = (lambda text: [m[0] for m in cut.finditer(text)]) if cut.groups else cut.findall
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Packed ids of one piece."""
        data = text.encode()
        packed = self._before.get(text)
        if packed is None:
            whole = self.vocabulary.ranks.get(data)
            ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).ids()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(data) <= PIECE_BYTES:
            if len(self._known) >= PIECES:
                self._known, self._before = {}, self._known
            self._known[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        pieces = self.find(text)
        packed = list(map(self._known.get, pieces))
        at = -1
        for _ in range(packed.count(None)):
            at = packed.index(None, at + 1)
            packed[at] = self._known.get(pieces[at]) or self.piece(pieces[at])
        return b"".join(packed)

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, _ID).tolist()))

    def edit(self, text: str, packed: bytes, start: int, stop: int, insert: str) -> tuple[str, bytes]:
        """``text`` with characters ``start`` to ``stop`` replaced, and its packed ids, encoded anew near the edit only."""
        begin = start - 2  # a piece is decided by two characters behind its end at most
        while begin > 0 and not (text[begin].isspace() and not text[begin - 1].isspace()):
            begin -= 1
        begin = max(begin, 0)
        end = min(stop + 1, len(text))
        while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):
            end += 1
        ends = np.cumsum([self.vocabulary.sizes[i] for i in np.frombuffer(packed, _ID).tolist()], dtype=np.int64)
        head = len(text[:begin].encode())
        tail = head + len(text[begin:end].encode())
        kept, dropped = np.searchsorted(ends, [head, tail], side="right") if len(ends) else (0, 0)
        middle = self.encode(text[begin:start] + insert + text[stop:end])
        return text[:start] + insert + text[stop:], packed[: 4 * kept] + middle + packed[4 * dropped :]


@lru_cache(maxsize=2)
def _encoder(ranks: Broadcast, pattern: str) -> Encoder:
    return Encoder(ranks.value, pattern)


class Tokenizer:
    """Column functions for one rank file and pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))
        self.pattern = pattern

    def _maker(self, use):
        ranks, pattern = self.ranks, self.pattern
        return lambda: use(_encoder(ranks, pattern))

    def encode(self, text: str = "text") -> Column:
        """Packed ids of a text column."""
        make = self._maker(lambda e: lambda value: e.encode(value.decode("utf-8", "replace")))
        return by_text(make, "binary", pa.binary())(utf8(text))

    def decode(self, ids: str | Column = "token_ids") -> Column:
        """Bytes of a column of packed ids; cast to string for the text."""
        packed = F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.lit(b""))
        return by_text(self._maker(lambda e: e.decode), "binary", pa.binary())(packed)

    def edit(self, text: str, ids: str, start: str, stop: str, insert: str) -> Column:
        """``text`` and ``token_ids`` after replacing characters ``start`` to ``stop`` (from 0, end exclusive).

        Places beyond the text mean its end, so a ``start`` of the text's length appends. Null places
        mean the end, null texts count as empty.
        """

        def use(encoder: Encoder):
            def one(value, packed, first, past, more) -> dict:
                value = value.decode("utf-8", "replace")
                first = len(value) if first is None else min(max(first, 0), len(value))
                past = len(value) if past is None else min(max(past, first), len(value))
                changed, ids_of = encoder.edit(value, packed or b"", first, past, more.decode("utf-8", "replace"))
                return {"text": changed, "token_ids": ids_of}

            return one

        returns = pa.struct([("text", pa.string()), ("token_ids", pa.binary())])
        run = by_row(self._maker(use), "struct<text:string,token_ids:binary>", returns)
        return run(utf8(text), F.col(ids), F.col(start).cast("bigint"), F.col(stop).cast("bigint"), utf8(insert))


def unpacked(ids: str = "token_ids") -> Column:
    """Packed ids as an array of numbers."""
    run = by_text(lambda: lambda value: np.frombuffer(value, _ID).tolist(), "array<bigint>", pa.list_(pa.int64()))
    return run(F.coalesce(F.col(ids), F.lit(b"")))


def encode_documents(documents: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The documents with ``token_ids`` (packed) and ``n_tokens``."""
    tokenizer = Tokenizer(documents.sparkSession, path, pattern)
    coded = documents.withColumn("token_ids", tokenizer.encode(text))
    return coded.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("bigint"))


def decode_documents(coded: DataFrame, path: str, pattern: str, name: str = "decoded") -> DataFrame:
    """The rows with the bytes that ``token_ids`` stand for."""
    return coded.withColumn(name, Tokenizer(coded.sparkSession, path, pattern).decode("token_ids"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), rank_file, pattern)
    return decode_documents(coded, rank_file, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
