"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad. Its score takes the line's own features (shares of
character classes, word length, repetition, length, ending) and those of the lines
before and after it; transitions tie neighbouring labels together. Forward-backward
gives each line's probability of being good; their mean, weighted by line length, is
mapped to a document score by a logistic curve fitted on the same training rows.

Training rows are a bounded sample: at most ``per_class`` labelled documents of each
quality, those with the smallest hash of the id, of at most ``max_lines`` lines. Lines
start with their document's label; then lines of bad documents that the model finds
good are relabelled (the worst line stays bad) and the field is fitted again. Features
are computed where the documents are; the driver only sees numbers of the sample.

Defined results: null text counts as empty, an empty text is one empty line and is
scored like any other; labels other than 0 and 1, null ids, and ids without a document
are not used; an id labelled twice is used once, with its smaller label; without rows of
both labels every score is the share of good rows (one half without any). Repeated
documents are scored alike, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, query, table, utf8

PER_CLASS = 1500
MAX_LINES = 200
ROUNDS = 2
STEPS = 100

_CLASSES = 16
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _CALL, _SYMBOL, _BAR, _HIGH, _BREAK = range(11)


def _class_table() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for c in range(128):
        ch = chr(c)
        if ch.islower():
            kind[c] = _LOWER
        elif ch.isupper():
            kind[c] = _UPPER
        elif ch.isdigit():
            kind[c] = _DIGIT
        elif ch == "\n":
            kind[c] = _BREAK
        elif ch.isspace():
            kind[c] = _SPACE
        elif ch in ".,;:?'\"()-":
            kind[c] = _POINT
        elif ch == "!":
            kind[c] = _CALL
        elif ch == "|":
            kind[c] = _BAR
        elif c > 32:
            kind[c] = _SYMBOL
    kind[128:] = _HIGH
    return kind


_KIND = _class_table()
OWN_FEATURES = 14


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte length of each line, and each document's number of lines."""
    breaks = np.flatnonzero(data == 10)
    # equal starts are the empty last line of one text and the first line of the next
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    per_doc = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    spans = np.diff(np.append(starts, len(data)))
    n = len(starts)
    line = np.repeat(np.arange(n), spans)
    kind = _KIND[data]
    counts = np.bincount(line * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float32)
    length = spans - counts[:, _BREAK]
    gap = (kind == _SPACE) | (kind == _BREAK)
    first = np.ones(len(data), bool)
    first[1:] = gap[:-1]
    first[starts[starts < len(data)]] = True
    words = np.bincount(line[first & ~gap], minlength=n).astype(np.float32)
    text = data.tobytes()
    ends = starts + length.astype(np.int64)
    distinct = np.fromiter((len(set(text[s:e].split())) for s, e in zip(starts.tolist(), ends.tolist())), np.float32, n)
    size, letters = np.maximum(length, 1), counts[:, _LOWER] + counts[:, _UPPER]
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(n, np.uint8)
    own = np.stack(
        [
            np.log1p(length) / 5,
            np.log1p(words) / 4,
            counts[:, _UPPER] / np.maximum(letters, 1),
            letters / size,
            counts[:, _DIGIT] / size,
            counts[:, _POINT] / size * 5,
            counts[:, _CALL] / size * 5,
            counts[:, _SYMBOL] / size * 5,
            counts[:, _BAR] / size * 5,
            counts[:, _HIGH] / size,
            (size - counts[:, _SPACE]) / np.maximum(words, 1) / 10,
            distinct / np.maximum(words, 1),
            np.log(np.maximum(words, 1) / np.maximum(distinct, 1)),
            ((last == 46) | (last == 63)) & (length > 0),
        ],
        axis=1,
    ).astype(np.float32)
    return np.minimum(own, 3.0), length.astype(np.float32), per_doc


def with_neighbours(own: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the document, and ends of the document."""
    n = len(own)
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    at = np.cumsum(per_doc)
    opens[at - per_doc] = True
    closes[at - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[opens], after[closes] = 0, 0
    marks = np.stack([opens, closes, np.ones(n, bool)], axis=1).astype(np.float32)
    return np.concatenate([own, before, after, marks], axis=1)


FEATURES = 3 * OWN_FEATURES + 3


@dataclass
class Field:
    """Weights for "good" against "bad", log transition weights [from, to], and the document curve."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 0.0
    offset: float = 0.0


def marginals(scores: np.ndarray, per_doc: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of "good" and the expected number of each transition.

    Documents advance together, longest first, so that a step touches a prefix of them.
    """
    order = np.argsort(-per_doc, kind="stable")
    sizes = per_doc[order]
    begin = (np.cumsum(per_doc) - per_doc)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # documents with more than t lines
    emit = np.stack([np.zeros_like(scores), scores], axis=1)
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(steps):
        at = begin[: alive[t]] + t
        if t == 0:
            forward[at] = emit[at]
        else:
            past = forward[at - 1]
            forward[at] = emit[at] + np.logaddexp(past[:, :1] + moves[0], past[:, 1:] + moves[1])
    for t in range(steps - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        ahead = backward[at + 1] + emit[at + 1]
        backward[at] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(per_doc) - per_doc] = False
    at = np.flatnonzero(inner)
    joint = forward[at - 1][:, :, None] + moves + (emit + backward)[at][:, None, :] - total[at][:, None, None]
    return np.exp(both[:, 1] - total), np.exp(joint).sum(axis=0)


def fit_field(x: np.ndarray, per_doc: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam on all rows."""
    inner = np.ones(len(x), bool)
    inner[np.cumsum(per_doc) - per_doc] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    theta = np.zeros(x.shape[1] + 4)
    mean, power = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        good, expected = marginals(x @ theta[:-4], per_doc, theta[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (labels - good), (seen - expected).ravel()]) / len(x) - 1e-4 * theta
        mean = 0.9 * mean + 0.1 * slope
        power = 0.99 * power + 0.01 * slope**2
        theta += 0.15 * (mean / (1 - 0.9**k)) / (np.sqrt(power / (1 - 0.99**k)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def weighted_mean(values: np.ndarray, lengths: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Per document, the mean of its lines' values weighted by length; lines of blank texts weigh alike."""
    begin = np.cumsum(per_doc) - per_doc
    total = np.add.reduceat(lengths, begin)
    weight = np.where(np.repeat(total, per_doc) > 0, lengths, 1.0)
    return np.add.reduceat(values * weight, begin) / np.add.reduceat(weight, begin)


def train(own: np.ndarray, lengths: np.ndarray, per_doc: np.ndarray, quality: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Fit the field from document labels, relabelling lines of bad documents between rounds."""
    share = float(np.clip(quality.mean(), 0.01, 0.99)) if len(quality) else 0.5
    constant = Field(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    if len(set(quality.tolist())) < 2:
        return constant
    x = with_neighbours(own, per_doc).astype(np.float64)
    begin = np.cumsum(per_doc) - per_doc
    bad_doc = np.repeat(quality == 0, per_doc)
    labels = np.where(bad_doc, 0, 1)
    for k in range(rounds):
        field = fit_field(x, per_doc, labels)
        good, _ = marginals(x @ field.weights, per_doc, field.moves)
        if k < rounds - 1:
            worst = good == np.repeat(np.minimum.reduceat(good, begin), per_doc)
            labels = np.where(bad_doc & ((good < 0.5) | worst), 0, 1)
    level = weighted_mean(good, lengths, per_doc)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-variable logistic curve, classes weighing alike
        p = 1 / (1 + np.exp(-(slope * level + offset)))
        weight = np.where(quality == 1, 0.5 / (quality == 1).sum(), 0.5 / (quality == 0).sum())
        design = np.stack([level, np.ones_like(level)], axis=1)
        pull = design.T @ (weight * (quality - p)) - 1e-4 * np.array([slope, offset])
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(bend, pull)
        slope, offset = slope + step[0], offset + step[1]
    field.slope, field.offset = float(slope), float(offset)
    return field


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _sample(labels: DataFrame, held_out: Column, per_class: int) -> DataFrame:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    once = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [
        once.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)
    ]
    return picked[0].unionByName(picked[1])


def held_out_ids(key: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_lines: int = MAX_LINES, text: str = "text"
) -> Field:
    """Train on a bounded sample of the labelled documents that are not held out."""

    def make():
        def features(batch):
            column = batch.column(2).cast(pa.binary())
            own, lengths, per_doc = line_features(*_bytes_of(column))
            begin = np.cumsum(per_doc) - per_doc
            fits = [k for k in range(len(per_doc)) if per_doc[k] <= max_lines]
            return {
                "doc_id": [batch.column(0)[k].as_py() for k in fits],
                "quality": [batch.column(1)[k].as_py() for k in fits],
                "own": [own[begin[k] : begin[k] + per_doc[k]].tobytes() for k in fits],
                "lengths": [lengths[begin[k] : begin[k] + per_doc[k]].tobytes() for k in fits],
            }

        return features

    schema = pa.schema([("doc_id", pa.string()), ("quality", pa.int32()), ("own", pa.binary()), ("lengths", pa.binary())])
    # at most 2 * per_class ids
    sample = F.broadcast(_sample(labels, held_out_ids(), per_class))
    rows = documents.join(sample, "doc_id").select(F.col("doc_id").cast("string"), F.col("quality").cast("int"), utf8(text))
    found = sorted(map_batches(rows, make, "doc_id string, quality int, own binary, lengths binary", schema).collect())
    own = [np.frombuffer(r["own"], np.float32).reshape(-1, OWN_FEATURES) for r in found]
    lengths = [np.frombuffer(r["lengths"], np.float32) for r in found]
    if not found:
        return train(np.zeros((0, OWN_FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    return train(
        np.concatenate(own), np.concatenate(lengths), np.array([len(x) for x in lengths]), np.array([r["quality"] for r in found])
    )


def score(field: Field, text: str = "text") -> Column:
    """A document's score between 0 and 1."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            if not len(array):
                yield pa.array([], pa.float64())
                continue
            own, lengths, per_doc = line_features(*_bytes_of(array.cast(pa.binary())))
            good, _ = marginals(with_neighbours(own, per_doc) @ field.weights, per_doc, field.moves)
            level = weighted_mean(good, lengths, per_doc)
            yield pa.array(1 / (1 + np.exp(-(field.slope * level + field.offset))), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(utf8(text))


def with_score(documents: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Documents with ``score`` and ``predicted`` (1 from one half on)."""
    return documents.withColumn("score", score(field, text)).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


@query("op1_quality_crf")
def op1_quality_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, field).select("doc_id", held_out_ids().alias("held_out"), "score", "predicted")
