"""The pipeline's stages in order, each over its own input, against brute force."""

import os

import pytest

import corpus_pipeline
from tests.llm import brute
from veilframe.session import scratch_path

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "test-pipeline")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return [[r.asDict() for r in df.collect()] for df in found]


def by_id(rows):
    return sorted(rows, key=lambda r: r["doc_id"])


def test_order_and_columns(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "line", "SimHash", "benchmark", "mixing"]
    assert all(list(r) == COLUMNS for rows in steps[:5] for r in rows)


def test_quality_keeps_clean_documents(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1]}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert sum(d in kept for d in bad) <= 0.1 * len(bad)
    assert all(r in steps[0] for r in steps[1])


def test_line_dedup(steps):
    before, after = by_id(steps[1]), by_id(steps[2])
    texts = brute.line_dedup([r["text"] for r in before])
    assert [(r["doc_id"], t) for r, t in zip(before, texts)] == [(r["doc_id"], r["text"]) for r in after]
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_dedup(steps):
    rows = by_id(steps[2])
    ids = [r["doc_id"] for r in rows]
    roots = brute.components(ids, [brute.fingerprint(r["text"]) for r in rows])
    assert by_id(steps[3]) == [r for r, root in zip(rows, roots) if r["doc_id"] == root]


def test_decontamination(spark, steps):
    def words(text):
        return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in brute.lower(text or "")).split(" ")

    grams = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        found = [w for w in words(item["text"]) if w]
        grams |= {tuple(found[i : i + 10]) for i in range(max(1, len(found) - 9))} if found else set()

    def clean(text):
        found = [w for w in words(text) if w]
        sizes = {len(g) for g in grams}
        return not any(tuple(found[i : i + n]) in grams for n in sizes for i in range(len(found) - n + 1))

    assert by_id(steps[4]) == [r for r in by_id(steps[3]) if clean(r["text"])]
    assert len(steps[4]) < len(steps[3])


def test_mixing_takes_targets(steps):
    sizes, taken = {}, {}
    for r in steps[4]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"] or ""))
    for r in steps[5]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)
    assert all(taken[s] <= 3 * sizes[s] for s in taken)


def test_run_returns_the_last_stage(spark, steps):
    found = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]

    def key(r):
        return r["doc_id"], r["shard"], r["epoch"], r["place"], r["text"]

    assert sorted(found, key=key) == sorted(steps[5], key=key)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
