"""Near copies by exact five-word similarity, against brute force."""

import random
from fractions import Fraction

import pytest

import corpus_pipeline
from tests.llm import brute
from veilframe.llm import common, nearcopies, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(autouse=True)
def prepared(spark):
    common.prepare(spark)


def shingles(text):
    words = brute.WORD.findall(brute.lower(text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or Fraction(len(a & b), len(a | b)) >= Fraction(4, 5)


def smallest_linked(rows):
    found = {one: one for one, _ in rows}
    changed = True
    while changed:
        changed = False
        for one, a in rows:
            for other, b in rows:
                if found[other] < found[one] and similar(a, b):
                    found[one], changed = found[other], True
    return found


def changed_copies(seed=3):
    """Texts with copies in which single words differ, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    texts = [None, "", " \n ", "two words", "Two  WORDS", "five words are one shingle", "five words are one"]
    for _ in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(words))
        for n in (1, 2, 3, 4, 5, 6):
            copy = list(words)
            for k in rng.sample(range(5, 195), n):
                copy[k] = "changed"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("piece", [4, 512])
def test_near_copies_equal_brute_force(many_partitions, piece):
    spark, rows = many_partitions, changed_copies()
    found = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), piece=piece).collect()
    assert {r.doc_id: r.component for r in found} == smallest_linked(rows)


def test_pipeline_drops_copies_beyond_three_bits(spark):
    rows = changed_copies()
    docs = spark.createDataFrame([(one, text, "en", "s", len(text or "")) for one, text in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    expected = {one for one, least in smallest_linked(rows).items() if one == least}
    assert kept == expected
    assert len({r.doc_id for r in simhash.keep_one(docs).collect()} - expected) > 5


def test_rows_without_or_with_repeated_ids(spark):
    rows = [(1, "a b"), (1, "c d"), (2, "C  d"), (None, "a b"), (None, "e f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.keep_one(df, find=nearcopies.near_copies)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.where("doc_id IS NOT NULL").collect()) == [(False, 1)]
    assert kept.where("doc_id IS NULL").count() == 2
    assert kept.columns == df.columns
    assert nearcopies.near_copies(df.limit(0)).count() == 0


def test_candidates_come_from_seeded_fingerprints():
    found = nearcopies.shingles_of(" ".join(f"w{k}" for k in range(900)).encode())
    hashes = nearcopies.seeded(found)
    for seed, value in enumerate(nearcopies.fingerprints_of(found).tolist()):
        for bit in range(64):
            ones = sum(h >> bit & 1 for h in hashes[seed].tolist())
            assert value >> bit & 1 == (2 * ones > len(found))


def copies_of_one(n, seed=5):
    """Near copies of one text, and texts that share most words with it but are below 0.8."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for one in range(n):
        copy = list(words)
        for k in rng.sample(range(5, 295), 1 if one % 50 else 8):
            copy[k] = f"x{rng.randrange(10**6)}"
        rows.append((one, " ".join(copy)))
    return rows


def test_large_groups_cost_few_pairs_and_lose_no_link(many_partitions, monkeypatch):
    spark, rows, asked = many_partitions, copies_of_one(300), []
    exact, across = nearcopies.exact_links, nearcopies.links_across

    def counted(named, values, pairs):
        asked.append(pairs.count())
        return exact(named, values, pairs)

    def met(named, values, runs):
        asked.append(runs.count())
        return across(named, values, runs)

    monkeypatch.setattr(nearcopies, "exact_links", counted)
    monkeypatch.setattr(nearcopies, "links_across", met)
    found = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component for r in found} == smallest_linked(rows)
    assert len(asked) == 2 and asked[0] < 10 * len(rows) and asked[1] <= 80 * len(rows)  # pairs are 150 a text
