"""Importance resampling, the prefix trie and byte-level BPE against brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilframe.llm import bpe, prefixes, resample, topk

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("rank", StringType())])
TURNS = StructType(
    [StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
     StructField("text", StringType()), StructField("depth", StringType())]
)


# importance resampling


def features(text):
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def expected_draw(docs, targets, percent, min_words):
    def counts(texts):
        total = [0] * 10000
        for text in texts:
            for f in features(text)[1]:
                total[zlib.crc32(f.encode()) % 10000] += 1
        return total

    s, t = counts([d[1] for d in docs]), counts(targets)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for place, (doc, text) in enumerate(docs):
        words, found = features(text)
        weight = math.floor(sum(gain[zlib.crc32(f.encode()) % 10000] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, len(words) >= min_words, place))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[5]: k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((*r[:4], rank.get(r[5])) for r in rows if r[0] is not None)


def text_of(rnd, n):
    return " ".join(rnd.choice(["Order", "größe", "x1", "a", "the", "über", "naïve", "Z"]) + rnd.choice(["", ".", "-b"]) for _ in range(n))


def test_resampling_equals_brute_force(many_partitions):
    rnd = random.Random(3)
    docs = [(i * 7 - 50, text_of(rnd, rnd.randrange(60))) for i in range(300)] + [(5000, None), (5001, ""), (5002, " .;\n")]
    targets = ["the order of größe", None, "", "x1 x1 x1"]
    spark = many_partitions
    rows = spark.createDataFrame([(*d, "old") for d in docs], DOCS).repartition(5)
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    scored = resample.score_documents(rows, target)
    for percent, words in ((25, 20), (100, 0), (1, 1), (60, 40)):
        found = resample.draw(scored, percent, words).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, found)) == expected_draw(docs, targets, percent, words)


def test_ties_are_cut_by_id_and_repeated_rows_by_place(many_partitions):
    spark = many_partitions
    rows = spark.range(0, 400, 1, 7).select(
        F.when(F.col("id") < 150, F.lit(77)).otherwise(F.col("id") % 60 - 20).alias("doc_id"),
        F.lit(5).cast("bigint").alias("score"), F.lit(30).alias("_vf_words"), "id",
    )
    for percent in (1, 10, 50, 60, 90, 100):
        found = resample.draw(rows, percent).where("rank is not null").orderBy("rank").collect()
        ids = sorted([77] * 150 + [i % 60 - 20 for i in range(150, 400)])
        assert [r["doc_id"] for r in found] == ids[: 4 * percent]
        assert [r["rank"] for r in found] == list(range(1, 4 * percent + 1))
        assert len({r["id"] for r in found}) == len(found)


def test_kth_smallest_counts_only(spark):
    rnd = random.Random(1)
    values = [rnd.choice([-(10**15), 3, 3, 3, rnd.randrange(-50, 50), 10**12]) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in (1, 2, 57, 100, 199, 200):
        value = sorted(values)[k - 1]
        for levels in (1, 4):
            assert resample.kth_smallest(rows, F.col("v"), k, levels) == (value, sum(v < value for v in values))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert resample.draw(resample.score_documents(none, none)).collect() == []
    one = spark.createDataFrame([(None, "a b", "x"), (None, None, None)], DOCS)
    found = resample.draw(resample.score_documents(one, none), 100, 0).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2] and {r["n_features"] for r in found} == {0, 3}
    assert {r["doc_id"] for r in found} == {None}


# prefix trie


def brute_trie(rows, share):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    members, ends, below = {}, {}, {}
    for conv in sorted(own):
        h = zlib.crc32(str(conv).encode()) % 6 if share else 0
        built = own.get(conv - conv % 100, [])[:h] + own[conv][h:]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append(conv)
        ends.setdefault(tuple(built), []).append(conv)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    leaves, saved, rows = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        children = below.get(node, [])
        leaves[node] = sum(leaves[c] for c in children) if children else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[c] for c in children)
        rows.append(
            (members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children), leaves[node],
             saved[node], hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest())
        )
    return sorted(rows, key=str)


def trie_rows(df):
    return sorted(
        map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()),
        key=str,
    )


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limits", [(1, 10**9, 1), (3, 10**9, 9), (10**6, 40, 10**6)])
def test_trie_over_many_borders(many_partitions, seed, limits):
    rnd = random.Random(seed)
    alphabet = "ab" if seed % 2 else "abcdé"
    rows = []
    for conv in range(120):
        script = "aab" if rnd.random() < 0.4 else [rnd.choice(alphabet) for _ in range(rnd.randrange(0, 6))]
        rows += [(conv, k, "u", t * (k + 1)) for k, t in enumerate(script)]
    df = many_partitions.createDataFrame([(*r, "x") for r in rows], TURNS)
    assert trie_rows(prefixes.prefix_trie(prefixes.digests(df), *limits)) == brute_trie(rows, False)


def test_one_repeated_conversation_fills_whole_partitions(many_partitions):
    rows = [(c, k, "user", t) for c in range(300) for k, t in enumerate(["hot", "turn"] if c % 50 else ["hot", f"own {c}"])]
    df = many_partitions.createDataFrame([(*r, None) for r in rows], TURNS)
    for piece in (1, 50, 10**6):
        assert trie_rows(prefixes.prefix_trie(prefixes.digests(df), piece_bytes=piece)) == brute_trie(rows, False)


def test_shared_beginnings_nulls_and_repeated_turns(many_partitions):
    rnd = random.Random(9)
    rows = [
        (rnd.choice([None, *range(250), 1000]), rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, "user", ""]), rnd.choice([None, "", "a", "bb"]))
        for _ in range(900)
    ]
    rows = list({r[:2]: r for r in rows}.values())  # no two turns of a number, whose order is by digest
    df = many_partitions.createDataFrame([(*r, "x") for r in rows], TURNS)
    assert trie_rows(prefixes.prefix_trie(prefixes.share_beginnings(prefixes.digests(df)))) == brute_trie(rows, True)
    twice = [(1, 1, "u", "same")] * 3 + [(2, 1, "u", "same")]
    df = many_partitions.createDataFrame([(*r, "x") for r in twice], TURNS)
    assert trie_rows(prefixes.prefix_trie(prefixes.digests(df))) == brute_trie(twice, False)


def test_trie_of_nothing(spark):
    assert prefixes.prefix_trie(prefixes.share_beginnings(prefixes.digests(spark.createDataFrame([], TURNS)))).collect() == []


def test_roles_and_texts_do_not_run_together(spark):
    df = spark.createDataFrame([(1, 1, "a", "bc", ""), (2, 1, "ab", "c", "")], TURNS)
    assert prefixes.prefix_trie(prefixes.digests(df)).where("depth = 1").count() == 2


# byte-level BPE


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    path = public_tokenizers.path(request.param)
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, bpe.Encoder(ranks, public_tokenizers.PATTERN), library


def numbers(packed):
    return np.frombuffer(packed, "<u4").tolist()


def random_text(rnd, pool):
    pieces = [
        rnd.choice(pool) if rnd.random() < 0.6 else chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x250), rnd.randrange(0x3000, 0x9FFF), 0x1F600, 9, 10, 32, 0x1C, 0x85, 0xA0, 39]))
        for _ in range(rnd.randrange(40))
    ]
    return "".join(pieces)


def test_ids_equal_the_library(both):
    _, encoder, library = both
    rnd = random.Random(5)
    pool = [t.decode("utf-8", "ignore") for t in encoder.vocabulary.ranks]
    for _ in range(400):
        text = random_text(rnd, pool)
        packed = encoder.encode(text)
        assert numbers(packed) == library.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()
    for text in ("a" * 5000, "ab" * 3000, " " * 3000 + "x", "é" * 2000, "1" * 2000, "<|endoftext|>"):
        assert numbers(encoder.encode(text)) == library.encode_ordinary(text)


def test_edits_and_appends_equal_a_new_encoding(both):
    _, encoder, library = both
    rnd = random.Random(6)
    pool = [t.decode("utf-8", "ignore") for t in encoder.vocabulary.ranks]
    for _ in range(400):
        text = random_text(rnd, pool)
        start = rnd.choice([rnd.randrange(len(text) + 1), len(text)])
        stop = min(len(text), start + rnd.choice([0, 1, 5]))
        more = "".join(rnd.choice(["'", "l", "ve", " ", "\n", "a b", "9", "é"]) for _ in range(rnd.randrange(4)))
        changed, packed = encoder.edit(text, encoder.encode(text), start, stop, more)
        assert changed == text[:start] + more + text[stop:]
        assert numbers(packed) == library.encode_ordinary(changed)


def test_prefix_table_grows_and_shrinks(both):
    _, encoder, _ = both
    rnd = random.Random(7)
    known = encoder.vocabulary
    grown = bpe.PrefixTable(known)
    for _ in range(60):
        grown.append(bytes(rnd.choice(b"theandinger") for _ in range(rnd.randrange(5))))
        grown.cut(rnd.randrange(len(grown.data) + 1) if rnd.random() < 0.2 else len(grown.data))
        data = bytes(grown.data)
        assert grown.ids() == known.merged(data)
        assert list(grown.last[1:]) == [known.merged(data[:k])[-1] for k in range(1, len(data) + 1)]


def test_bpe_columns(spark, both):
    path, encoder, library = both
    pattern = public_tokenizers.PATTERN
    texts = [None, "", "Hello wörld", "Hello wörld", "x" * 3000, "  a\n\n b's'll"]
    rows = [(i, t, "token_ids") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    coded = bpe.decode_documents(bpe.encode_documents(df, path, pattern), path, pattern)
    found = coded.select("doc_id", "n_tokens", bpe.unpacked().alias("ids"), F.col("decoded").cast("string").alias("back")).collect()
    for row in found:
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == library.encode_ordinary(text) and row["n_tokens"] == len(row["ids"]) and row["back"] == text
    tokenizer = bpe.Tokenizer(spark, path, pattern)
    edits = [(0, "a b", 1, 2, "ll"), (1, "it'l", None, None, "l ok"), (2, None, 5, 9, "x"), (3, "abc", -4, 99, None), (4, "", 0, 0, "")]
    df = spark.createDataFrame(edits, "i int, text string, s bigint, e bigint, more string").withColumn("ids", tokenizer.encode())
    after = df.select("i", tokenizer.edit("text", "ids", "s", "e", "more").alias("new")).select("i", "new.text", bpe.unpacked("new.token_ids").alias("ids"))
    want = {0: "allb", 1: "it'll ok", 2: "x", 3: "", 4: ""}
    assert {r["i"]: (r["text"], r["ids"]) for r in after.collect()} == {i: (t, library.encode_ordinary(t)) for i, t in want.items()}
    assert bpe.encode_documents(df.limit(0), path, pattern).collect() == []


def test_ranks_without_all_bytes_are_refused():
    with pytest.raises(ValueError, match="256"):
        bpe.Vocabulary({b"a": 0})


# repeated query ids of the exact search


def test_of_repeated_query_ids_the_least_vector_is_asked(many_partitions):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 2.0]), (1, [5.0, 0.0]), (2, [0.0, 5.0])]
    df = many_partitions.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for n in (1, 3):
        found = topk.top_k(df.repartition(n), df.where("vec_id = 0").repartition(n + 1), k=2).orderBy("rank").collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 2, 1024 * 5120), (0, 1, 0)]
