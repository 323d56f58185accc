"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilframe.llm import common, decontaminate, extract, lines, mixing, passages, quality, secrets, simhash, topk, warc
from veilframe.llm.components import connected_components
from veilframe.session import scratch_path

DOCS = "doc_id bigint, text string, source string, hits string, score string, n_words int, spans int"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    common.prepare(spark)


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "h", "s", 7, 8) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    return docs(
        spark,
        [
            (1, None, "a"), (2, "", "a"), (3, " \n\t\n ", None), (4, LONG, "b"), (5, LONG, "b"), (5, LONG, "b"),
            (None, "no id " + passage, "c"), (6, passage + " tail", "c"), (7, "head " + passage, None), (8, "é Ü", ""),
        ],
    ).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


# ------------------------------------------------------------------ quality
def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    field = quality.fit(odd, labels)
    scored = quality.with_score(odd, field)
    assert scored.count() == odd.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.with_score(none, field).count() == 0
    no_labels = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.with_score(odd, no_labels).collect()} == {0.5}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    per_doc = np.array([3, 1, 4])
    scores, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    found, _ = quality.marginals(scores, per_doc, moves)
    at = 0
    for n in per_doc:
        weight = np.zeros((n, 2))
        for labels in np.ndindex(*[2] * n):
            w = np.exp(sum(scores[at + k] * y for k, y in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
            for k, y in enumerate(labels):
                weight[k, y] += w
        assert np.allclose(found[at : at + n], weight[:, 1] / weight.sum(axis=1))
        at += n


def test_line_features_are_those_of_single_texts():
    texts = [b"", b"\n", b"One line.", b"A B\n\nC!! C!!\n", "ñandú | 12\nx".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    own, lengths, per_doc = quality.line_features(data, offsets)
    alone = [quality.line_features(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    assert per_doc.tolist() == [t.count(b"\n") + 1 for t in texts]
    assert np.array_equal(own, np.concatenate([a[0] for a in alone]))
    assert np.array_equal(lengths, np.concatenate([a[1] for a in alone]))


# ------------------------------------------------------------------ top-k
def best(rows, k):
    """Brute force over (id, vector); vectors of any length."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for q, a in {i: v for i, v in kept if i % 2 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("shard_rows", [10_000, 40])
def test_top_k_edges(spark, shard_rows):
    rng = random.Random(3)
    rows = [(i, [np.float32(rng.gauss(0, 1)).item() for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # ties
    rows += [(300, None), (302, [1.0, None]), (304, [float("nan")]), (306, [float("inf")]), (None, [1.0]), (308, [0.5]), (310, [])]
    rows += [(7, [0.25] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(0)).withColumn("score", F.lit(0))
    found = topk.top_k(df, df.where("vec_id % 2 = 0"), k=5, shard_rows=shard_rows, leaf=8, block=7)
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(best(rows, 5), key=lambda r: tuple((False, str(x)) for x in r))
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# ------------------------------------------------------------------ lines
def test_line_dedup_edges(spark, odd, none):
    found = lines.dedup_lines(odd)
    assert found.columns == [*odd.columns, "n_lines", "n_equal", "n_near"] and found.count() == odd.count()
    texts = {(r.doc_id, r.source): r.text for r in found.collect()}
    assert texts[1, "a"] is None and texts[2, "a"] == "" and texts[3, None] == " \n\t\n "
    assert sorted(r.text for r in found.where("doc_id IN (4, 5)").collect()) == ["", "", LONG]
    assert lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize("key_type", ["bigint", "string"])
def test_line_dedup_equals_brute_force(many_partitions, key_type):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (19, 20, 39, 40, 80)]
    pool = [*base, "", " ", "Repeated line of some length, the same everywhere."]
    for line in base:
        for _ in range(12):
            x = list(line)
            for _ in range(rng.randrange(1, 4)):
                x[rng.randrange(len(x))] = rng.choice(["", "x", "yz"])
            pool.append("".join(x))
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    df = many_partitions.createDataFrame([(f"{i:03d}" if key_type == "string" else i, t) for i, t in enumerate(texts)], f"doc_id {key_type}, text string")
    found = lines.dedup_lines(df).orderBy("doc_id").collect()
    assert [r.text for r in found] == brute.line_dedup(texts)


def test_edit_distance_equals_brute_force(spark):
    rng = random.Random(5)
    pairs = [("", ""), ("", "ab"), ("abc", "")]
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abé"))
            b.pop(rng.randrange(len(b)))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        for r in df.withColumn("d", lines.edit_distance(F.col("a"), F.col("b"), k)).collect():
            d = brute.edit_distance(r.a, r.b)
            assert r.d == (d if d <= k else None)


# ------------------------------------------------------------------ near-duplicates
def test_simhash_edges(spark, odd, none):
    found = rows_of(simhash.near_duplicates(odd), "doc_id", "fp", "component")
    groups = {r[0]: r[2] for r in found}
    assert len(found) == odd.count() and groups[1] == groups[2] == groups[3] == 1 and groups[4] == groups[5] == 4
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    rows = odd.collect()
    roots = brute.components([r.doc_id for r in rows], [brute.fingerprint(r.text) for r in rows])
    expected = {r.doc_id for r, root in zip(rows, roots) if r.doc_id == root and root is not None}
    assert sorted(x for x in kept if x is not None) == sorted(expected) and kept.count(None) == 1
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprint_hash_is_that_of_spark(spark):
    import xxhash

    texts = ["", "a", "ab cd ef", "é" * 50, LONG]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(np.uint64(xxhash.xxh64_intdigest(r.t.encode(), simhash.SEED)).astype(np.int64) == r.h for r in rows)
    assert [simhash.fingerprint_of(t.encode()) % 2**64 for t in texts] == [brute.fingerprint(t) for t in texts]


@pytest.mark.parametrize("piece", [4096, 16])
def test_links_of_hot_keys_lose_no_group(many_partitions, piece):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    near = [centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))]
    prints = np.unique(np.array([*near, *rng.integers(0, 2**63, 60, dtype=np.uint64)], np.uint64))
    df = many_partitions.createDataFrame([(int(p.astype(np.int64)),) for p in prints], "fp bigint")
    links = simhash.fingerprint_links(df, piece=piece)
    assert links.count() <= 20 * 10 * len(prints)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    expected = brute.components(list(range(len(prints))), prints)
    found = [roots.get(int(p.astype(np.int64)), ("alone", k)) for k, p in enumerate(prints)]
    assert len({(a, b) for a, b in zip(found, expected)}) == len(set(found)) == len(set(expected))


def test_components_of_chains_and_stars(many_partitions):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000), (3, 2), (2, 3)]
    df = many_partitions.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.root for r in connected_components(df).collect()}
    assert found == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(200)}}
    assert connected_components(df.limit(0)).count() == 0


# ------------------------------------------------------------------ passages
def test_passage_edges(odd, none):
    found = passages.dedup_passages(odd)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(found, "doc_id", "n_words", "n_removed", "text") == sorted(
        brute.passages(rows), key=lambda r: tuple((x is None, str(x)) for x in r)
    )
    assert passages.dedup_passages(none).count() == 0


def test_passages_equal_brute_force(many_partitions):
    rng = random.Random(6)
    shared = [[f"s{k}x{i}" for i in range(n)] for k, n in enumerate((12, 13, 14, 40, 200))]
    rows = []
    for d in range(80):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"u{d}y{rng.randrange(10**6)}" for _ in range(rng.randrange(9))]
            part = rng.choice(shared)
            start = rng.randrange(3)
            words += part[start : start + rng.choice([11, 13, 15, 60])]
        rows.append((d // 2 * 2 if d % 20 == 1 else d, rng.choice([" ", "\n", "  "]).join(words)))
    df = many_partitions.createDataFrame(rows, "doc_id bigint, text string")
    found = passages.dedup_passages(df)
    assert sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "text").collect())) == sorted(brute.passages(rows))


def test_cover_has_every_difference():
    assert {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER} == set(range(passages.PERIOD))


# ------------------------------------------------------------------ decontamination
def test_decontamination_edges(spark, odd, none):
    items = spark.createDataFrame(
        [(1, " ".join(f"P{i}!" for i in range(3, 14))), (2, "tail"), (3, None), (4, "..."), (None, "head"), (5, "tail"), (1, "é ü")],
        "item_id bigint, text string",
    )
    expected = {6: ["1", "2", "5"], 7: ["1"], None: ["1"]}
    for bound in (500_000, 2):
        found = decontaminate.find_hits(odd, items, max_windows=bound)
        hits = {r.doc_id: (r["items"], r.n) for r in found.select("doc_id", "hits.items", decontaminate.n_hit(F.col("hits")).alias("n")).collect()}
        assert {d: i for d, (i, _) in hits.items() if i} == expected and hits[6][1] == 12 and hits[7][1] == 11
        assert set(found.columns) == set(odd.columns)
    clean = decontaminate.decontaminate(odd, items)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 4, 5, 5, 8]
    in_parts = decontaminate.decontaminate(odd, items, max_windows=2)
    assert in_parts.columns == odd.columns and sorted(r.doc_id for r in in_parts.collect()) == [1, 2, 3, 4, 5, 5, 8]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(odd, items, drop="spans").collect()}
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(odd, items, drop="spans", max_windows=2).collect()} == cut
    assert cut[6] == "p0 p1 p2  p14 p15 p16 p17 p18 p19 " and cut[4] == LONG and cut[1] is None
    assert decontaminate.find_hits(none, items).count() == 0
    assert decontaminate.find_hits(odd, items.limit(0)).where(F.size("hits.items") > 0).count() == 0


# ------------------------------------------------------------------ secrets
def test_secret_edges(spark, odd, none):
    special = docs(
        spark,
        [
            (1, "é😀 PassWord : 'abcdef' token=ab secret: token: abcdefgh api_key==x" + "AKIA" + "Z" * 16, None),
            (2, "AKIA" + "A" * 15 + " " + "deadbeef" * 3 + " x" + "0" * 23 + "g AKIAAKIA" + "B" * 30, "s"),
            (3, None, "s"), (4, "", "s"), (4, "", "s"), (None, "ghp_x9Kq2LmZ7vT4bN8cR1wY3sA6dF0gH5jP", "s"), (5, "token = " + "a1" * 40_000, "s"),
        ],
    ).unionByName(odd)
    ratios = secrets.train(special)
    assert len(ratios) == 96 * 96
    found = secrets.find_secrets(special, ratios)
    assert found.count() == special.count()
    for r in found.collect():
        expected = brute.secret_spans(r.text)
        assert [(s.start, s.o, s.end) for s in r.base] == expected
        more = [(s.start, s.end) for s in r.spans if s.o == 3]
        assert len(r.spans) == len(expected) + len(more)
        assert not any(a < e and b < z for a, z in more for b, _, e in expected)
    assert secrets.find_secrets(none, secrets.train(none)).count() == 0


def test_random_tokens_are_told_from_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice(["tion", "ment", "er", "an", "in", "on", "re"]) for _ in range(6)) for _ in range(200)]
    text = " ".join(words) + " password=" + "".join(rng.choice("0123456789abcdef") for _ in range(32))
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id bigint, text string")
    ratios = secrets.train(df)
    probe = spark.createDataFrame([(1, "Zx81kQ0pL92mW7vR5tYb " + words[0] + words[1])], "doc_id bigint, text string")
    spans = secrets.find_secrets(probe, ratios).first().spans
    assert [(s.start, s.end) for s in spans] == [(0, 20)]


# ------------------------------------------------------------------ mixing
def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    assert mixing.targets([100, 1, 0], [1, 2, 3]) == [98.0, 3.0, 0.0]
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_splitting_tree_deals_every_block_once():
    tree = mixing.SplittingTree([100, 7, 0, 1000], 9, seed=1)
    sizes = [0] * 9
    for source, quota in enumerate(tree.quotas.tolist()):
        runs = tree.runs(source, 0, quota)
        assert [b for _, a, z in runs for b in range(a, z)] == list(range(quota))
        for shard, a, z in runs:
            sizes[shard] += z - a
        assert all(tree.runs(source, b, b + 1) == [(s, b, b + 1)] for s, a, z in runs for b in (a, z - 1))
    assert sizes == [tree._edge(k + 1) - tree._edge(k) for k in range(9)]


def test_mixing_edges(odd, none):
    planned = mixing.plan(odd, shard_words=5000)
    assert planned.count() == odd.count()
    rows = planned.select("doc_id", "source", "size", "target", mixing.taken().alias("taken")).collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(n - t) <= 0.5 for n, t in by_source.values())
    mixed = mixing.mix(odd, shard_words=5000)
    assert sum(len(brute.WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert set(odd.columns) <= set(mixed.columns)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


# ------------------------------------------------------------------ archives
@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_warc_edges(spark, chunk):
    body = "<p>é\r\n\r\nWARC/1.1\r\n" * 40
    pages = [(1, "u\r\n x", body), (2, None, body), (3, "a", None), (4, "b", ""), (5, "c", "z" * 999), (5, "c", "z" * 999), (6, "c", "z" * 999), (None, "q", "ü" * 333)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    path = scratch_path(spark, "test-warc")
    warc.write_archives(df, path, chunk_bytes=chunk)
    found = warc.read_records(spark, path)
    assert rows_of(found, *found.columns) == sorted(brute.warc_rows([(i, h) for i, _, h in pages]), key=lambda r: tuple((x is None, str(x)) for x in r))
    chunks = warc.read_chunks(spark, path).where("record_type = 'response'")
    assert all(len(r.data) <= chunk for r in chunks.collect())
    empty = scratch_path(spark, "test-warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_records(spark, empty).count() == 0


def test_short_payloads_are_not_revisited(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "xyz"), (4, "d", "xyz")], "page_id bigint, url string, html string")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(df, path, min_revisit=3)
    found = {r.page_id: r.refers_to for r in warc.read_records(spark, path).collect()}
    assert found == {1: None, 2: None, 3: None, 4: 3}


# ------------------------------------------------------------------ pages
SENTENCE = "The quick brown fox jumps over the lazy dog and runs away from the hunters of the wood. "


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<b>b</b>c<p>d &lt;x&gt; &am", "abc d <x> &am"),
        ("<article><p>x</p><table><tr><td>1<td>2</table></article", "x 1 2"),
        ("<nav>open <article><h1>T</h1>body<script>var a='</p>'</script></article>", "T body"),
        ("<body><form><div><p>only text in a form</p></div></form>", "only text in a form"),
        ("<article><!-- c --><p>a<br>b</p><div class='comments'><p>no</p></div><aside>no</aside></article>", "a b"),
    ],
)
def test_small_pages(page, text):
    assert extract.main_text(page) == text


def test_density_finds_an_unmarked_article():
    links = "".join(f"<a href=x{i}>Item {i}</a> " for i in range(20))
    page = (
        f"<body><div>{links}</div><div class=cookie-notice>We use cookies. {SENTENCE}</div><div><div><h2>Head</h2>"
        + f"<p>{SENTENCE}</p>" * 5
        + f"<p>Short.</p></div></div><div id=comments><p>{SENTENCE}</p></div><div>{links}</div></body>"
    )
    assert extract.main_text(page) == " ".join(["Head", *[SENTENCE.strip()] * 5, "Short."])


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>" * 5000 + "deep"), (2, "u", "x &nbsp;&eacute;")], "page_id bigint, url string, html string")
    found = extract.extract(df.withColumn("text", F.lit("old")))
    assert rows_of(found, "page_id", "text", "n_chars") == [(1, "", 0), (2, "deep", 4), (2, "x é", 3), (None, "", 0)]
    assert extract.extract(df.limit(0)).count() == 0
