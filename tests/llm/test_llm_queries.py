"""The registered queries over whole small tables: against SQL, or against brute force."""

import base64
import hashlib
import html
import os
import re

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from tests.harness import connect, spark_rows, sql_rows
from tests.llm import brute
from veilframe.llm import secrets
from veilframe.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def rows_of(spark, name, *columns):
    found = QUERIES[name](spark, SF).select(*columns).collect()
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, x) for x in r))


def test_all_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) < set(names) and "pipeline" in names
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    assert (columns, rows) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", ["op3_line_dedup", "op7_secret_spans"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|ArrowEval", plan)


def test_quality_on_held_out_documents(spark):
    found = QUERIES["op1_quality_crf"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert rows and right >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_simhash_groups(spark, docs):
    prints = [brute.fingerprint(t) for _, t, _ in docs]
    roots = brute.components([d for d, _, _ in docs], prints)
    expected = [(d, f"{p:016x}", r) for (d, _, _), p, r in zip(docs, prints, roots)]
    assert rows_of(spark, "op4_simhash_groups", "doc_id", "fingerprint", "component_id") == expected


def test_bpe_equals_the_library(spark, docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for doc, text, _ in docs:
        ids = library.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        expected.append((doc, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows_of(spark, "op13_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_secret_spans(spark, docs):
    found = rows_of(spark, "op7_secret_spans", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for (doc, text, _), row in zip(docs, found):
        spans = brute.secret_spans(text)
        listed = [f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in spans]
        counts = tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert row[:5] == (doc, *counts, hashlib.sha256(",".join(listed).encode()).hexdigest())
        assert set(listed) <= set(row[5].split(",")) or not listed


def test_mix_meets_targets(spark, docs):
    found = rows_of(spark, "op8_source_mix", "doc_id", "size", "source_size", "target", "taken")
    assert found == rows_of(spark, "op8_source_mix", "doc_id", "size", "source_size", "target", "taken")
    sizes = {d: len(brute.WORD.findall(t or "")) for d, t, _ in docs}
    per_source, taken, target = {}, {}, {}
    for (d, _, s), row in zip(docs, found):
        assert row[1] == sizes[d] and row[4] <= 3 * row[1]
        per_source[s] = per_source.get(s, 0) + row[1]
        taken[s] = taken.get(s, 0) + row[4]
        target[s] = row[3]
    assert all(row[2] == per_source[s] for (_, _, s), row in zip(docs, found))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    names = sorted(per_source)
    share = {s: target[s] / (1 + k % 3) for k, s in enumerate(names) if target[s] < 3 * per_source[s] - 1e-9}
    assert max(share.values()) - min(share.values()) < 1e-6


def test_warc_round_trip(spark, con):
    pages = con.execute("SELECT page_id, html FROM pages").fetchall()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(spark, "op9_warc_round_trip", *columns) == sorted(brute.warc_rows(pages))


def test_main_text_is_the_article(spark, con):
    found = rows_of(spark, "op10_main_text", "page_id", "url", "text", "n_chars")
    pages = con.execute("SELECT page_id, url, html FROM pages ORDER BY page_id").fetchall()
    assert len(found) == len(pages)
    for (page, url, markup), row in zip(pages, found):
        article = re.search("<article>(.*?)</article>", markup, re.S)[1]
        text = re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))
        text = " ".join(html.unescape(text).split())
        assert row == (page, url, text, len(text))
