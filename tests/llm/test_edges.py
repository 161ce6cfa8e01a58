"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pixelsieve.llm import bpe, chat, decontaminate, embeddings, langid, licenses, line_dedup, ngram_join, sharding, warc
from pixelsieve.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon\n" * 3000 + "x" * 50_000
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, LONG, "en", "a", len(LONG)),
    (4, LONG, "en", "a", len(LONG)), (4, "another text under the same id, with words enough for shingles", "en", "b", 1),
    (None, "a text without an id that has words enough for a shingle", "en", "a", 1), (None, None, None, None, None),
    (5, "one", "en", "a", 3), (6, "one two three four", "de", "a", 18), (7, "one two three four", "de", "a", 18), (8, "Ünïcödé 漢字 🎉\u0000 z", "fr", "c.d.e", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that the operators use themselves
    extra = {c: F.lit("x") for c in ("n_tokens", "ids", "size", "shard", "slot", "node", "key", "hash", "words", "label", "removed", "_key", "_n", "language", "kept", "w", "h", "n")}
    return spark.createDataFrame(ROWS, DOCS).withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_sharding(docs, none):
    rows = by_id(sharding.shard_rows(docs, 8))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[1][0]["size"] == 1 and rows[1][0]["text_crc32"] == 0
    assert rows[4][0]["shard"] == rows[4][1]["shard"] == rows[4][2]["shard"]
    assert {r["text_crc32"] for r in rows[8]} == {zlib.crc32(ROWS[-1][1].encode())}
    slots = {}
    for r in (r for group in rows.values() for r in group):
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(none, 8).count() == 0


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = by_id(bpe.encode_texts(docs, path, public_tokenizers.PATTERN, with_ids=True))
    assert rows[1][0]["n_tokens"] == rows[2][0]["n_tokens"] == 0
    assert rows[8][0]["decoded_sha256"] == hashlib.sha256(ROWS[-1][1].encode()).hexdigest()
    assert len(rows[4]) == 3 and "label" in rows[4][0]
    assert bpe.encode_texts(none, path, public_tokenizers.PATTERN).count() == 0


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs, Scratch(docs.sparkSession))
    assert set(docs.columns) <= set(out.columns) and out.count() == len(ROWS)
    rows = by_id(out)
    assert rows[1][0]["text"] is None and rows[1][0]["n_lines"] == 0
    assert sorted(r["text"] == LONG for r in rows[4]) == [False, True, True]  # equal rows are one document
    assert line_dedup.dedup_lines(none, Scratch(none.sparkSession)).count() == 0


def test_licenses(docs, none):
    rows = by_id(licenses.scan(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[1][0]["n_words"] == rows[3][0]["n_words"] == 0 and rows[1][0]["first_word"] is None and rows[1][0]["labels"] == ""
    assert licenses.scan(none).count() == 0


def test_ngram_join(spark, docs, none):
    for k, num in ((4, 85), (5, 80)):
        rows = by_id(ngram_join.jaccard_components(docs, Scratch(spark), k, num, 100))
        assert sum(map(len, rows.values())) == len(ROWS)
        assert [rows[i][0]["n_shingles"] for i in (1, 2, 3, 5)] == [0, 0, 0, 1]
        assert rows[7][0]["component_id"] == 6 and rows[5][0]["component_id"] == 5 and rows[1][0]["component_id"] == 1
    assert ngram_join.jaccard_components(none, Scratch(spark)).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a text without an id that has words"), (5, "delta epsilon ALPHA beta, gamma!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items, Scratch(spark)).collect()}
    assert got == {(5, 3), (6, 3), (7, 3), (None, None), (4, 5)}
    assert decontaminate.contained_items(none, items, Scratch(spark)).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0), Scratch(spark)).count() == 0
    assert {r["doc_id"] for r in decontaminate.clean_documents(docs, items, Scratch(spark)).collect()} == {1, 2, 3, 8, None}


def test_language(spark, docs, none):
    model = langid.fit({"en": ["the quick brown fox jumps over the lazy dog again"], "de": ["der schnelle braune fuchs springt noch einmal"]})
    out = langid.identify(docs, Scratch(spark), model, host=F.col("source"))
    rows = by_id(out)
    assert out.count() == len(ROWS)
    assert [rows[i][0]["kept"] for i in (1, 2, 3)] == [False] * 3 and rows[5][0]["kept"]
    assert langid.identify(none, Scratch(spark), model).count() == 0
    empty = langid.train(none)
    assert empty.languages == () and {r["language"] for r in langid.identify(docs, Scratch(spark), empty).collect()} == {"und"}


def test_embeddings(spark):
    v = [0.1] * 8
    near = [0.1] * 7 + [0.11]
    rows = [(1, v, 1), (2, v, 1), (3, near, 1), (4, v, 2), (5, None, 1), (6, [], 1), (7, [0.0] * 8, 1), (8, [None] + v[1:], 1), (9, [float("nan")] + v[1:], 1), (10, [float("inf")] + v[1:], 1), (11, v, None), (None, v, 1), (2, v, 1), (12, [0.1] * 3, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("x"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(table, Scratch(spark)).collect()}
    assert {i: (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in (1, 2, 3, 4)} == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True)}
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (5, 6, 7, 8, 9, 10, 11, 12))
    assert got[None]["n_links"] == 0
    assert embeddings.near_duplicates(table.limit(0), Scratch(spark)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/\r\nX: y", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "z" * 300_000), (2, "again", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(7)).withColumn("_last", F.lit(1))
    got = [r.asDict() for r in warc.round_trip(pages, Scratch(spark).path("w")).collect()]
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "response", None), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)]
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 2)} == {8}
    assert warc.round_trip(pages.limit(0), Scratch(spark).path("e")).count() == 0


def test_chat(spark):
    call = '{"tool_calls":[{"id":"c1","name":"t","arguments":"{\\"b\\": 1, \\"a\\":\\"x\\"}"},{"id":"c2","name":"t","arguments":"no","after":["c1"]},{"id":null,"name":null,"arguments":null}]}'
    cycle = '{"tool_calls":[{"id":"p","name":"t","arguments":"{}","after":["q"]},{"id":"q","name":"t","arguments":"{}","after":["p"]}]}'
    rows = [(1, 0, "assistant", call), (1, 1, "tool", '{"tool_call_id":"c1","content":"ok"}'), (1, 2, "tool", '{"tool_call_id":"c1","content":"again"}'), (1, 3, "tool", "junk"), (1, 4, "user", None), (1, 5, None, "t"), (None, 0, "assistant", call), (2, None, "tool", '{"tool_call_id":"c1"}'), (3, 0, "assistant", cycle), (1, 6, "assistant", "{tool_calls"), (1, 4, "user", None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit(1))
    schemas = spark.createDataFrame([("t", "a", "string", True), ("t", "b", "integer", True)], chat.SCHEMA)
    got = [r.asDict() for r in chat.link_tool_calls(messages, schemas, Scratch(spark)).collect()]
    one = {(r["kind"], r["call_id"], r["turn"]): r for r in got if r["conv_id"] == 1}
    assert one["call", "c1", 0]["status"] == "linked" and one["call", "c1", 0]["n_errors"] == 0
    assert '"arguments":{"a":"x","b":1}' in one["call", "c1", 0]["json"]
    assert (one["call", "c2", 0]["status"], one["call", "c2", 0]["depth"], one["call", "c2", 0]["n_errors"]) == ("unanswered", 1, 1)
    assert one["result", "c1", 1]["status"] == "linked" and one["result", "c1", 2]["status"] == "repeated" and one["result", None, 3]["status"] == "orphan"
    assert one["message", None, 6]["status"] == "message"
    assert {r["status"] for r in got if r["conv_id"] == 3} == {"cyclic"}
    assert len([r for r in got if r["conv_id"] is None]) == 3
    assert chat.link_tool_calls(messages.limit(0), schemas, Scratch(spark)).count() == 0
