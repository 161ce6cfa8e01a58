"""Operators against brute force, exact round trips and held-out accuracy on small tables."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelsieve.llm import bpe, chat, common, decontaminate, embeddings, langid, licenses, line_dedup, ngram_join, sharding, warc
from pixelsieve.llm.common import Scratch

SYLLABLES = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed"], "de": ["sch", "ein", "ung", "ver", "ä", "ß", "zu", "pf"], "fr": ["eau", "tion", "é", "que", "è", "ou", "ç", "oi"]}


def prose(r, n, lang="en"):
    return [" ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 9))) for _ in range(n)]


def components_of(nodes, links):
    above = {x: x for x in nodes}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        above[max(p, q)] = min(p, q)
    return {x: root(x) for x in nodes}


# --- 6 ---

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_bpe_is_the_library(reference, text):
    c, library = reference
    ids = c.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, "é" * 10_000, " " * 10_000 + "\n" * 3000, "漢字" * 3000])
def test_bpe_long_pieces(reference, text):
    c, library = reference
    assert np.frombuffer(c.encode(text), "<u4").tolist() == library.encode_ordinary(text)


# --- hashing of words ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n\x0b09_.éß漢", max_size=20)), max_size=8))
def test_words(texts):
    import pyarrow as pa

    for mask, pattern in ((common.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (common.ALNUM_OR_HIGH, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        want = [re.findall(pattern, t) for t in lower]
        hashes, counts = [], []
        for _, raw, offsets in common.utf8_chunks(pa.array(texts, pa.string())):
            h, n = common.words_of(raw, offsets, mask)
            hashes += h.tolist()
            counts += n.tolist()
        assert counts == list(map(len, want))
        flat = [w for ws in want for w in ws]
        assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))


# --- 1 ---



def test_patience():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([(i, r.randint(0, 8)) for i in range(r.randint(0, 14))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        at_a, at_b = dict(a), dict(b)
        assert all(at_a[i] == at_b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    same = [(i, i % 3) for i in range(20)]
    assert line_dedup.patience(same, same) == [(i, i) for i in range(20)]
    unique = [(i, i) for i in range(10)]
    assert line_dedup.patience([(0, 99), *[(i + 1, i) for i in range(10)]], unique) == [(i + 1, i) for i in range(10)]


def naive_removals(texts):
    """Line numbers by document: every run of lines, 8 words or more, that some earlier document holds as a run."""
    own = [[(n, x.strip()) for n, x in enumerate(t.split("\n")) if x.strip()] for t in texts]
    out = []
    for i, lines in enumerate(own):
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = [x for _, x in lines[a:b]]
                if sum(len(x.split()) for x in run) >= line_dedup.BLOCK_WORDS and any([x for _, x in other[c : c + b - a]] == run for other in own[:i] for c in range(len(other))):
                    gone |= {n for n, _ in lines[a:b]}
        out.append(gone)
    return out


def test_line_dedup_by_brute_force(spark):
    """200 corpora, which share no line, against a search of each document's runs in all earlier ones."""
    r = random.Random(9)
    rows, want, blocks_of = [], {}, {}
    for c in range(200):
        lines = [f"{c}.{i}" + " word" * r.choice((0, 1, 2, 4, 8)) for i in range(r.randint(3, 9))]
        texts = []
        for _ in range(r.randint(2, 9)):
            kind = r.random()
            some = r.choice(texts).split("\n") if texts and kind < 0.5 else [r.choice(lines) for _ in range(r.randint(1, 8))]
            if 0.2 < kind < 0.5:  # changed copies: moved, cut, with lines between
                at = r.randrange(len(some))
                some = r.choice([some[at:] + some[:at], some[:at], some[:at] + [f"own {r.random()}", ""] + some[at:], some + some])
            texts.append("\n".join(some) if r.random() < 0.8 else " \n\n".join(some))
        for i, (text, gone) in enumerate(zip(texts, naive_removals(texts), strict=True)):
            rows.append((c * 100 + i, text))
            want[c * 100 + i] = gone
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for row in line_dedup.shared_blocks(df, Scratch(spark)).collect():
        blocks_of[row["doc_id"]] = row
    texts = dict(rows)
    places = {i: [(n, x.strip()) for n, x in enumerate(t.split("\n")) if x.strip()] for i, t in texts.items()}
    assert {i: set(row["removed"]) for i, row in blocks_of.items()} == {i: gone for i, gone in want.items() if gone}
    for i, row in blocks_of.items():  # each block stands in the document that it names
        for b in row["blocks"]:
            n = len(b["lines"])
            here, there = places[i][b["place"] : b["place"] + n], places[b["first"]][b["there"] : b["there"] + n]
            assert [x for _, x in here] == [x for _, x in there] and [x for x, _ in here] == list(b["lines"]) and b["first"] < i
    assert {b["moved"] for row in blocks_of.values() for b in row["blocks"]} == {True, False}
    cut = {x["doc_id"]: (x["text"], x["n_removed"]) for x in line_dedup.dedup_lines(df, Scratch(spark)).collect()}
    assert cut == {i: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]), len(want[i])) for i, t in texts.items()}


def test_line_dedup_of_copies_and_pooled_lines(spark, monkeypatch):
    long = [f"line {i} of ten words in all a b c" for i in range(6)]
    short = [f"three words {i}" for i in range(4)]
    texts = {1: [long[3], long[1]], 2: long, 3: long, 4: [short[0]], 5: [short[1], "x"], 6: [short[2], "y"], 7: [short[3], "z"], 8: short, 9: short[:2] + [long[0]] + short[2:]}
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    for limit in (line_dedup.BROADCAST_IDS, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_IDS", limit)
        got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(df, Scratch(spark)).collect()}
        assert got[3] == ""  # a copy keeps nothing, though a third document has two of its lines in another order
        assert got[2] == "\n".join(long[i] for i in (0, 2, 4, 5))
        assert got[8] == "\n".join(short)  # no document holds these four lines together
        assert got[9] == "\n".join(short)


# --- 9 ---


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join_by_brute_force(spark, k, num):
    r = random.Random(k)
    bases = [" ".join(prose(r, 12)).split() for _ in range(12)]
    texts = []
    for i in range(260):
        words = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 4, 8))):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 2)] = [f"w{r.randint(0, 99)}"] * r.randint(0, 2)
        texts.append((i, " ".join(words[: r.choice((3, 10, 400, 400, 400))])))
    texts += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE")]
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components_of(ids, links)
    got = {x["doc_id"]: x for x in ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), Scratch(spark), k, num, 100).collect()}
    assert {i: x["component_id"] for i, x in got.items()} == want and {i: x["n_shingles"] for i, x in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(ids)


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[rng.random(n) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 6 + 1)))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert np.intersect1d(ngram_join.group_signatures(a, 85, 100), ngram_join.group_signatures(b, 85, 100)).size


def test_tree_yields_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.poisson(0.3, (6, ngram_join.DIMENSIONS))
    points = np.clip(base[rng.integers(0, 6, 150)] + rng.integers(-1, 2, (150, ngram_join.DIMENSIONS)) * (rng.random((150, ngram_join.DIMENSIONS)) < 0.03), 0, 255).astype(np.uint8)
    sizes, parts = points.sum(1, dtype=np.int64), rng.integers(0, 90, 150)
    want = {(i, j) for i in range(150) for j in range(i) if parts[i] != parts[j] and np.minimum(points[i], points[j]).sum() >= ngram_join.least_overlap(sizes[i], sizes[j], 85, 100)}
    found = [(max(x, y), min(x, y)) for a, b in ngram_join.tree_pairs(points, sizes, parts, np.ones(150, bool), 85, 100) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert set(found) == want and len(found) == len(want) > 100
    first = rng.random(150) < 0.5
    split = {(max(x, y), min(x, y)) for a, b in ngram_join.tree_pairs(points, sizes, parts, first, 85, 100) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert split == {(i, j) for i, j in want if first[i] != first[j]}


def test_inner_nodes_lose_no_pair_and_prune():
    rng = np.random.default_rng(2)
    base = rng.poisson(0.2, (40, ngram_join.DIMENSIONS)) * rng.choice([1, 1, 4], (40, 1))
    points = np.clip(base[rng.integers(0, 40, 1500)] + (rng.random((1500, ngram_join.DIMENSIONS)) < 0.01), 0, 255).astype(np.uint8)
    points = points[np.argsort(points.sum(1, dtype=np.int64), kind="stable")]
    sizes, seen = points.sum(1, dtype=np.int64), []
    leaves = {tuple(p) for p in ngram_join.leaf_pairs(points, sizes, ngram_join.excess(points, sizes), 85, 100, seen).tolist()}
    for i in range(0, 1500, 7):
        close = np.flatnonzero(np.minimum(points[i], points).sum(1, dtype=np.int64) >= ngram_join.least_overlap(sizes[i], sizes, 85, 100))
        assert {tuple(sorted((i // ngram_join.LEAF, j // ngram_join.LEAF))) for j in close.tolist()} <= leaves
    assert len(seen) == 4 and seen[-1][0] < 47 * 48 // 2 and len(leaves) < seen[-1][0]


def test_a_row_without_id_bridges_two(spark):
    words = [f"w{i}" for i in range(200)]
    near = lambda *skip: " ".join(w for i, w in enumerate(words) if i not in skip)
    rows = [(7, near(*range(12))), (None, near()), (9, near(*range(188, 200))), (None, None), (None, "other words stand here now")]
    got = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 5, 90, 100).collect()}
    kept = ngram_join.keep_first(spark.createDataFrame([*rows, rows[2], (7, "of the same id, another text"), (None, rows[4][1])], "doc_id long, text string"), Scratch(spark), 5, 90, 100)
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in kept.collect()) == sorted([rows[0], (7, "of the same id, another text"), (0, ""), (0, rows[4][1])])
    assert got == {(7, 184): 7, (None, 196): 7, (9, 184): 7, (None, 0): None, (None, 1): None}


def test_all_pairs_of_open_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "JOINING_SHARE", 2.0)
    monkeypatch.setattr(ngram_join, "BLOCK", 24)
    test_ngram_join_by_brute_force(spark, 2, 50)


def test_blocks_of_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    test_ngram_join_by_brute_force(spark, 4, 85)


# --- 3 ---


def test_embeddings_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(15, 24))
    vectors = (centre[rng.integers(0, 15, 300)] + rng.normal(scale=0.3, size=(300, 24)) * rng.random((300, 1))).astype(np.float32)
    vectors[50:60] = vectors[0]
    labels = rng.integers(0, 3, 300)
    rows = [(i, v, int(y)) for i, (v, y) in enumerate(zip(vectors.tolist(), labels, strict=True))]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), Scratch(spark), 0.93).collect()}
    v = vectors.astype(np.float64)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(300, dtype=bool)
    want = components_of(range(300), np.argwhere(linked).tolist())
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_links"] for i, r in got.items()} == dict(enumerate(linked.sum(1).tolist()))
    assert all(r["kept"] == (i == want[i]) for i, r in got.items()) and linked.sum() > 300


def test_bound_is_rigorous():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(200, 64)) * rng.lognormal(size=(200, 64))
    q, s, back, error = embeddings.quantise(a / np.linalg.norm(a, axis=1)[:, None])
    unit = a / np.linalg.norm(a, axis=1)[:, None]
    approximate = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(unit @ unit.T - approximate) <= back[:, None] * error + error[:, None] * (back + error) + 1e-12).all()
    x, y, full = embeddings.tile_links(a, a, 0.5)
    assert full < 200 * 200 / 4 and set(zip(x, y, strict=True)) == set(map(tuple, np.argwhere(unit @ unit.T >= 0.5)))


# --- 4 ---


def test_decontamination_by_brute_force(spark, monkeypatch):
    r = random.Random(7)
    items = [(i, " ".join(prose(r, r.choice((1, 2, 5, 9))))) for i in range(40)]
    items += [(40 + n, " ".join(f"item{n}x{i}" for i in range(n))) for n in range(1, 8)]
    docs = [(200 + n, " ".join(prose(r, 30)) + f" {x.title()}; " + " ".join(prose(r, 30))) for n, (_, x) in enumerate(items[40:])]
    for i in range(120):
        words = " ".join(prose(r, r.randint(1, 20))).split()
        if i % 3 == 0:
            item = r.choice(items)[1].split()
            cut = r.choice((0, 0, len(item) // 10, len(item) // 4))
            item = item[cut:]
            if r.random() < 0.3 and item:
                item[r.randrange(len(item))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() for w in item]
        docs.append((i, ", ".join(words)))

    def shingles(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} - {()}

    want = {}
    for d, t in docs:
        for i, x in items:
            w = re.findall(r"\w+", x.lower())
            k = min(5, len(w))  # shorter items are sought as they are
            s = shingles(w, k)
            shared = len(s & shingles(re.findall(r"\w+", t.lower()), k))
            if s and shared * 100 >= len(s) * 80:
                want[d, i] = (len(s), shared)
    for limit in (20_000, 0):  # sketches looked up, and joined
        monkeypatch.setattr(decontaminate, "BROADCAST_ENTRIES", limit)
        got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark))
        assert {(x["doc_id"], x["item_id"]): (x["item_shingles"], x["shared"]) for x in got.collect()} == want
    assert len(want) > 20 and {1, 2, 3, 4} <= {len(x.split()) for i, x in items if any(i == j for _, j in want)}


# --- 5 ---

KEPT = ['{"b":1,"a":{"d":2,"c":[1,2.5,"x y"]}}', ' {"k": "\\" , \\\\ {1e5} \\u00e9", "n": 12345678901234567890123456789012345678 }', "{}", '{"a":null,"b":[ ]}', json.dumps({"t": "\\ \"\n" * 20_000})]
RAW = ['{"a":1,"a":2}', '{"a":{"x":1,"x":2}}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1e2}', '{"a":1.50}', '{"a":123456789012345678901234567890123456789}', '{"a":0.1234567890123456789012345678901234567890}', "no", "[1]", "", '{"a":1', "{'a':1}"]


def test_arguments_lose_nothing(spark):
    tool = lambda i, a: json.dumps({"tool_calls": [{"id": f"c{i}", "name": "t", "arguments": a}]})
    rows = [(1, i, "assistant", tool(i, a)) for i, a in enumerate(KEPT + RAW)]
    schemas = spark.createDataFrame([("t", "a", "integer", False)], chat.SCHEMA)
    got = chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas, Scratch(spark))
    written = {r["turn"]: json.loads(r["json"]) for r in got.collect()}
    raw = {r["turn"]: r["json"] for r in got.collect()}
    for i, a in enumerate(KEPT):
        assert written[i]["arguments"] == json.loads(a) and "arguments_text" not in written[i]
        assert json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"), ensure_ascii=False) in raw[i]
    for i, a in enumerate(RAW, len(KEPT)):
        assert written[i]["arguments"] is None and written[i]["arguments_text"] == a and written[i]["errors"], a


def longest_walks(cites):
    """Depth of each call, None where it leads to a cycle."""
    out, left = {}, set(cites)
    while ready := {c for c in left if all(x in out for x in cites[c])}:
        for c in ready:
            out[c] = 1 + max((out[x] for x in cites[c]), default=-1)
        left -= ready
    return out | dict.fromkeys(left)


@pytest.mark.parametrize("grouped", [chat.GROUPED_CITATIONS, 3])
def test_order_by_brute_force(spark, monkeypatch, grouped):
    monkeypatch.setattr(chat, "GROUPED_CITATIONS", grouped)
    r = random.Random(11)
    rows, turns = [], {}
    for conv in range(60):
        names = [f"{conv}.{i}" for i in range(r.randint(1, 9))]
        for name in names:
            turns[conv, name] = r.randint(0, 3)
            rows.append((conv, turns[conv, name], name, [r.choice([*names, "nobody"]) for _ in range(r.randint(0, 2))]))
    got = {(x["conv_id"], x["call_id"]): x for x in chat.order_calls(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after array<string>"), Scratch(spark)).collect()}
    cites = {(c, n): {(c, x) for x in a if (c, x) in turns} for c, _, n, a in rows}
    order = dict(turns)
    while late := {k: max(order[x] for x in v) for k, v in cites.items() if v and max(order[x] for x in v) > order[k]}:
        order |= late
    inside = {k: {x for x in v if order[x] == order[k]} for k, v in cites.items()}
    depth = longest_walks(inside)
    assert {k: (x["order_turn"], x["depth"], x["cyclic"]) for k, x in got.items()} == {k: (order[k], depth[k], depth[k] is None) for k in order}
    assert {None, 0, 1, 2} <= set(depth.values())


def test_long_chains_take_few_jobs(spark, monkeypatch):
    n = 1000
    one = [(1, 5, f"a{i}", [f"a{i - 1}"]) for i in range(n)]  # all in a message
    many = [(2, i, f"b{i}", [f"b{i - 1}"]) for i in range(n)]  # a message each
    scratch, written = Scratch(spark), []
    monkeypatch.setattr(scratch, "write", lambda df, name, write=scratch.write: (written.append(name), write(df, name))[1])
    got = chat.order_calls(spark.createDataFrame(one + many, "conv_id long, turn long, call_id string, after array<string>"), scratch).collect()
    assert {x["call_id"]: (x["order_turn"], x["depth"]) for x in got} == {f"a{i}": (5, i) for i in range(n)} | {f"b{i}": (i, 0) for i in range(n)}
    assert len(written) < 10


# --- 2 ---


def test_license_spans(spark):
    mit = licenses.TEMPLATES["mit-text"]
    edited = mit.replace("free of charge", "entirely free of any charge").replace("publish, distribute,", "")
    rows = [(1, "before " * 7 + mit + " after"), (2, edited.upper()), (3, mit[: len(mit) // 4]), (4, "The MIT  License; mit-license. GNU general public license"), (5, "permission is granted")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit-text" and got[1]["score"] == 1.0 and got[1]["spans"][0]["first"] == 7
    assert got[2]["labels"] == "mit-text" and 0.7 < got[2]["score"] < 1 and len(got[2]["spans"]) == 1
    assert got[3]["labels"] == got[5]["labels"] == "" and got[3]["score"] == 0
    assert (got[4]["base_labels"], got[4]["n_base"], got[4]["first_word"], got[4]["last_word"], got[4]["score"]) == ("gpl,mit", 3, 1, 6, 0.5)


def test_license_mentions_and_adjacent_copies(spark):
    line, isc = licenses.TEMPLATES["gpl-line"], licenses.TEMPLATES["isc-text"]
    rows = [
        (1, "This is not under the MIT License at all"), (2, "x Released under the MIT license y"), (3, f"{line} {line} {line}"), (4, f"{isc} {isc}"),
        (5, "the software is provided as is without warranty of any kind express or implied"), (6, licenses.TEMPLATES["bsd-text"].lower()),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["labels"], got[1]["spans"]) == ("mit", None)  # the base phrase only
    assert got[2]["labels"] == "mit,mit-line" and [tuple(s) for s in got[2]["spans"]] == [("mit-line", 1, 5, 1.0)]
    n = len(licenses._words(line))
    assert [(s["label"], s["first"], s["last"]) for s in got[3]["spans"]] == [("gpl-line", i * n, i * n + n - 1) for i in range(3)]
    n = len(licenses._words(isc))
    assert [(s["label"], s["first"], s["last"]) for s in got[4]["spans"] if s["share"] == 1] == [("isc-text", i * n, i * n + n - 1) for i in range(2)]
    assert got[5]["labels"] == "" and got[6]["labels"] == "bsd-text" and got[6]["score"] == 1.0


# --- 7 ---


def test_language_accuracy_is_held_out(spark):
    r = random.Random(11)
    rows = [(i, " ".join(prose(r, 3, lang)), lang, f"h{i % 7}.site.{lang}") for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train(df.where("doc_id < 300"))
    plain = langid.identify(df.where("doc_id >= 300"), Scratch(spark), model, declared=None).join(df.select("doc_id", "lang"), "doc_id")
    assert plain.where("language = lang").count() >= 0.97 * 300
    fused = langid.identify(df.where("doc_id >= 300"), Scratch(spark), model, host=F.col("source")).join(df.select("doc_id", "lang"), "doc_id")
    assert fused.where("language = lang").count() >= plain.where("language = lang").count()


def test_every_declared_language_is_learned(spark):
    """Rare ones, those beyond any number of others, and those held only in very long or short texts."""
    r = random.Random(21)
    rows = []
    for i in range(210):
        own = [chr(0x4E00 + 40 * i + k) for k in range(40)]
        rows += [(f"x{i:03d}", " ".join("".join(r.choice(own) for _ in range(3)) for _ in range(40))) for _ in range(6 if i < 205 else 1)]
    words = {lang: lambda n, lang=lang: " ".join(prose(r, n, lang)) for lang in SYLLABLES}
    rows += [("de", words["de"](3000)), ("fr", "tion que eau ou"), ("en", words["en"](30)), ("und", words["en"](30)), (" ", words["en"](30))]
    df = spark.createDataFrame([(i, t, x, "h") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert len(rows[-5][1]) > langid.TRAIN_CHARS and len(rows[-4][1]) < 40
    model = langid.train(df)
    assert set(model.languages) == {x for x, _ in rows} - {"und", " "}
    asked = spark.createDataFrame([(1, words["de"](20), "h"), (2, rows[6 * 205][1][:60], "h"), (3, "tion que ou eau", "h")], "doc_id long, text string, source string")
    got = {x["doc_id"]: x["language"] for x in langid.identify(asked, Scratch(spark), model, declared=None).collect()}
    assert got == {1: "de", 2: "x205", 3: "fr"}


def test_other_evidence_decides_what_text_does_not(spark):
    model = langid.fit({"en": [" ".join(prose(random.Random(1), 60))], "de": [" ".join(prose(random.Random(2), 60, "de"))]})
    r = random.Random(3)
    rows = [(i, " ".join(prose(r, 4, "de")), "de", "a.site.de") for i in range(40)] + [(100, "x", None, "a.site.de"), (101, "x", "de", None), (102, "x", None, "new.site.de"), (103, "x", None, "other.de")]
    rows += [(200 + i, " ".join(prose(r, 4)), "en", "b.org") for i in range(60)]
    got = {x["doc_id"]: x["language"] for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), Scratch(spark), model, host=F.col("source")).collect()}
    assert [got[i] for i in (100, 101, 102, 103)] == ["de"] * 4


def test_fusion_by_brute_force(spark):
    """Every posterior computed anew, in plain Python, from the texts' likelihoods."""
    model = langid.fit({x: [" ".join(prose(random.Random(1), 60, x))] for x in ("en", "de")})
    classes, r = model.classes, random.Random(4)
    hosts = [None, "a.site.de", "b.site.de", "x.org", "y.org", "z.x.org", "local", "A.Site.DE"]
    rows = [(i, r.choice(["", "x", "12 !", " ".join(prose(r, r.randint(1, 3), r.choice(("en", "de"))))]), r.choice([None, "de", "en", "en-US", " de ", "fr"]), r.choice(hosts)) for i in range(150)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, host string"), Scratch(spark), model, host=F.col("host"))
    got = {x["doc_id"]: x for x in found.collect()}
    sums, letters = model.likelihoods(pa.array([t for _, t, _, _ in rows]))
    texts = [(s / langid.OVERLAP).tolist() for s in sums]
    of_text = [classes[s.index(max(s))] if n else "und" for s, n in zip(texts, letters, strict=True)]
    said = [d.strip().split("-")[0].lower() if d else None for _, _, d, _ in rows]
    host = [h.lower() if h else None for *_, h in rows]
    site = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1] if "." in h else None

    def counts(ok):
        return [float(sum(t == c for t, o in zip(of_text, ok, strict=True) if o)) for c in classes]

    def drawn(n, prior):
        return [(a + langid.HOST_WEIGHT * p) / (sum(n) + langid.HOST_WEIGHT) for a, p in zip(n, prior, strict=True)]

    everywhere = [(n + 1) / (sum(counts([h is not None for h in host])) + len(classes)) for n in counts([h is not None for h in host])]
    values = {d for d in said if d is not None}
    for i in range(len(rows)):
        score = [t + (math.log(langid.UND_PRIOR) if c == "und" else 0.0) for t, c in zip(texts[i], classes, strict=True)]
        if said[i] is not None:
            here, whole = counts([d == said[i] for d in said]), counts([d is not None for d in said])
            score = [s + math.log((a + langid.DECLARED_WEIGHT) / (b + langid.DECLARED_WEIGHT * len(values))) for s, a, b in zip(score, here, whole, strict=True)]
        if host[i] is not None:
            x = suffix(host[i])
            prior = drawn(counts([h is not None and suffix(h) == x for h in host]), everywhere)
            prior = drawn(counts([h is not None and suffix(h) == x and site(h) == site(host[i]) for h in host]), prior)
            prior = drawn(counts([h == host[i] for h in host]), prior)
            score = [s + math.log(p) for s, p in zip(score, prior, strict=True)]
        best = max(score)
        assert got[i]["language"] == (classes[score.index(best)] if letters[i] else "und"), i
        assert abs(got[i]["confidence"] - 1 / sum(math.exp(s - best) for s in score)) < 1e-9
        assert (got[i]["text_language"], got[i]["declared"], got[i]["n_letters"], got[i]["kept"]) == (of_text[i], said[i], letters[i], got[i]["language"] != "und")
    assert {x["language"] for x in got.values()} == {"en", "de", "und"}


def test_pages_have_evidence(spark):
    html = "<html class=x lang='de'><head><script>var a = 'the';</script></head><body><!-- no --><p>wort &amp; mehr</p></body>"
    row = spark.createDataFrame([("https://m.site.de/x", html), (None, None)], "url string, html string").select(langid.page_host().alias("h"), langid.markup_language().alias("l"), langid.markup_text().alias("t")).collect()
    assert (row[0]["h"], row[0]["l"], row[0]["t"].split()) == ("m.site.de", "de", ["wort", "mehr"]) and row[1]["h"] is None and row[1]["l"] is None


# --- 8 ---


def jump(key, shards):
    b, j = -1, 0
    key %= 1 << 64
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *random.Random(1).sample(range(10**12), 500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100):
        assert {r["k"]: r["s"] for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()} == {k: jump(k, n) for k in keys}
    with pytest.raises(ValueError, match="shard"):
        sharding.jump_shard(F.col("k"), 0)


def test_growth_moves_few(spark):
    rows = sharding.shard_rows(spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 8)
    moved = rows.where("grown_shard <> shard")
    assert moved.where("grown_shard <> 8").count() == 0 and abs(moved.count() - 1000) < 150


def test_one_key_or_row_that_very_many_share(spark, monkeypatch):
    """Slots stay gapless, shards follow the key, and no bin holds a large part of a shared key or row."""
    monkeypatch.setattr(sharding, "PIECE", 10)
    monkeypatch.setattr(sharding, "ROWS_PER_BIN", 50)
    rows = [(7, f"text {i}") for i in range(1000)] + [(7, "same")] * 1003 + [(None, None)] * 400 + [(i, "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.asDict() for r in sharding.shard_rows(df, 8).collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((k is None, k, len(t or "") + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["shard"] == jump(r["doc_id"] or 0, 8) and r["grown_shard"] == jump(r["doc_id"] or 0, 9) for r in got)
    same = sorted(r["slot"] for r in got if r["doc_id"] == 7 and r["size"] == 5)
    assert same[-1] - same[0] > 1003  # pieces of it lie among other rows


# --- 10 ---


def test_archive_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 80_000)
    monkeypatch.setattr(warc, "READ_ROWS", 3)
    r = random.Random(5)
    pages = [(i, None, "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=r.choice([10, 3000, 30_000])))) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {x["page_id"]: x["payload_bytes"] for x in warc.round_trip(df, str(tmp_path / "w")).collect()}
    assert got == {i: len(html) for i, _, html in pages}
    files = [f.stat().st_size for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) > 1 and max(files) <= 80_000 + warc.FILE_PIECES * 31_000 + warc.DICTIONARY_BYTES + 100


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    r = random.Random(3)
    pages = [(i, f"http://h/{i}", None if i % 17 == 0 else " ".join(prose(r, 5)) if i % 3 else "copy") for i in range(60)]
    path = str(tmp_path / "w")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {x["page_id"]: x for x in warc.round_trip(df, path).collect()}
    last = {}
    for i, _, html in pages:
        last[html or ""] = i
    for i, _, html in pages:
        payload = (html or "").encode()
        assert got[i]["payload_bytes"] == len(payload) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if last[html or ""] == i else ("revisit", last[html or ""]))
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) >= 9
    seen = 0
    for f in files:  # each file stands alone: its dictionary first, then records of one frame each
        data = f.read_bytes()
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")])
        assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
        for skippable, frame in warc.frames(data):
            if not skippable:
                assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(bytes(frame)).startswith(b"WARC/1.1\r\n")
                seen += 1
    assert seen == 60


# --- components ---


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 70)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(250)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == components_of(sorted(nodes), [e for e in edges if e[0] != e[1]])
