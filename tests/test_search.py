import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelsieve.functions import buckets
from pixelsieve.functions.synthetic import synthetic_components
from pixelsieve.operators import search
from pixelsieve.types import MatchConfig


def catalog_of(spark, n, multiplier=17):
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), F.lit("sample").alias("label"), synthetic_components(F.col("id"), multiplier).alias("components"))
    return search.with_identity(rows)


def asked(spark, rows):
    return search.with_identity(spark.createDataFrame(rows, "query_id long, components array<int>"))


def seed42(multiplier=17):
    c = [(42 + multiplier * i + 2) % 256 for i in range(144)]
    return [(c[0] + 1) % 256, *c[1:]]


@pytest.mark.parametrize(("multiplier", "n", "nearest", "similar"), [(17, 100, 2, 20), (17, 1000, 8, 84), (17, 10_000, 79, 832), (5, 100, 1, 23), (5, 1000, 8, 100)])
def test_candidate_counts(spark, multiplier, n, nearest, similar):
    catalog, query = catalog_of(spark, n, multiplier), asked(spark, [(0, seed42(multiplier))])
    config = MatchConfig(threshold=50.0)
    assert search.candidate_counts(query, catalog, config, "nearest").first()["candidates"] == nearest
    assert search.candidate_counts(query, catalog, config, "similar").first()["candidates"] == similar


def joined_rows(result):
    """What the joins of a result put out, after it has run."""
    result.collect()
    nodes, out = [result._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind.endswith("JoinExec"):
            out.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        children = node.children()
        nodes += [inner] if inner else [children.apply(i) for i in range(children.size())]
    return sum(out)


def similar_by_hand(query, n):
    """How many of n synthetic records have a band whose four nibbles are the query's but for one, two off at most."""
    nibbles = lambda c: np.array([[c[12 * b + (5 * g + b) % 12] >> 4 for g in range(4)] for b in range(12)])
    off = [np.abs(nibbles([(k + (k >> 4) + 17 * i) % 256 for i in range(144)]) - nibbles(query)) for k in range(n)]
    return sum(bool((((d > 0).sum(1) <= 1) & (d.max(1) <= 2)).any()) for d in off)


@pytest.mark.parametrize("mode", ["nearest", "similar"])
def test_candidates_are_counted_without_their_pairs(spark, mode):
    query, config = asked(spark, [(k, seed42()) for k in range(20)]), MatchConfig(threshold=50.0)
    few, many = (search.candidate_counts(query, catalog_of(spark, n), config, mode) for n in (1000, 4000))
    rows = joined_rows(few)
    assert joined_rows(many) == rows < 500
    assert {r["candidates"] for r in many.collect()} == {32 if mode == "nearest" else similar_by_hand(seed42(), 4000)}


@pytest.mark.parametrize("mode", ["nearest", "similar"])
def test_candidate_counts_of_repeated_ids(spark, mode):
    base, far, odd = [100] * 144, [200] * 144, [20, 250] * 72
    rows = [("a", 1, base), ("a", 1, base), ("b", 2, base), ("c", 3, base), ("c", 3, far), ("d", 4, far), ("e", 5, None)]
    catalog = search.with_identity(spark.createDataFrame([(i, s, "x", c) for i, s, c in rows], "id string, seq long, label string, components array<int>"))
    queries = asked(spark, [(1, base), (2, base), (2, base), (3, base), (3, far), (4, odd)])
    got = sorted(map(tuple, search.candidate_counts(queries, catalog, MatchConfig(threshold=50.0), mode).collect()))
    # a record counts once; a query with two fingerprints finds what either finds, once for each of its rows
    assert got == [(1, 3), (2, 6), (3, 8), (4, 7 if mode == "nearest" else 0)]


@pytest.mark.parametrize("threshold", [10.0, 50.0, 240.0])
def test_packed_probes(spark, threshold):
    rng = np.random.default_rng(5)
    rows = asked(spark, list(enumerate(rng.integers(0, 256, (20, 144)).tolist()))).select("query_id", "components")
    whole = rows.select("query_id", F.explode(buckets.packed(buckets.similar_probes(F.col("components"), threshold))))
    each = rows.select("query_id", F.explode(buckets.packed(buckets.nibble_refs(F.col("components")))).alias("ref"))
    each = each.select("query_id", F.explode(buckets.packed_similar_probes(F.col("ref"), threshold)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, each.collect()))


def test_index_equals_scan(spark):
    catalog = catalog_of(spark, 256, 5)
    queries = asked(spark, [(k, [min(255, x + (i == 0)) for i, x in enumerate((k + 5 * j + (k >> 4)) % 256 for j in range(144))]) for k in range(0, 250, 10)])
    config = MatchConfig(threshold=50.0)
    a, b = ({r["query_id"]: tuple(r) for r in search.nearest(queries, catalog, config, index).collect()} for index in ("lsh", "brute"))
    assert {k: v[:3] for k, v in a.items()} == {k: v[:3] for k, v in b.items()}
    a, b = (sorted(map(tuple, search.similar(queries, catalog, config, index=index).collect())) for index in ("lsh", "brute"))
    assert a == b and a


def test_nearest_rules(spark):
    base = [100] * 144
    rows = [("a", 1, "x", base), ("b", 2, "x", base), ("c", 3, "x", [101, *base[1:]]), ("d", 4, "", [50] * 144)]
    catalog = search.with_identity(spark.createDataFrame(rows, "id string, seq long, label string, components array<int>"))
    queries = asked(spark, [(1, base), (2, [102, *base[1:]]), (3, [50] * 144)])
    for index in ("lsh", "brute"):
        got = {r["query_id"]: r for r in search.nearest(queries, catalog, index=index).collect()}
        assert (got[1]["exact_match"], got[1]["id"], got[1]["distance"]) == (True, "a", 0.0)
        assert (got[2]["exact_match"], got[2]["id"], got[2]["distance"]) == (False, "c", 1.0)
        assert not got[3]["exact_match"]  # an empty label isn't enrolled
        empty = search.nearest(queries, catalog.limit(0), index=index).collect()
        assert {(r["exact_match"], r["distance"], r["id"]) for r in empty} == {(False, 0.0, None)}


def test_similar_rules(spark):
    base = [100] * 144
    rows = [(x, i, "x", [100 + i, *base[1:]]) for i, x in enumerate("abcde")] + [("f", 9, "x", [102, *base[1:]])]
    catalog = search.with_identity(spark.createDataFrame(rows, "id string, seq long, label string, components array<int>"))
    query = asked(spark, [(1, base)])
    for index in ("lsh", "brute"):
        ids = lambda **k: [r["id"] for r in search.similar(query, catalog, index=index, **k).orderBy("rank").collect()]  # noqa: E731,B023
        assert ids() == ["b", "c", "f", "d", "e"]  # no exact match; ties in order of insertion
        assert ids(limit=2) == ["b", "c"] and ids(config=MatchConfig(max_results=3), limit=9) == ["b", "c", "f"]
        assert ids(config=MatchConfig(threshold=2.0)) == ["b", "c", "f"] and ids(config=MatchConfig(threshold=0.0)) == []


def test_fallback_of_persistent_stores(spark):
    catalog = search.with_identity(spark.createDataFrame([("a", 1, "x", [200] * 144)], "id string, seq long, label string, components array<int>"))
    query, config = asked(spark, [(1, [90] * 144)]), MatchConfig(threshold=5000.0)
    assert search.similar(query, catalog, config).count() == 0
    assert search.similar(query, catalog, config, fallback="always").count() == 1


def test_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(8, 248, (1000, 144))
    rows = [(str(i), i, "x", c) for i, c in enumerate(base.tolist())]
    catalog = search.with_identity(spark.createDataFrame(rows, "id string, seq long, label string, components array<int>"))
    noisy = np.clip(np.rint(base[:32] + rng.normal(0, 2, (32, 144))), 0, 255).astype(int)
    queries, config = asked(spark, list(enumerate(noisy.tolist()))), MatchConfig(threshold=50.0)
    want, got = ({(r["query_id"], r["id"]) for r in search.similar(queries, catalog, config, index=x).collect()} for x in ("brute", "lsh"))
    assert len(want) >= 32 and len(want & got) >= 0.99 * len(want)
