import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelsieve.functions import bloom, buckets, codec, distance, registry
from pixelsieve.functions.synthetic import synthetic_components
from pixelsieve.types import MatchConfig, parse_metric


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(values):
    return F.array(*map(F.lit, values))


def test_distances(spark):
    a, b = [10, 0, 0] + [0] * 141, [8, 5, 1] + [0] * 141
    r = one(spark, l1=distance.compare(array(a), array(b), "l1"), s=distance.compare(array(a), array(b), "l2_squared"), l2=distance.compare(array(a), array(b), "l2"))
    assert (r.l1, r.s, r.l2) == (8.0, 30.0, math.sqrt(30))
    zero = one(spark, n=distance.normalized(array([0] * 144)), u=distance.normalized(array([3, 4] + [0] * 142)), z=distance.is_zero(array([0, 0])))
    assert zero.n == [0.0] * 144 and abs(sum(x * x for x in zero.u) - 1) < 1e-12 and zero.z
    r = one(spark, on=distance.within(F.lit(10.0), 10.0), off=distance.within(F.lit(10.1), 10.0), none=distance.within(F.lit(0.0), 0.0))
    assert (r.on, r.off, r.none) == (True, False, False)


@pytest.mark.parametrize("config", [MatchConfig(m) for m in ("l1", "l2", "l2_squared")] + [MatchConfig("l1", use_normalized=True)])
def test_blocks_equal_columns(spark, config):
    rng = np.random.default_rng(0)
    rows = [(rng.integers(0, 256, 144).tolist(), rng.integers(0, 256, 144).tolist()) for _ in range(20)] + [([0] * 144, [0] * 144)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    want = [r.d for r in df.select(distance.configured("a", "b", config).alias("d")).collect()]
    a, b = (np.array([r[i] for r in rows], np.uint8) for i in (0, 1))
    assert want == distance.paired(a, b, config).tolist()
    assert np.array_equal(np.diag(distance.crossed(a, b, config)), want)
    udf = df.select(distance.distance_udf(config)(distance.from_components("a"), distance.from_components("b")).alias("d"))
    assert [r.d for r in udf.collect()] == want


def test_codec(spark):
    raw = bytes(range(144))
    df = spark.createDataFrame([(raw,)], "b binary")
    r = df.select(codec.encode_hex("b").alias("h"), codec.encode_base64("b").alias("s"), codec.encode_raw("b").alias("r"), codec.encode_blob("b").alias("blob")).first()
    assert r.h == "fp:v1:" + raw.hex() and len(r.s) == 6 + 192 and bytes(r.r) == b"fp:v1:" + raw and bytes(r.blob) == b"\1\0\0\0\1" + raw
    texts = {
        "bare": raw.hex(), "tagged": "fp:v1:" + raw.hex(), "version": "fp:v2:" + raw.hex(), "colon": "fp:v1" + raw.hex(), "short": raw.hex()[2:], "bad": "zz" + raw.hex()[2:],
        "lenient": "fp:v1x:" + raw.hex(),
    }
    got = {n: r.d for n, r in ((n, one(spark, d=codec.decode_hex(F.lit(t)))) for n, t in texts.items())}
    assert {n for n, d in got.items() if d is not None} == {"bare", "tagged", "lenient"}
    assert bytes(one(spark, d=codec.decode_hex(F.lit("1g" + raw.hex()[2:]), lenient=True)).d)[0] == 1
    assert bytes(one(spark, d=codec.decode_hex(F.lit("-1" + raw.hex()[2:]), lenient=True)).d)[0] == 255
    assert one(spark, d=codec.decode_hex(F.lit("zz" + raw.hex()[2:]), lenient=True)).d is None
    plain = r.s.removeprefix("fp:v1:")
    assert bytes(one(spark, d=codec.decode_base64(F.lit(plain[:10] + "\n " + plain[10:]))).d) == raw
    assert one(spark, d=codec.decode_base64(F.lit("!" + plain))).d is None
    assert one(spark, d=codec.decode_blob(F.lit(b"123"))).d is None


@pytest.mark.parametrize(("text", "value"), [("12.5", 12.5), (" 12", None), ("12 ", None), ("12abc", None), ("", None), ("-1e3", -1000.0), (".5", 0.5), ("inf", math.inf), ("-Infinity", -math.inf), ("1e999", None), ("abc", None)])
def test_strict_double(spark, text, value):
    assert one(spark, d=codec.strict_double(F.lit(text))).d == value
    assert codec.parse_double(text) == value


def test_metric_names():
    assert [parse_metric(x) for x in ("l1", "l2", "l2_squared", "l2-squared", "L2", None)] == ["l1", "l2", "l2_squared", "l2_squared", None, None]
    config = MatchConfig(max_results=5)
    assert [config.effective_limit(x) for x in (0, 3, 9)] == [5, 3, 5] and MatchConfig().effective_limit(0) == 0
    got = MatchConfig().resolved(threshold=3.0, env={"PIXELSIEVE_MATCH_METRIC": "l1", "PIXELSIEVE_MATCH_THRESHOLD": "x"})
    assert (got.metric, got.threshold) == ("l1", 3.0)


def fnv(values):
    h = 2166136261
    for x in values:
        h = (h ^ x) * 16777619 % (1 << 32)
    return h % 65536


def test_bucket_keys(spark):
    rng = np.random.default_rng(1)
    c = rng.integers(0, 256, 144).tolist()
    refs = {(r.band_index, r.bucket_key) for r in one(spark, r=buckets.index_refs(array(c))).r}
    want = {(24, fnv(c[:16]))}
    for b in range(12):
        nibbles = [c[12 * b + (5 * g + b) % 12] >> 4 for g in range(4)]
        want |= {(b, fnv(c[12 * b : 12 * b + 12])), (12 + b, int("".join(f"{n:x}" for n in nibbles), 16))}
    assert refs == want and len(refs) == 25
    r = one(spark, a=buckets.similar_probes(array(c), 10.0), b=buckets.similar_probes(array(c), 50.0), c=buckets.similar_probes(array(c), 51.0), n=buckets.nearest_probes(array(c)))
    assert len(r.a) < len(r.b) < len(r.c) <= 300 and len(r.n) == 13
    assert all(12 <= p.band_index < 24 and 0 <= p.bucket_key < 65536 for p in r.c)


def test_registered_for_sql(spark):
    registry.register(spark)
    r = spark.sql("SELECT fp_l1(array(1, 5), array(3, 1)) AS a, fp_l2_squared(array(1, 5), array(3, 1)) AS s, fp_l2(array(0, 3), array(4, 0)) AS l, fp_hex(X'0a') AS h, fp_components(X'0aff') AS c").first()
    assert (r.a, r.s, r.l, r.h, r.c) == (6, 20, 5.0, "fp:v1:0a", [10, 255])


def test_synthetic(spark):
    c = one(spark, c=synthetic_components(F.lit(300)), d=synthetic_components(F.lit(7), 3, shifted=False))
    assert c.c == [(300 + 17 * i + (300 >> 4)) % 256 for i in range(144)] and c.d == [(7 + 3 * i) % 256 for i in range(144)]
    assert distance.stack(pd.Series([bytes(range(144))])).tolist() == [list(range(144))]


def test_bloom(spark):
    assert bloom.size(0) == (0, 0) and bloom.size(1) == (64, 44) and bloom.size(1000) == (9586, 7)
    table = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("query_id"), F.lit(1).alias("algorithm"), F.lit(1).alias("version"), F.unhex(F.hex("id")).alias("bytes"))
    bits, hashes = bloom.size(1000)
    words = bloom.build(table(0, 1000), bits, hashes)
    assert bloom.might_contain(table(0, 1000), words, bits, hashes).count() == 1000
    assert bloom.might_contain(table(10_000, 12_000), words, bits, hashes).count() < 60
    assert bloom.might_contain(table(0, 10), words, 0, 0).count() == 0


def test_doubles_at_the_edges(spark):
    texts = ["1\n", "nan\n", "1e-400", "-0.000e5", "0e-999", "1e400", "4.9e-324", " 1", "inf", "\n1"]
    want = [None, None, None, 0.0, 0.0, None, 5e-324, None, float("inf"), None]
    assert [codec.parse_double(t) for t in texts] == want
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", codec.strict_double("t").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == want
