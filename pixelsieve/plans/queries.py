"""The engine's registered queries over the driver's tables, each with its SQL.

The tables hold no images. Fingerprints are therefore derived: a synthetic catalog by rule from
``documents`` and one of quantised ``embeddings``. Searches ask with every row whose id is
divisible by 100, against all rows; every second of those is perturbed in its first component, so
that exact, similar and no matches all occur.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.functions import bloom, buckets, codec, distance, kernel
from pixelsieve.functions.synthetic import synthetic_components
from pixelsieve.operators import classify, evaluate, policy, scan, search
from pixelsieve.sources import datasets
from pixelsieve.sources.images import with_fingerprints
from pixelsieve.sources.shared import remove, shared_dir
from pixelsieve.sources.store import FingerprintStore
from pixelsieve.types import InputRequirements, MatchConfig, ModelMetadata, OutputMapping

SIMILAR, EMBEDDING = MatchConfig(threshold=50.0), MatchConfig(threshold=240.0)
MAPPING = OutputMapping(("clean", "flagged", "explicit"), "explicit", 0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- fixtures: the same rules in both languages ---------------------------------------------------

PERTURBED = "(({id} // 100) % 2 = 0)"


def synthetic_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.lit("sample").alias("label"), synthetic_components(F.col("doc_id")).alias("components"))
    return search.with_identity(rows)


def embedding_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda i: F.floor((F.col("embedding")[i % 64].cast("double") + 1.0) * 127.5).cast("int")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("seq"), F.lit("sample").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(143)), value).alias("components"))
    return search.with_identity(rows)


def perturbed_queries(catalog: DataFrame) -> DataFrame:
    moved = F.pmod(F.floor(F.col("seq") / 100), F.lit(2)) == 0
    first = F.when(moved, F.pmod(F.col("components")[0] + 1, F.lit(256))).otherwise(F.col("components")[0])
    rows = catalog.where(F.col("seq") % 100 == 0)
    rows = rows.select(F.col("seq").alias("query_id"), F.concat(F.array(first), F.slice("components", 2, 143)).alias("components"))
    return search.with_identity(rows)


def _seeded(seed: str, extra: str = "0") -> str:
    return f"list_transform(range(0, 144), lambda i: (({seed}) + (({seed}) >> 4) + 17 * i + {extra}) % 256)"


def _list_hex(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda b: format('{{:02x}}', b)), '')"


def _fold(values: str, step: str, start: str = "0") -> str:
    return f"list_reduce({values}, lambda h, x: {step}, {start})"


_FNV = "(xor(h, x) * 403) & 65535"
_SQUARES = "list_transform(list_zip(q.c, t.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"
_L2 = f"sqrt(CAST(list_sum({_SQUARES}) AS DOUBLE))"

SYNTHETIC_SQL = f"""catalog AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS seq, 'sample' AS label, {_seeded('doc_id')} AS c FROM documents)"""
EMBEDDING_SQL = """catalog AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id AS seq, 'sample' AS label,
    list_transform(range(0, 144), lambda i: CAST(floor((CAST(embedding[(i % 64) + 1] AS DOUBLE) + 1.0) * 127.5) AS BIGINT)) AS c FROM embeddings)"""
QUERIES_SQL = """queries AS (SELECT seq AS query_id,
    list_concat([CASE WHEN (seq // 100) % 2 = 0 THEN (c[1] + 1) % 256 ELSE c[1] END], c[2:144]) AS c FROM catalog WHERE seq % 100 = 0)"""


def _nibble_sql(c: str, b: int) -> list[str]:
    return [f"({c}[{12 * b + (5 * g + b) % 12 + 1}] >> 4)" for g in range(4)]


def _exact_sql(c: str, b: int) -> str:
    return _fold(f"{c}[{12 * b + 1}:{12 * b + 12}]", _FNV, "40389")


def _prefix_sql(c: str) -> str:
    return _fold(f"{c}[1:16]", _FNV, "40389")


def _refs_sql(c: str = "c") -> str:
    refs = [f"{{'band_index': 24, 'bucket_key': {_prefix_sql(c)}}}"]
    for b in range(12):
        n = _nibble_sql(c, b)
        refs += [f"{{'band_index': {b}, 'bucket_key': {_exact_sql(c, b)}}}"]
        refs += [f"{{'band_index': {12 + b}, 'bucket_key': ({n[0]} << 12) + ({n[1]} << 8) + ({n[2]} << 4) + {n[3]}}}"]
    return "[" + ", ".join(refs) + "]"


def _nearest_probe_sql(c: str = "c") -> str:
    return "[" + ", ".join([f"{{'band_index': 24, 'bucket_key': {_prefix_sql(c)}}}"] + [f"{{'band_index': {b}, 'bucket_key': {_exact_sql(c, b)}}}" for b in range(12)]) + "]"


def _similar_probe_sql(delta: int, c: str = "c") -> str:
    bands = []
    for b in range(12):
        n = _nibble_sql(c, b)
        key = f"({n[0]} << 12) + ({n[1]} << 8) + ({n[2]} << 4) + {n[3]}"
        keys = [f"[{key}]"]
        for g, shift in enumerate((12, 8, 4, 0)):
            for s in [s for s in range(-delta, delta + 1) if s]:
                keys.append(f"CASE WHEN {n[g]} + ({s}) BETWEEN 0 AND 15 THEN [{key} + ({s * (1 << shift)})] ELSE [] END")
        flat = f"flatten([{', '.join(keys)}])"
        bands.append(f"list_transform({flat}, lambda k: {{'band_index': {12 + b}, 'bucket_key': k}})")
    return f"flatten([{', '.join(bands)}])"


BUCKETS_SQL = f"refs AS (SELECT id, seq, unnest({_refs_sql()}, recursive := true) FROM catalog)"


def _candidates_sql(probe: str, queries: str) -> str:
    return f"""probes AS (SELECT query_id, p.band_index, p.bucket_key, pos FROM (
        SELECT query_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT query_id, {probe} AS ps FROM {queries}))),
    candidates AS (SELECT query_id, id, seq, min(pos) AS probe FROM probes JOIN refs USING (band_index, bucket_key) GROUP BY ALL)"""


_EXACT_SQL = "exact AS (SELECT q.query_id, arg_min(t.id, t.seq) AS id, arg_min(t.label, t.seq) AS label, min(t.seq) AS seq FROM queries q JOIN catalog t ON q.c = t.c GROUP BY ALL)"
_REST_SQL = "rest AS (SELECT * FROM queries WHERE query_id NOT IN (SELECT query_id FROM exact))"
_FINISH_SQL = """SELECT q.query_id, e.query_id IS NOT NULL AS exact_match,
    CASE WHEN e.query_id IS NOT NULL THEN 0.0 ELSE coalesce(n.distance, 0.0) END AS distance,
    coalesce(e.id, n.id) AS id, coalesce(e.label, n.label) AS label, coalesce(e.seq, n.seq) AS seq
    FROM queries q LEFT JOIN exact e USING (query_id) LEFT JOIN near n USING (query_id)"""


def _nearest_brute_sql(fixture: str) -> str:
    return f"""WITH {fixture}, {QUERIES_SQL}, {_EXACT_SQL}, {_REST_SQL},
    pairs AS (SELECT q.query_id, t.id, t.label, t.seq, {_L2} AS distance FROM rest q, catalog t),
    near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, seq) = 1)
    {_FINISH_SQL}"""


def _nearest_lsh_sql(fixture: str) -> str:
    return f"""WITH {fixture}, {QUERIES_SQL}, {_EXACT_SQL}, {_REST_SQL}, {BUCKETS_SQL}, {_candidates_sql(_nearest_probe_sql(), 'rest')},
    pairs AS (SELECT q.query_id, t.id, t.label, t.seq, k.probe, {_L2} AS distance FROM candidates k JOIN rest q USING (query_id) JOIN catalog t ON t.seq = k.seq
        UNION ALL SELECT q.query_id, t.id, t.label, t.seq, 0, {_L2} FROM rest q, catalog t WHERE q.query_id NOT IN (SELECT query_id FROM candidates)),
    near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, probe, seq) = 1)
    {_FINISH_SQL}"""


def _similar_sql(fixture: str, threshold: float, lsh: bool, fallback: bool = False) -> str:
    head = f"WITH {fixture}, {QUERIES_SQL}"
    source = "queries q, catalog t"
    if lsh:
        head += f", {BUCKETS_SQL}, {_candidates_sql(_similar_probe_sql(buckets.neighbour_delta(threshold)), 'queries')}"
        rest = " UNION ALL SELECT q.query_id, t.seq FROM queries q, catalog t WHERE q.query_id NOT IN (SELECT query_id FROM candidates)" if fallback else ""
        source = f"(SELECT query_id, seq FROM candidates{rest}) k JOIN queries q USING (query_id) JOIN catalog t ON t.seq = k.seq"
    return f"""{head}, pairs AS (SELECT q.query_id, t.id, t.label, t.seq, {_L2} AS distance FROM {source} WHERE q.c <> t.c)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, seq) AS rank, id, label, seq, distance FROM pairs WHERE distance <= {threshold}"""


# --- queries ------------------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


@query(f"WITH {SYNTHETIC_SQL} SELECT id, seq, {_list_hex('c')} AS hex FROM catalog")
def synthetic_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_catalog(spark, sf_dir).select("id", "seq", F.lower(F.hex("bytes")).alias("hex"))


@query(f"WITH {EMBEDDING_SQL} SELECT id, seq, {_list_hex('c')} AS hex FROM catalog")
def embedding_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_catalog(spark, sf_dir).select("id", "seq", F.lower(F.hex("bytes")).alias("hex"))


def _distance_query(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = embedding_catalog(spark, sf_dir).select("seq", "components")
        b = a.select((F.col("seq") - 1).alias("seq"), F.col("components").alias("other"))
        d = distance.normalized_l2("components", "other") if metric == "normalized" else distance.compare("components", "other", metric)
        return a.join(b, "seq").select("seq", d.alias("distance"))

    return run


_NORMAL = "list_transform(v, lambda x: CASE WHEN s <= 2.220446049250313e-16 THEN x ELSE x * (1.0 / sqrt(s)) END)"
_DISTANCE_SQL = {
    "l1": "CAST(list_sum(list_transform(list_zip(q.c, t.c), lambda p: abs(p[1] - p[2]))) AS DOUBLE)",
    "l2": _L2,
    "l2_squared": f"CAST(list_sum({_SQUARES}) AS DOUBLE)",
}
for _metric, _sql in _DISTANCE_SQL.items():
    query(f"WITH {EMBEDDING_SQL} SELECT q.seq, {_sql} AS distance FROM catalog q JOIN catalog t ON t.seq = q.seq + 1", f"distance_{_metric}")(_distance_query(_metric))
query(
    f"""WITH {EMBEDDING_SQL}, doubles AS (SELECT seq, list_transform(c, lambda x: CAST(x AS DOUBLE) / 255.0::DOUBLE) AS v FROM catalog),
    sums AS (SELECT seq, v, {_fold('list_transform(v, lambda y: y * y)', 'h + x', '0.0::DOUBLE')} AS s FROM doubles),
    units AS (SELECT seq, {_NORMAL} AS u FROM sums)
    SELECT q.seq, sqrt({_fold('list_transform(list_zip(q.u, t.u), lambda p: (p[1] - p[2]) * (p[1] - p[2]))', 'h + x', '0.0::DOUBLE')}) AS distance
    FROM units q JOIN units t ON t.seq = q.seq + 1""",
    "distance_normalized",
)(_distance_query("normalized"))


@query(f"WITH {SYNTHETIC_SQL} SELECT id, unnest({_refs_sql()}, recursive := true) FROM catalog")
def band_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.buckets(synthetic_catalog(spark, sf_dir)).drop("seq")


@query(f"WITH {EMBEDDING_SQL}, {QUERIES_SQL} SELECT query_id, unnest({_nearest_probe_sql()}, recursive := true) FROM queries")
def probe_refs_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = perturbed_queries(embedding_catalog(spark, sf_dir))
    return asked.select("query_id", F.inline(buckets.nearest_probes(F.col("components"))))


@query(f"WITH {EMBEDDING_SQL}, {QUERIES_SQL} SELECT query_id, unnest({_similar_probe_sql(2)}, recursive := true) FROM queries")
def probe_refs_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = perturbed_queries(embedding_catalog(spark, sf_dir))
    return asked.select("query_id", F.inline(buckets.similar_probes(F.col("components"), 50.0)))


def _counts_sql(probe: str, fallback: bool) -> str:
    none = "(SELECT count(*) FROM catalog)" if fallback else "0"
    return f"""WITH {SYNTHETIC_SQL}, {QUERIES_SQL}, {BUCKETS_SQL}, {_candidates_sql(probe, 'queries')}
    SELECT query_id, CASE WHEN count(id) = 0 THEN {none} ELSE count(id) END AS candidates FROM queries LEFT JOIN candidates USING (query_id) GROUP BY query_id"""


@query(_counts_sql(_nearest_probe_sql(), True))
def candidates_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = synthetic_catalog(spark, sf_dir)
    return search.candidate_counts(perturbed_queries(catalog), catalog, SIMILAR, "nearest")


@query(_counts_sql(_similar_probe_sql(2), False))
def candidates_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = synthetic_catalog(spark, sf_dir)
    return search.candidate_counts(perturbed_queries(catalog), catalog, SIMILAR, "similar")


@query(f"WITH {SYNTHETIC_SQL}, {QUERIES_SQL}, {_EXACT_SQL} SELECT query_id, id, seq, label FROM exact")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = synthetic_catalog(spark, sf_dir)
    return search.exact_matches(perturbed_queries(catalog), catalog)


@query(f"WITH {SYNTHETIC_SQL}, {QUERIES_SQL}, {_EXACT_SQL} SELECT query_id FROM exact")
def bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookups behind a Bloom filter: the filter turns away no match."""
    catalog = synthetic_catalog(spark, sf_dir)
    bits, hashes = bloom.size(catalog.count())
    asked = bloom.might_contain(perturbed_queries(catalog), bloom.build(catalog, bits, hashes), bits, hashes)
    return search.exact_matches(asked, catalog).select("query_id")


def _search_query(fixture: Callable, run: Callable) -> Query:
    def own(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = fixture(spark, sf_dir)
        return run(perturbed_queries(catalog), catalog)

    return own


for _name, _fixture, _text, _config in (("synthetic", synthetic_catalog, SYNTHETIC_SQL, SIMILAR), ("embedding", embedding_catalog, EMBEDDING_SQL, EMBEDDING)):
    query(_nearest_brute_sql(_text), f"nearest_brute_{_name}")(_search_query(_fixture, lambda q, t, c=_config: search.nearest(q, t, c, "brute")))
    query(_nearest_lsh_sql(_text), f"nearest_lsh_{_name}")(_search_query(_fixture, lambda q, t, c=_config: search.nearest(q, t, c)))
    query(_similar_sql(_text, _config.threshold, False), f"similar_brute_{_name}")(_search_query(_fixture, lambda q, t, c=_config: search.similar(q, t, c, index="brute")))
    query(_similar_sql(_text, _config.threshold, True), f"similar_lsh_{_name}")(_search_query(_fixture, lambda q, t, c=_config: search.similar(q, t, c)))
query(_similar_sql(EMBEDDING_SQL, EMBEDDING.threshold, True, True), "similar_persistent")(_search_query(embedding_catalog, lambda q, t: search.similar(q, t, EMBEDDING, fallback="always")))
query(f"SELECT * FROM ({_similar_sql(EMBEDDING_SQL, EMBEDDING.threshold, False)}) WHERE rank <= 3", "similar_limited")(_search_query(embedding_catalog, lambda q, t: search.similar(q, t, EMBEDDING, 3, "brute")))


@query(f"""WITH {EMBEDDING_SQL}, {QUERIES_SQL} SELECT q.query_id, count(*) AS within FROM queries q, catalog t WHERE {_L2} <= 230.0 GROUP BY ALL""")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = embedding_catalog(spark, sf_dir)
    found = search.scan_similar(perturbed_queries(catalog), catalog, MatchConfig(threshold=230.0))
    return found.groupBy("query_id").agg(F.count("*").alias("within"))




@query(f"""WITH {SYNTHETIC_SQL.replace('catalog AS', 'every AS', 1)}, catalog AS (SELECT arg_min(id, seq) AS id, min(seq) AS seq, c FROM every GROUP BY c),
    queries AS (SELECT seq AS query_id, c FROM catalog), {BUCKETS_SQL}, {_candidates_sql(_similar_probe_sql(2), 'queries')}
    SELECT k.query_id AS a, k.seq AS b, {_L2} AS distance FROM candidates k JOIN catalog q ON q.seq = k.query_id JOIN catalog t ON t.seq = k.seq WHERE k.query_id < k.seq AND {_L2} <= 50.0""")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near_duplicate_pairs(synthetic_catalog(spark, sf_dir), SIMILAR)


@query(f"WITH {SYNTHETIC_SQL} SELECT id, 'fp:v1:' || {_list_hex('c')} AS encoded FROM catalog")
def codec_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_catalog(spark, sf_dir).select("id", codec.encode_hex("bytes").alias("encoded"))


@query(f"WITH {SYNTHETIC_SQL} SELECT id, 'fp:v1:' || to_base64(from_hex({_list_hex('c')})) AS encoded FROM catalog")
def codec_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_catalog(spark, sf_dir).select("id", codec.encode_base64("bytes").alias("encoded"))


@query(f"WITH {SYNTHETIC_SQL} SELECT id, lower(hex(encode('fp:v1:'))) || {_list_hex('c')} AS raw_hex, '0100000001' || {_list_hex('c')} AS blob_hex FROM catalog")
def codec_raw_and_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic_catalog(spark, sf_dir)
    return rows.select("id", F.lower(F.hex(codec.encode_raw("bytes"))).alias("raw_hex"), F.lower(F.hex(codec.encode_blob("bytes"))).alias("blob_hex"))


@query(f"WITH {SYNTHETIC_SQL} SELECT id, {_list_hex('c')} AS from_hex, {_list_hex('c')} AS from_base64, {_list_hex('c')} AS from_raw, {_list_hex('c')} AS from_blob, true AS other_version_is_null FROM catalog")
def codec_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic_catalog(spark, sf_dir)
    shown = lambda c: F.lower(F.hex(c))
    return rows.select(
        "id", shown(codec.decode_hex(codec.encode_hex("bytes"))).alias("from_hex"), shown(codec.decode_base64(codec.encode_base64("bytes"))).alias("from_base64"),
        shown(codec.decode_raw(codec.encode_raw("bytes"))).alias("from_raw"), shown(codec.decode_blob(codec.encode_blob("bytes"))["bytes"]).alias("from_blob"),
        codec.decode_hex(codec.encode_hex("bytes", F.lit(2))).isNull().alias("other_version_is_null"),
    )


@query("SELECT doc_id, sha256(text) AS sha256_hex FROM documents")
def sha256_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256_hex"))


_NUMBERS = ["CAST(doc_id AS VARCHAR)", "CAST(doc_id AS VARCHAR) || '.5'", "' ' || CAST(doc_id AS VARCHAR)", "CAST(doc_id AS VARCHAR) || 'x'", "source", "CAST(doc_id AS VARCHAR) || 'e2'", "''", "CAST(doc_id AS VARCHAR) || chr(10)", "'1e-400'", "'0e-400'", "'1e400'", "'nan' || chr(10)"]
_STRICT = r"CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND NOT (TRY_CAST(t AS DOUBLE) = 0 AND regexp_matches(t, '^[^eE]*[1-9]')) AND NOT isinf(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END"


@query(f"SELECT doc_id, kind, {_STRICT} AS value FROM (SELECT doc_id, CAST(doc_id % {len(_NUMBERS)} AS INTEGER) AS kind, CASE doc_id % {len(_NUMBERS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_NUMBERS))} END AS t FROM documents)")
def strict_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % len(_NUMBERS)
    text = F.expr(f"CASE doc_id % {len(_NUMBERS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_NUMBERS))} END".replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.cast("int").alias("kind"), codec.strict_double(text).alias("value"))


@query("SELECT doc_id, list_filter(list_transform(string_split(lang || ', ' || source || ' ,,', ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents")
def split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", codec.split_list(F.concat_ws(", ", "lang", F.concat("source", F.lit(" ,,")))).alias("parts"))


#: Words that labels are made of: those of each decision and one that is none.
WORDS = ["allow", "Safe", "REVIEW", "flag", "flagged", "block", "Blocked", "bad", "other"]
_LABEL_SQL = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"
_DECISION_SQL = "CASE WHEN lower({0}) IN ('allow', 'safe') THEN 'ALLOW' WHEN lower({0}) IN ('review', 'flag', 'flagged') THEN 'REVIEW' WHEN lower({0}) IN ('block', 'blocked', 'bad') THEN 'BLOCK' END"


@query(f"SELECT doc_id, {_DECISION_SQL.format(f'({_LABEL_SQL})')} AS decision FROM documents")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", policy.parse_decision(F.expr(_LABEL_SQL)).alias("decision"))


_LINE = "CASE WHEN doc_id % 10 = 9 THEN '# ' || source WHEN doc_id % 10 = 8 THEN source ELSE '  img' || CAST(doc_id // 2 AS VARCHAR) || '.png , ' || label || ' ' END"


@query(f"""WITH lines AS (SELECT doc_id, {_LINE} AS value FROM (SELECT *, {_LABEL_SQL} AS label FROM documents)),
    parts AS (SELECT doc_id, trim(value[:strpos(value, ',') - 1]) AS p, trim(value[strpos(value, ',') + 1:]) AS l FROM lines WHERE value NOT LIKE '#%' AND contains(value, ',')),
    known AS (SELECT doc_id, '/data/' || p AS path, {_DECISION_SQL.format('l')} AS expected FROM parts)
    SELECT path, arg_min(expected, doc_id) AS expected FROM known WHERE expected IS NOT NULL GROUP BY path""")
def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("label", F.expr(_LABEL_SQL))
    lines = docs.select(F.col("doc_id").alias("line_no"), F.expr(_LINE.replace("//", "DIV").replace("VARCHAR", "STRING")).alias("value"))
    return datasets.parse_manifest(lines, "/data")


#: Pseudo signals by doc_id: a match status, and a score of which the upper half is a detection.
_SIGNALS = "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'exact match' WHEN 1 THEN 'similar match' ELSE 'no match' END AS match_status, (doc_id * 37) % 101 > 50 AS detected, CAST((doc_id * 37) % 101 AS DOUBLE) / 100.0 AS confidence FROM {0}"
_POLICY = """SELECT *, CASE decision WHEN 'ALLOW' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS exit_code FROM (SELECT *,
    CASE WHEN match_status = 'exact match' OR (detected AND confidence >= 0.97) THEN 'BLOCK' WHEN match_status = 'similar match' OR (detected AND confidence >= 0.70) THEN 'REVIEW' ELSE 'ALLOW' END AS decision,
    CASE WHEN detected AND confidence >= 0.97 THEN 'classifier score' WHEN match_status = 'exact match' THEN 'exact fingerprint match' WHEN detected AND confidence >= 0.70 THEN 'classifier score'
    WHEN match_status = 'similar match' THEN 'similar fingerprint match' ELSE 'none' END AS reason FROM ({0}))"""


def _signals(rows: DataFrame) -> DataFrame:
    status = F.when(F.col("doc_id") % 7 == 0, "exact match").when(F.col("doc_id") % 7 == 1, "similar match").otherwise("no match")
    score = (F.col("doc_id") * 37) % 101
    return rows.select("*", status.alias("match_status"), (score > 50).alias("detected"), (score.cast("double") / 100.0).alias("confidence"))


@query(_POLICY.format(_SIGNALS.format("documents")))
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.evaluate(_signals(table(spark, sf_dir, "documents").select("doc_id")))


_EXPECTED_SQL = "CASE WHEN toxic = 1 THEN 'BLOCK' WHEN quality = 0 THEN 'REVIEW' ELSE 'ALLOW' END"
_EVALUATED = f"SELECT l.doc_id, {_EXPECTED_SQL} AS expected, CASE WHEN l.doc_id % 11 <> 0 THEN p.decision END AS predicted FROM labels l JOIN ({_POLICY.format(_SIGNALS.format('labels'))}) p USING (doc_id)"
_CELLS = {(e, p): f"{e}_{p}".lower() for e in evaluate.CLASSES for p in evaluate.CLASSES}
_CONFUSION = "SELECT " + ", ".join(f"count_if(expected = '{e}' AND predicted = '{p}')::BIGINT AS {c}" for (e, p), c in _CELLS.items()) + f", count_if(predicted IS NULL)::BIGINT AS skipped FROM ({_EVALUATED})"


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("toxic") == 1, "BLOCK").when(F.col("quality") == 0, "REVIEW").otherwise("ALLOW")
    rows = policy.evaluate(_signals(table(spark, sf_dir, "labels")))
    return rows.select("doc_id", expected.alias("expected"), F.when(F.col("doc_id") % 11 != 0, F.col("decision")).alias("predicted"))


@query(_CONFUSION)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_evaluated(spark, sf_dir))


def _report_sql() -> str:
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END"
    add = lambda cells: "(" + " + ".join(cells) + ")"
    f1 = lambda n: f"CASE WHEN {n}_precision + {n}_recall > 0 THEN 2.0 * {n}_precision * {n}_recall / ({n}_precision + {n}_recall) ELSE 0.0 END AS {n}_f1"
    every, flagged = add(_CELLS.values()), ("REVIEW", "BLOCK")
    out = [f"{every} AS evaluated", f"{every} + skipped AS total", "skipped", f"{ratio(add([_CELLS[k, k] for k in evaluate.CLASSES]), every)} AS accuracy"]
    for k in evaluate.CLASSES:
        n, row, column = k.lower(), add([_CELLS[k, p] for p in evaluate.CLASSES]), add([_CELLS[e, k] for e in evaluate.CLASSES])
        out += [f"{ratio(_CELLS[k, k], row)} AS {n}_precision", f"{ratio(_CELLS[k, k], column)} AS {n}_recall", f"{column} AS {n}_support"]
        out += [f"{ratio(_CELLS[k, k], column)} AS std_{n}_precision", f"{ratio(_CELLS[k, k], row)} AS std_{n}_recall", f"{row} AS std_{n}_support"]
    hit = add([_CELLS[e, p] for e in flagged for p in flagged])
    out += [f"{ratio(hit, add([_CELLS[e, p] for e in evaluate.CLASSES for p in flagged]))} AS flagged_precision", f"{ratio(hit, add([c for k, c in _CELLS.items() if k != ('ALLOW', 'ALLOW')]))} AS flagged_recall"]
    out += [f"{ratio(hit, add([_CELLS[e, p] for e in flagged for p in evaluate.CLASSES]))} AS std_flagged_recall"]
    return f"SELECT *, {', '.join(f1(n) for n in ('allow', 'review', 'block', 'flagged'))} FROM (SELECT {', '.join(out)} FROM ({_CONFUSION}))"


@query(_report_sql())
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate(_evaluated(spark, sf_dir))


_SCORES = ["(doc_id * 37) % 64", "(doc_id * 53) % 64", "(doc_id * 71) % 64", "(doc_id * 11) % 64", "(doc_id * 29) % 64", "(doc_id * 5) % 64"]
_MEANS = [f"(CAST({_SCORES[2 * i]} AS DOUBLE) / 64 + CAST({_SCORES[2 * i + 1]} AS DOUBLE) / 64) / 2" for i in range(3)]


@query(f"""SELECT doc_id, list_position(m, list_max(m)) AS place, ['clean', 'flagged', 'explicit'][list_position(m, list_max(m))] AS label, list_max(m) AS confidence,
    list_position(m, list_max(m)) = 3 AND list_max(m) >= 0.5 AS detected FROM (SELECT doc_id, [{', '.join(_MEANS)}] AS m FROM documents)""")
def output_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(*[(F.expr(s).cast("double") / 64).cast("float") for s in _SCORES])
    rows = table(spark, sf_dir, "documents").select("doc_id", classify.mapped_scores(scores, MAPPING).alias("r")).select("doc_id", "r.*")
    return rows.withColumn("place", F.array_position(F.array(*map(F.lit, MAPPING.labels)), F.col("label")).cast("int"))


_SCAN_SQL = f"""WITH {SYNTHETIC_SQL.replace('FROM documents', 'FROM documents WHERE doc_id % 3 <> 0')}, queries AS (SELECT doc_id AS query_id, {_seeded('doc_id', 'CASE WHEN i = 0 AND doc_id % 2 = 0 THEN 1 ELSE 0 END')} AS c FROM documents WHERE doc_id % 100 = 0),
    {_EXACT_SQL}, {_REST_SQL}, {BUCKETS_SQL}, {_candidates_sql(_nearest_probe_sql(), 'rest')},
    pairs AS (SELECT q.query_id, t.id, t.label, t.seq, k.probe, {_L2} AS distance FROM candidates k JOIN rest q USING (query_id) JOIN catalog t ON t.seq = k.seq
        UNION ALL SELECT q.query_id, t.id, t.label, t.seq, 0, {_L2} FROM rest q, catalog t WHERE q.query_id NOT IN (SELECT query_id FROM candidates)),
    near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, probe, seq) = 1),
    found AS ({_FINISH_SQL}),
    scored AS (SELECT query_id AS doc_id, distance AS nearest_distance, CASE WHEN exact_match THEN 'exact match' WHEN distance <= 50.0 THEN 'similar match' ELSE 'no match' END AS match_status,
        CASE WHEN exact_match OR distance <= 50.0 THEN id END AS matched_id, (query_id * 37) % 101 > 50 AS detected, CAST((query_id * 37) % 101 AS DOUBLE) / 100.0 AS confidence FROM found)
    {_POLICY.format('SELECT * FROM scored')}"""


@query(_SCAN_SQL)
def scan_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: match a set of queries with the catalog, score, decide."""
    catalog = synthetic_catalog(spark, sf_dir).where(F.col("seq") % 3 != 0)  # what is enrolled: the rest is unknown
    seed = F.col("doc_id")
    moved = F.when(seed % 2 == 0, 1).otherwise(0)
    c = synthetic_components(seed)
    asked = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select("doc_id", F.col("doc_id").alias("query_id"), F.concat(F.array(F.pmod(c[0] + moved, F.lit(256)).cast("int")), F.slice(c, 2, 143)).alias("components"))
    found = scan.match_status(search.with_identity(asked), catalog, SIMILAR)
    score = (seed * 37) % 101
    rows = found.select("doc_id", "nearest_distance", "match_status", "matched_id", (score > 50).alias("detected"), (score.cast("double") / 100.0).alias("confidence"))
    return policy.evaluate(rows)


@query("""SELECT conv_id, turn, '"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"' AS json FROM conversations""")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scan.json_string(F.col("text")).alias("json"))


def _enrolled(catalog: DataFrame, ids: Column | None = None, label: Column | None = None) -> FingerprintStore:
    """A store of its own with the catalog's fingerprints."""
    spark = catalog.sparkSession
    store = FingerprintStore(spark, f"{shared_dir(spark)}/pixelsieve-{uuid.uuid4().hex}")
    atexit.register(remove, spark, store.path)
    store.enroll(catalog.select((F.col("id") if ids is None else ids).alias("id"), "bytes", (F.col("label") if label is None else label).alias("label")))
    return store


@query(f"WITH {SYNTHETIC_SQL}, {BUCKETS_SQL} SELECT (SELECT count(*) FROM catalog) AS fingerprint_count, (SELECT count(*) FROM refs) AS bucket_count")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enrolled(synthetic_catalog(spark, sf_dir)).stats().select("fingerprint_count", "bucket_count")


@query("SELECT lower(to_hex(unnest(range(1, (SELECT count(*) FROM documents) + 1)))) AS id")
def enrolment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without ids get hexadecimal ordinals."""
    return _enrolled(synthetic_catalog(spark, sf_dir), F.lit(None).cast("string")).records().select("id")


@query(f"WITH {SYNTHETIC_SQL} SELECT id, CASE WHEN seq % 3 = 0 THEN 'later' ELSE 'first' END AS label, {_list_hex('c')} AS hex FROM catalog")
def store_enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two enrolments: rows without a label stay out of the first, taken ids out of the second. Then vacuum and rebuild."""
    catalog = synthetic_catalog(spark, sf_dir)
    store = _enrolled(catalog, label=F.when(F.col("seq") % 3 != 0, "first").otherwise(""))
    store.enroll(catalog.select("id", "bytes", F.lit("later").alias("label")))
    store.vacuum()
    store.rebuild()
    return store.records().select("id", "label", F.lower(F.hex("bytes")).alias("hex"))


@query(f"WITH {SYNTHETIC_SQL} SELECT id, label, {_list_hex('c')} AS hex FROM catalog WHERE seq % 100 = 0")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = synthetic_catalog(spark, sf_dir)
    found = _enrolled(catalog).lookup(catalog.where("seq % 100 = 0").select("id"))
    return found.select("id", "label", F.lower(F.hex("bytes")).alias("hex"))


@query(f"WITH {EMBEDDING_SQL}, {QUERIES_SQL} SELECT q.query_id, arg_min(t.id, t.seq) AS id FROM queries q JOIN catalog t ON t.c = q.c GROUP BY q.query_id")
def store_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = embedding_catalog(spark, sf_dir)
    return _enrolled(catalog).find_exact(perturbed_queries(catalog)).select("query_id", "id")


@query(f"SELECT query_id, id, distance FROM ({_similar_sql(EMBEDDING_SQL, EMBEDDING.threshold, True, True)})")
def store_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the stored buckets, all records for queries without candidates."""
    catalog = embedding_catalog(spark, sf_dir)
    return _enrolled(catalog).find_similar(perturbed_queries(catalog), EMBEDDING).select("query_id", "id", "distance")


@query(f"SELECT query_id, exact_match, distance, id FROM ({_nearest_lsh_sql(EMBEDDING_SQL)})")
def store_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = embedding_catalog(spark, sf_dir)
    return _enrolled(catalog).find_nearest(perturbed_queries(catalog), EMBEDDING).select("query_id", "exact_match", "distance", "id")


def _embedding_image(embedding: Column) -> Column:
    """An 8 x 8 gray image of 64 values, as RGB bytes."""
    gray = F.transform(embedding, lambda x: F.repeat(F.lpad(F.hex(F.floor((x.cast("double") + 1.0) * 127.5).cast("long")), 2, "0"), 3))
    return F.unhex(F.array_join(gray, ""))


@query()
def hash_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes of embeddings drawn as images; the golden vectors are in the tests."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), _embedding_image(F.col("embedding")).alias("rgb"))
    return rows.select("vec_id", codec.encode_hex(kernel.fingerprint_udf("width", "height", "rgb")).alias("encoded"))


class _MeanColour(classify.Classifier):
    """Scores the mean of each plane: stands in for a model where there is no file."""

    def classify(self, rgb: np.ndarray | None) -> tuple[str, float, bool]:
        tensor = classify.preprocess(rgb, self.metadata.inputs)
        if tensor is None:
            return "invalid_input", 0.0, False
        return classify.map_scores(tensor.reshape(3, -1).ravel(), self.metadata.mapping)


@query()
def classify_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = ModelMetadata(name="mean colour", inputs=InputRequirements(4, 4), mapping=MAPPING)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), _embedding_image(F.col("embedding")).alias("rgb"))
    return classify.classify_images(rows, _MeanColour("", metadata)).select("vec_id", "label", "confidence", "detected")


@query()
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images from pixels to decisions: hashed, matched with a third of them, scored by a stand-in model, decided."""
    metadata = ModelMetadata(name="mean colour", inputs=InputRequirements(4, 4), mapping=MAPPING)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), _embedding_image(F.col("embedding")).alias("rgb"))
    known = with_fingerprints(rows.where("CAST(path AS LONG) % 3 = 0")).select(F.col("path").alias("id"), F.col("path").cast("long").alias("seq"), F.lit("known").alias("label"), "bytes")
    out = scan.scan(rows, search.with_identity(known), _MeanColour("", metadata), SIMILAR)
    return out.select("path", "match_status", "nearest_distance", "matched_id", "classifier_status", "label", "confidence", "decision", "reason")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
