"""Command line: python -m pixelsieve <command>. Exit codes: 0 allow, 1 review, 2 block, 10 error."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pixelsieve import __version__
from pixelsieve.functions import distance
from pixelsieve.functions.synthetic import synthetic_components
from pixelsieve.operators import policy, scan, search
from pixelsieve.operators.classify import onnx_scores
from pixelsieve.sources import datasets, images, models
from pixelsieve.sources.store import FingerprintStore
from pixelsieve.types import CLASSIFIER_KINDS, METRICS, MatchConfig

ERROR = policy.EXIT_ERROR


def session() -> SparkSession:
    spark = SparkSession.builder.appName("pixelsieve").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _fail(message: str) -> int:
    print(f"error: {message}", file=sys.stderr)
    return ERROR


def _hashed(path: str):
    return images.with_fingerprints(images.read_images(session(), path).where("rgb IS NOT NULL"))


def _classifier(args):
    """The classifier and the status where there is none."""
    path = args.config or models.variable(models.CONFIG_VARIABLE)
    if not path:
        return None, scan.NOT_CONFIGURED
    config = models.load_config(path)
    if config is None:
        return None, scan.NO_CONFIG
    return (c := models.make_classifier(config)), scan.AVAILABLE if c else scan.NO_CLASSIFIER


def _store(args) -> FingerprintStore | None:
    path = args.database or models.variable(models.DATABASE_VARIABLE)
    return FingerprintStore(session(), path) if path else None


def _config(args) -> MatchConfig:
    from pixelsieve.functions.codec import parse_double

    return MatchConfig().resolved(args.metric, parse_double(args.threshold or ""))


def _scans(args, found):
    store, (classifier, missing) = _store(args), _classifier(args)
    return scan.scan(found, store.catalog() if store else None, classifier, _config(args), missing=missing)


def cmd_hash(args) -> int:
    row = _hashed(args.image).limit(1)
    if not (out := scan.hash_json(row).first()):
        return _fail("image can't be decoded")
    print(out["json"] if args.json else "\n".join(f"{k}: {v}" for k, v in row.select(F.lower(F.hex("bytes")).alias("hex"), "sha256_hex").first().asDict().items()))
    return 0


def cmd_compare(args) -> int:
    pair = [_hashed(p).limit(1).select(distance.components("bytes").alias("c")).first() for p in (args.a, args.b)]
    if None in pair:
        return _fail("image can't be decoded")
    both = session().createDataFrame([(pair[0]["c"], pair[1]["c"])], "a array<int>, b array<int>")
    for name, value in both.select(*[distance.compare("a", "b", m).alias(m) for m in METRICS]).first().asDict().items():
        print(f"{name}: {value:.6f}")
    return 0


def cmd_scan(args) -> int:
    scans = _scans(args, images.read_images(session(), args.image)).persist()
    row = scans.first()
    if not row:
        return _fail("image can't be decoded")
    if args.json:
        print(scan.scan_json(scans).first()["json"])
    else:
        for c in ("path", "match_status", "nearest_distance", "matched_id", "matched_label", "classifier_status", "label", "confidence", "detected", "decision", "reason"):
            if row[c] is not None:
                print(f"{c}: {row[c]:.6f}" if isinstance(row[c], float) else f"{c}: {row[c]}")
    return row["exit_code"]


def cmd_classify(args) -> int:
    classifier, missing = _classifier(args)
    if classifier is None:
        return _fail(missing)
    from pixelsieve.operators.classify import classify_images

    row = classify_images(images.read_images(session(), args.image), classifier).first()
    print(f"label: {row['label']}\nconfidence: {row['confidence']:.6f}\ndetected: {str(row['detected']).lower()}")
    return 0


def cmd_evaluate(args) -> int:
    samples = datasets.load_dataset(session(), args.dataset).persist()
    if samples.isEmpty():
        return _fail("no samples")
    paths = datasets.sample_files(session(), samples)
    if not paths:
        return _fail("no sample's file exists")
    scans = _scans(args, images.read_images(session(), paths)).withColumn("path", datasets.local("path"))
    samples = samples.withColumn("path", datasets.local("path"))
    for name, value in scan.evaluate_dataset(samples, scans).first().asDict().items():
        print(f"{name}: {value:.4f}" if isinstance(value, float) else f"{name}: {value}")
    return 0


def cmd_benchmark(args) -> int:
    spark = session()
    catalog = spark.range(args.records).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), F.lit("sample").alias("label"), synthetic_components(F.col("id")).alias("components"))
    asked = catalog.where(F.col("seq") % 100 == 0).select(F.col("seq").alias("query_id"), "components")
    began = time.time()
    n = search.nearest(asked, catalog).count()
    print(f"records: {args.records}\nqueries: {n}\nmean latency: {(time.time() - began) * 1000 / max(1, n):.3f} ms")
    return 0


def cmd_database(args) -> int:
    store = _store(args)
    if store is None:
        return _fail("no database")
    if args.action == "add":
        rows = _hashed(args.image).select(F.lit(args.id).cast("string").alias("id"), "bytes", F.lit(args.label).alias("label"))
        if not store.enroll(rows):
            return _fail("not enrolled")
        ok = store.find_exact(rows.withColumn("query_id", F.lit(0)).withColumn("algorithm", F.lit(1)).withColumn("version", F.lit(1))).count()
        return 0 if ok else _fail("enrolled fingerprint isn't found")
    if args.action == "search":
        asked = _hashed(args.image).withColumn("query_id", F.lit(0))
        row = store.find_nearest(asked, _config(args)).first()
        print(f"match: {str(row['exact_match']).lower()}\ndistance: {row['distance']:.6f}")
        if row["id"] is not None:
            print(f"id: {row['id']}\nlabel: {row['label']}")
    elif args.action == "stats":
        for name, value in store.stats().first().asDict().items():
            print(f"{name}: {value}")
    else:
        store.vacuum()
        print("vacuum complete")
    return 0


def cmd_model(args) -> int:
    if args.action == "list":
        print("\n".join(CLASSIFIER_KINDS))
        return 0
    config = models.load_config(args.config)
    if config is None:
        return _fail(scan.NO_CONFIG)
    if args.action == "info":
        print(f"kind: {config.kind}\nmodel: {config.model_path}\nmanifest: {config.manifest_path}\nexists: {str(models.load_model(config.model_path) is not None).lower()}")
        return 0
    if models.make_classifier(config) is None:
        return _fail(scan.NO_CLASSIFIER)
    onnx_scores(config.model_path)
    print(f"verified: {config.model_path}")
    return 0


def cmd_doctor(args) -> int:
    checks = [("spark", lambda: session().version), ("hash kernel", lambda: _kernel_works()), ("classifier", lambda: _classifier(args)[1]), ("database", lambda: "not configured" if (s := _store(args)) is None else f"{s.size()} fingerprints")]
    failed = 0
    for name, check in checks:
        try:
            print(f"[ok] {name}: {check()}")
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"[fail] {name}: {str(e).splitlines()[0]}")
    return ERROR if failed else 0


def _kernel_works() -> str:
    from pixelsieve.functions import kernel
    from pixelsieve.functions.synthetic import gradient

    assert kernel.fingerprint(gradient(64, 48)) != kernel.ZERO
    return "available"


def cmd_version(args) -> int:
    import pyspark

    print(f"pixelsieve {__version__}\nPySpark {pyspark.__version__}")
    return 0


def cmd_config(args) -> int:
    for name in (models.CONFIG_VARIABLE, models.DATABASE_VARIABLE):
        print(f"{name}: {models.variable(name) or 'not set'}")
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("pixelsieve")
    commands = out.add_subparsers(dest="command")

    def add(name: str, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for x in ("database", "config", "threshold", "metric"):
            p.add_argument(f"--{x}")
        p.add_argument("--json", action="store_true")
        p.set_defaults(run=globals()[f"cmd_{name}"])
        return p

    add("hash", "image"), add("compare", "a", "b"), add("scan", "image"), add("classify", "image"), add("evaluate", "dataset")
    add("benchmark").add_argument("records", nargs="?", type=int, default=10_000)
    database = add("database")
    database.add_argument("action", choices=["add", "search", "stats", "vacuum"])
    database.add_argument("image", nargs="?")
    database.add_argument("--label", default="")
    database.add_argument("--id")
    add("model").add_argument("action", choices=["list", "info", "verify"])
    add("doctor"), add("version"), add("config")
    return out


def main(argv: list[str] | None = None) -> int:
    """Runs a command; no or an unknown command is an error, unknown options are passed by."""
    own = parser()
    try:
        args, _ = own.parse_known_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else ERROR
    if not args.command:
        own.print_help()
        return ERROR
    return args.run(args)
