import numpy as np
import pytest
from pyspark.sql import functions as F
from support import mean_model, png

from pixelsieve import cli
from pixelsieve.functions import kernel
from pixelsieve.functions.synthetic import checkerboard, gradient, uniform
from pixelsieve.operators import classify, evaluate, policy, scan
from pixelsieve.sources import datasets, images, models
from pixelsieve.sources.store import FingerprintStore, open_store
from pixelsieve.streaming import scans
from pixelsieve.types import ALLOW, BLOCK, EXACT_MATCH, NO_MATCH, REVIEW, SIMILAR_MATCH, DecodeLimits, InputRequirements, ModelMetadata, OutputMapping, PolicyConfig, TensorContract

SIGNALS = "match_status string, confidence double, detected boolean"


@pytest.mark.parametrize(
    ("row", "config", "decision", "reason"),
    [
        ((EXACT_MATCH, None, None), {}, BLOCK, policy.KNOWN_HASH),
        ((SIMILAR_MATCH, None, None), {}, REVIEW, policy.SIMILAR_HASH),
        ((NO_MATCH, 0.98, True), {}, BLOCK, policy.MODEL),
        ((NO_MATCH, 0.85, True), {}, REVIEW, policy.MODEL),
        ((NO_MATCH, 0.55, True), {}, ALLOW, policy.NONE),
        ((NO_MATCH, 0.99, False), {}, ALLOW, policy.NONE),
        ((NO_MATCH, None, None), {}, ALLOW, policy.NONE),
        ((SIMILAR_MATCH, 0.99, True), {}, BLOCK, policy.MODEL),
        ((SIMILAR_MATCH, 0.85, True), {}, REVIEW, policy.MODEL),
        ((EXACT_MATCH, 0.85, True), {}, BLOCK, policy.KNOWN_HASH),
        ((SIMILAR_MATCH, None, None), {"similar_match": ALLOW}, ALLOW, policy.SIMILAR_HASH),
        ((NO_MATCH, 0.85, True), {"default": BLOCK}, BLOCK, policy.NONE),
    ],
)
def test_policy(spark, row, config, decision, reason):
    got = policy.evaluate(spark.createDataFrame([row], SIGNALS), PolicyConfig(**config)).first()
    assert (got["decision"], got["reason"], got["exit_code"]) == (decision, reason, policy.EXIT_CODES[decision])


def test_labels(spark):
    words = {"Allow": ALLOW, "safe": ALLOW, "flag": REVIEW, "FLAGGED": REVIEW, "review": REVIEW, "bad": BLOCK, "blocked": BLOCK, "block": BLOCK, "x": None}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", policy.parse_decision(F.col("w")).alias("d"))
    assert {r["w"]: r["d"] for r in df.collect()} == words


def test_evaluation(spark):
    pairs = [(ALLOW, ALLOW)] * 5 + [(ALLOW, BLOCK)] * 2 + [(REVIEW, BLOCK)] * 3 + [(REVIEW, REVIEW)] * 4 + [(BLOCK, BLOCK)] * 6 + [(BLOCK, ALLOW)] + [(ALLOW, None)] * 2
    r = evaluate.evaluate(spark.createDataFrame(pairs, "expected string, predicted string")).first()
    assert (r["total"], r["evaluated"], r["skipped"], r["accuracy"]) == (23, 21, 2, 15 / 21)
    assert (r["block_precision"], r["block_recall"], r["block_support"]) == (6 / 7, 6 / 11, 11)
    assert (r["std_block_precision"], r["std_block_recall"], r["std_block_support"]) == (6 / 11, 6 / 7, 7)
    assert (r["flagged_precision"], r["flagged_recall"], r["std_flagged_recall"]) == (13 / 15, 13 / 16, 13 / 14)
    empty = evaluate.evaluate(spark.createDataFrame([], "expected string, predicted string")).first()
    assert empty["accuracy"] == empty["flagged_f1"] == 0.0 and empty["total"] == 0


def test_preprocess():
    inputs = InputRequirements(2, 2, 3, scale=1 / 255, mean=(0.5, 0.0, 0.0), std=(0.5, 1.0, 0.0))
    out = classify.preprocess(uniform(4, 4, (255, 51, 9)), inputs)
    assert out.shape == (3, 2, 2) and np.allclose(out[0], 1.0) and np.allclose(out[1], 0.2) and (out[2] == 0).all()
    assert classify.preprocess(np.zeros((0, 0, 3), np.uint8), inputs) is None and classify.preprocess(gradient(4, 4), InputRequirements(0, 2)) is None
    assert classify.preprocess(gradient(4, 4), InputRequirements(2, 2, 1)).shape == (1, 2, 2)
    assert classify.resize_area(np.array([[[0], [10]], [[20], [30]]], np.uint8), 1, 1)[0, 0, 0] == 15
    assert classify.contract_error(out, inputs, TensorContract()) is None
    assert "NCHW" in classify.contract_error(out, inputs, TensorContract(layout="NHWC")) and "RGB" in classify.contract_error(out, inputs, TensorContract(color="BGR"))
    assert "float32" in classify.contract_error(out, inputs, TensorContract(element="uint8")) and "match" in classify.contract_error(out[:2], inputs, TensorContract())


def test_output_mapping(spark):
    m = OutputMapping(("a", "b"), "b", 0.5)
    cases = {(0.2, 0.8): ("b", 0.8, True), (0.5, 0.5): ("a", 0.5, False), (): ("empty_output", 0.0, False), (1.0, 2.0, 3.0): ("output_shape_mismatch", 0.0, False), (0.0, 0.5, 0.25, 0.75): ("b", 0.5, True), (0.2, 0.4): ("b", 0.4, False)}
    for scores, want in cases.items():
        got = classify.map_scores(np.array(scores, np.float32), m)
        column = spark.createDataFrame([(list(map(float, scores)),)], "s array<float>").select(classify.mapped_scores(F.col("s"), m).alias("r")).first()["r"]
        assert got[0] == column["label"] == want[0] and got[2] == column["detected"] == want[2]
        assert abs(got[1] - want[1]) < 1e-6 and abs(column["confidence"] - want[1]) < 1e-6
    assert classify.map_scores(np.ones(2), OutputMapping())[0] == "missing_labels"


MANIFEST = "# a model\nname=mean\nversion = 1.0x\ninput_width=4\ninput_height=4px\ninput_channels=3\nscale=0.00392156862745098\nlabels= channel_r, channel_g ,,channel_b\ndetection_label=channel_b\ndetection_threshold=0.5\nauthor=me\nnoise\n"


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    folder = tmp_path_factory.mktemp("model")
    (folder / "mean.onnx").write_bytes(mean_model(3, 4, 4))
    (folder / "mean.manifest").write_text(MANIFEST)
    (folder / "classifier.conf").write_text("# conf\nmodel_path=mean.onnx\nkind=violence\n")
    return folder


def test_configuration(model):
    config = models.load_config(str(model / "classifier.conf"))
    assert (config.kind, config.manifest_path) == ("violence", str(model / "mean.manifest"))
    assert models.load_config(env={models.CONFIG_VARIABLE: str(model / "classifier.conf")}) == config and models.load_config(env={models.CONFIG_VARIABLE: ""}) is None
    for text in ("kind=nudity", "model_path=a\nkind=dogs", "model_path=a\nother=b", "model_path="):
        assert models.parse_config(text, "/x") is None
    m = models.load_model(config.model_path)
    assert (m.name, m.version, m.inputs.width, m.inputs.height, m.mapping.labels, m.attributes) == ("mean", "1.0x", 4, 4, ("channel_r", "channel_g", "channel_b"), {"author": "me"})
    assert models.parse_manifest("", "stem").name == "stem" and models.load_model("/none") is None
    with pytest.raises(ValueError, match="mean_r"):
        models.parse_manifest("mean_r=x", "s")
    assert models.make_classifier(None) is None


def test_onnx(model):
    classifier = models.make_classifier(models.load_config(str(model / "classifier.conf")))
    label, confidence, detected = classifier.classify(uniform(4, 4, (10, 20, 30)))
    assert (label, detected) == ("channel_b", False) and abs(confidence - 30 / 255) < 1e-6
    assert classifier.classify(uniform(8, 8, (10, 20, 200)))[2]
    assert classifier.classify(None)[0] == "invalid_input"
    assert classify.Classifier("/none.onnx", ModelMetadata()).classify(gradient(4, 4))[0] == "model_load_failed"
    assert classify.Classifier(classifier.model_path, ModelMetadata(inputs=InputRequirements(0, 0))).classify(gradient(4, 4))[0] == "preprocessing_failed"
    assert classify.Classifier(classifier.model_path, ModelMetadata(inputs=InputRequirements(5, 5))).classify(gradient(4, 4))[0] == "inference_failed"
    assert classify.SafeClassifier().classify(gradient(4, 4)) == ("safe", 0.0, False)


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pictures")
    for name in ("allow", "review", "block"):
        (folder / name).mkdir()
    (folder / "block/gradient.png").write_bytes(png(gradient(64, 48)))
    (folder / "allow/board.png").write_bytes(png(checkerboard(32, 32)))
    near = gradient(64, 48).copy()
    near[20:24, 20:24] = 0
    (folder / "review/near.png").write_bytes(png(near))
    (folder / "allow/blue.png").write_bytes(png(uniform(8, 8, (0, 0, 250))))
    (folder / "allow/broken.png").write_bytes(b"\0\1\2\3")
    return folder


def test_images(spark, pictures):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.with_fingerprints(images.read_images(spark, f"{pictures}/*")).collect()}
    assert bytes(rows["gradient.png"]["bytes"]) == kernel.fingerprint(gradient(64, 48)) and rows["broken.png"]["rgb"] is None and rows["broken.png"]["bytes"] is None
    assert bytes(rows["blue.png"]["rgb"])[:3] == bytes((0, 0, 250)) and len(rows["blue.png"]["sha256_hex"]) == 64
    small = images.read_images(spark, f"{pictures}/*", DecodeLimits(max_width=40)).where("rgb IS NOT NULL").count()
    assert small == 2
    assert images.pixel(gradient(4, 4), 3, 0) == (255, 0, 127)


def test_channels(spark, tmp_path):
    (tmp_path / "gray.png").write_bytes(png(gradient(8, 8)[:, :, :1].copy()))
    (tmp_path / "alpha.png").write_bytes(png(np.dstack([gradient(8, 8), np.full((8, 8), 200, np.uint8)])))
    rows = {r["path"].rsplit("/", 1)[1]: bytes(r["rgb"]) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert rows["alpha.png"] == gradient(8, 8).tobytes() and rows["gray.png"] == np.repeat(gradient(8, 8)[:, :, :1], 3, 2).tobytes()


def test_store(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "db"))
    assert store.size() == 0 and store.stats().first()["bucket_count"] == 0
    empty = store.find_nearest(spark.createDataFrame([(1, [10] * 144)], "query_id long, components array<int>")).first()
    assert (empty["exact_match"], empty["distance"], empty["id"]) == (False, 0.0, None)
    rows = [("a", bytes([10] * 144), "x"), ("a", bytes([11] * 144), "y"), (None, bytes([90] * 144), "x"), ("b", bytes([20] * 144), ""), ("c", b"short", "x"), ("d", bytes([30] * 144), None)]
    df = spark.createDataFrame(rows, "id string, bytes binary, label string")
    assert store.enroll(df) == 2 and store.enroll(df.where("id = 'a'")) == 0
    again = FingerprintStore(spark, str(tmp_path / "db"))
    assert again.size() == 2 and again.stats().first()["bucket_count"] == 50
    found = again.find_exact(spark.createDataFrame([(1, bytes([10] * 144))], "query_id long, bytes binary")).first()
    assert (found["id"], found["label"]) == ("a", "x")
    assert again.lookup(spark.createDataFrame([("a",), ("zz",)], "id string")).count() == 1
    assert again.find_similar(spark.createDataFrame([(1, [11] * 144)], "query_id long, components array<int>")).count() == 0
    before = sorted(map(tuple, again.buckets().collect()))
    again.rebuild()
    again.vacuum()
    assert sorted(map(tuple, again.buckets().collect())) == before and again.size() == 2


def test_scan_and_evaluate(spark, pictures, model, tmp_path):
    found = images.read_images(spark, f"{pictures}/*")
    store = FingerprintStore(spark, str(tmp_path / "db"))
    store.enroll(images.with_fingerprints(found.where("path LIKE '%gradient%'")).selectExpr("'g' AS id", "bytes", "'known' AS label"))
    classifier = models.make_classifier(models.load_config(str(model / "classifier.conf")))
    rows = scan.scan(found, store.catalog(), classifier, scan.MatchConfig(threshold=150.0)).persist()
    by = {r["path"].rsplit("/", 1)[1]: r for r in rows.collect()}
    assert set(by) == {"gradient.png", "board.png", "near.png", "blue.png"}
    g, n, b = by["gradient.png"], by["near.png"], by["blue.png"]
    assert (g["match_status"], g["decision"], g["matched_label"], g["classifier_status"], g["label"]) == (EXACT_MATCH, BLOCK, "known", scan.AFTER_MATCH, None)
    assert (n["match_status"], n["decision"]) == (SIMILAR_MATCH, REVIEW) and 0 < n["nearest_distance"] <= 150
    assert (b["match_status"], b["matched_id"], b["decision"], b["reason"]) == (NO_MATCH, None, BLOCK, policy.MODEL) and b["nearest_distance"] > 150
    text = {r["path"].rsplit("/", 1)[1]: r["json"] for r in scan.scan_json(rows).collect()}
    assert '"decision":"BLOCK","reason":"exact fingerprint match","match":"exact match","distance":0.000000,"classifier_available":false}' in text["gradient.png"]
    assert text["blue.png"].endswith('"classifier_label":"channel_b","classifier_confidence":0.980392,"classifier_detected":true}')
    samples = datasets.load_dataset(spark, str(pictures))
    assert samples.count() == 5
    report = scan.evaluate_dataset(samples, rows).first()
    assert (report["total"], report["evaluated"], report["skipped"], report["allow_block"] if "allow_block" in report.asDict() else 1) == (5, 4, 1, 1)
    plain = scan.scan(found).first()
    assert (plain["match_status"], plain["nearest_distance"], plain["classifier_status"]) == (NO_MATCH, 0.0, scan.NOT_CONFIGURED)


def test_manifest(spark, tmp_path):
    (tmp_path / "manifest.csv").write_text("# c\n\na.png, safe\n a.png,block\nb.png,unknown\n,allow\nno comma\n/abs/c.png , BAD\n")
    got = [tuple(r) for r in datasets.load_dataset(spark, str(tmp_path)).collect()]
    assert got == [("/abs/c.png", BLOCK), (f"{tmp_path}/a.png", ALLOW)]
    (tmp_path / "manifest.tsv").write_text("d.png,allow\n")
    (tmp_path / "manifest.csv").write_text("")
    assert datasets.load_dataset(spark, str(tmp_path)).count() == 0  # the empty file is the manifest
    (tmp_path / "manifest.csv").unlink()
    assert datasets.load_dataset(spark, str(tmp_path)).count() == 1
    assert datasets.load_dataset(spark, str(tmp_path / "..")).count() == 0


def test_streaming(spark, tmp_path):
    known = spark.createDataFrame([("a", bytes([1] * 144), "x")], "id string, bytes binary, label string")
    store = FingerprintStore(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([("a", bytes([1] * 144), "x", None), ("b", bytes([2] * 144), "x", None)], "id string, bytes binary, label string, created_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        scans.enroll_stream(scans.fingerprint_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
    assert store.size() == 2
    out = scans.scan_stream(scans.fingerprint_stream(spark, str(tmp_path / "in")), known.withColumn("seq", F.lit(1)))
    q = out.writeStream.format("memory").queryName("scanned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["id"], r["decision"]) for r in spark.table("scanned").collect()} == {("a", BLOCK), ("b", ALLOW)}


def test_cli(spark, pictures, model, tmp_path, capsys):
    image, db = str(pictures / "block/gradient.png"), str(tmp_path / "cli-db")
    assert cli.main([]) == cli.main(["nothing"]) == 10
    assert cli.main(["hash", image, "--json"]) == 0 and '"sha256_rgb"' in capsys.readouterr().out
    assert cli.main(["hash", str(pictures / "allow/broken.png")]) == 10
    assert cli.main(["compare", image, image]) == 0 and "l2: 0.000000" in capsys.readouterr().out
    assert cli.main(["database", "add", image, "--label", "known", "--database", db]) == 0
    assert cli.main(["database", "search", image, "--database", db]) == 0 and "match: true" in capsys.readouterr().out
    assert cli.main(["scan", image, "--database", db, "--json"]) == 2 and '"decision":"BLOCK"' in capsys.readouterr().out
    assert cli.main(["scan", str(pictures / "allow/board.png"), "--database", db]) == 0
    assert cli.main(["database", "stats", "--database", db]) == cli.main(["database", "vacuum", "--database", db]) == 0
    assert cli.main(["evaluate", str(pictures), "--database", db]) == 0 and "accuracy" in capsys.readouterr().out
    assert cli.main(["classify", image, "--config", str(model / "classifier.conf")]) == 0
    assert cli.main(["model", "verify", "--config", str(model / "classifier.conf")]) == cli.main(["model", "list"]) == 0
    assert cli.main(["doctor"]) == cli.main(["version"]) == cli.main(["config"]) == cli.main(["benchmark", "200"]) == 0


def test_cli_evaluates_samples_anywhere(spark, pictures, tmp_path, capsys):
    """Also of long manifests, files outside the root and in deep folders are read; missing ones are skipped."""
    image, other = pictures / "block/gradient.png", tmp_path / "other/x.png"
    for missing in (3, 10_050):
        root = tmp_path / str(missing)
        for path in (root / "a/b/c/deep.png", root / "a/up.png", other):
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(image.read_bytes())
        lines = ["a/b/c/deep.png,allow", "a/up.png,allow", f"{other},allow", f"{image},allow"]
        (root / "manifest.csv").write_text("\n".join([*lines, *(f"m{i}.png,allow" for i in range(missing))]))
        assert cli.main(["evaluate", str(root)]) == 0
        out = capsys.readouterr().out
        assert "evaluated: 4\n" in out and f"skipped: {missing}\n" in out, out
