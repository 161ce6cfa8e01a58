"""Image classification: preprocessing, models by ONNX, mapping of scores to a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.types import CLASSIFIER_KINDS, InputRequirements, ModelMetadata, OutputMapping, TensorContract

RESULT = "label string, confidence double, detected boolean"


# --- preprocessing -------------------------------------------------------------------------------


def area_weights(source: int, target: int) -> np.ndarray:
    """Shares of the source's pixels in each of the target's, by covered length."""
    edges = np.arange(target + 1) * (source / target)
    low, high = np.arange(source), np.arange(source) + 1
    cover = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
    cover = np.clip(cover, 0.0, None)
    return cover / cover.sum(1, keepdims=True)


def resize_area(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area resampling, rounded to bytes. Exact for equal sizes and whole-number reductions."""
    if rgb.shape[:2] == (height, width):
        return rgb
    rows, columns = area_weights(rgb.shape[0], height), area_weights(rgb.shape[1], width)
    out = np.einsum("ij,jkc->ikc", rows, rgb.astype(np.float64))
    return np.floor(np.einsum("lk,ikc->ilc", columns, out) + 0.5).clip(0, 255).astype(np.uint8)


def preprocess(rgb: np.ndarray | None, inputs: InputRequirements) -> np.ndarray | None:
    """Float planes (channels x height x width), or None for an empty image or shape."""
    if rgb is None or rgb.size == 0 or min(inputs.width, inputs.height, inputs.channels) <= 0:
        return None
    image = resize_area(rgb, inputs.width, inputs.height)
    out = np.zeros((inputs.channels, inputs.height, inputs.width), np.float32)
    for c in range(min(inputs.channels, 3)):
        inverse = np.float32(0) if inputs.std[c] == 0 else np.float32(1) / np.float32(inputs.std[c])
        out[c] = (image[:, :, c].astype(np.float32) * np.float32(inputs.scale) - np.float32(inputs.mean[c])) * inverse
    return out


def contract_error(tensor: np.ndarray | None, inputs: InputRequirements, contract: TensorContract) -> str | None:
    """What is wrong with a tensor, checked in order."""
    if contract.element != "float32":
        return "tensor contract requires float32 input"
    if contract.layout != "NCHW":
        return "tensor contract requires NCHW layout"
    if contract.color != "RGB":
        return "tensor contract requires RGB channel order"
    if tensor is None or min(inputs.width, inputs.height, inputs.channels) <= 0:
        return "tensor dimensions must be positive"
    if tensor.size != contract.batch * inputs.channels * inputs.height * inputs.width:
        return "tensor element count does not match NCHW shape"
    return None


# --- output mapping --------------------------------------------------------------------------------


def map_scores(scores: np.ndarray, mapping: OutputMapping) -> tuple[str, float, bool]:
    """Label, confidence and detection; scores of several times the labels are means of blocks."""
    labels = mapping.labels
    if not labels:
        return "missing_labels", 0.0, False
    if not len(scores):
        return "empty_output", 0.0, False
    if len(scores) % len(labels):
        return "output_shape_mismatch", 0.0, False
    if len(scores) != len(labels):
        block, scores = len(scores) // len(labels), scores.astype(np.float32)
        scores = np.cumsum(scores.reshape(len(labels), block), axis=1, dtype=np.float32)[:, -1] / np.float32(block)
    best = int(np.argmax(scores))
    found = mapping.detection_label != "" and labels[best] == mapping.detection_label
    return labels[best], float(scores[best]), bool(found and float(scores[best]) >= mapping.detection_threshold)


def mapped_scores(scores: Column, mapping: OutputMapping) -> Column:
    """The same as a column: STRUCT<label, confidence, detected> of an array of scores."""
    failed = lambda label: F.struct(F.lit(label).alias("label"), F.lit(0.0).alias("confidence"), F.lit(False).alias("detected"))
    n = len(mapping.labels)
    if not n:
        return failed("missing_labels")
    block = (F.size(scores) / F.lit(n)).cast("int")
    means = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.slice(scores, i * block + 1, block), F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float")) / block.cast("float"))
    means = F.when(F.size(scores) == n, scores.cast("array<double>")).otherwise(F.transform(means, lambda x: x.cast("float").cast("double")))
    best = F.array_max(means)
    label = F.element_at(F.array(*map(F.lit, mapping.labels)), F.array_position(means, best).cast("int"))
    detected = F.lit(mapping.detection_label != "") & (label == mapping.detection_label) & (best >= mapping.detection_threshold)
    found = F.struct(label.alias("label"), best.alias("confidence"), detected.alias("detected"))
    empty = scores.isNull() | (F.size(scores) == 0)
    return F.when(empty, failed("empty_output")).when(F.size(scores) % n != 0, failed("output_shape_mismatch")).otherwise(found)


# --- classifiers -----------------------------------------------------------------------------------

_sessions: dict[str, object] = {}


def onnx_scores(model_path: str, threads: int = 1) -> Callable[[np.ndarray], np.ndarray]:
    """Runs a model's first input to its first output; one session for each Python worker."""
    import onnxruntime

    if model_path not in _sessions:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = max(1, threads)
        options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_BASIC
        _sessions[model_path] = onnxruntime.InferenceSession(model_path, options, providers=["CPUExecutionProvider"])
    session = _sessions[model_path]

    def run(tensor: np.ndarray) -> np.ndarray:
        return np.asarray(session.run(None, {session.get_inputs()[0].name: tensor[None]})[0]).ravel()

    return run


class Classifier:
    """A model with its metadata. ``resolve`` finds the model's file on an executor."""

    def __init__(self, model_path: str, metadata: ModelMetadata, kind: str = "nudity", threads: int = 1):
        if kind not in CLASSIFIER_KINDS:
            raise ValueError(f"unknown kind {kind}")
        self.model_path, self.metadata, self.kind, self.threads = model_path, metadata, kind, threads

    def classify(self, rgb: np.ndarray | None) -> tuple[str, float, bool]:
        """A result; where a step fails, its label says which and nothing is detected."""
        if rgb is None or rgb.size == 0:
            return "invalid_input", 0.0, False
        try:
            scores = onnx_scores(self.model_path, self.threads)
        except Exception:  # noqa: BLE001  a model that can't be loaded is a result, not a failure
            return "model_load_failed", 0.0, False
        tensor = preprocess(rgb, self.metadata.inputs)
        if tensor is None:
            return "preprocessing_failed", 0.0, False
        if contract_error(tensor, self.metadata.inputs, self.metadata.contract):
            return "tensor_contract_violation", 0.0, False
        try:
            values = scores(tensor)
        except Exception:  # noqa: BLE001
            return "inference_failed", 0.0, False
        return map_scores(values, self.metadata.mapping)


class SafeClassifier(Classifier):
    """Finds every image safe; stands in where there is no model."""

    def __init__(self, metadata: ModelMetadata | None = None):
        super().__init__("", metadata or ModelMetadata())

    def classify(self, rgb: np.ndarray | None) -> tuple[str, float, bool]:
        return "safe", 0.0, False


def classify_images(images: DataFrame, classifier: Classifier) -> DataFrame:
    """Adds label, confidence and detected to images (width, height, rgb)."""
    names = ["label", "confidence", "detected"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", " + RESULT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w, h, p in zip(batch["width"], batch["height"], batch["rgb"], strict=True):
                image = None if p is None or not w or not h else np.frombuffer(bytes(p), np.uint8, int(w) * int(h) * 3).reshape(int(h), int(w), 3)
                rows.append(classifier.classify(image))
            yield batch.assign(**{n: [r[i] for r in rows] for i, n in enumerate(names)})

    return images.mapInPandas(run, schema)
