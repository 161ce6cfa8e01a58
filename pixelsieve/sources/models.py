"""Classifier configurations and model manifests: small ``key=value`` files read on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import replace
from pathlib import Path

from pixelsieve.operators.classify import Classifier
from pixelsieve.types import CLASSIFIER_KINDS, ClassifierConfig, ModelMetadata

MANIFEST_SUFFIX = ".manifest"
CONFIG_VARIABLE, DATABASE_VARIABLE = "PIXELSIEVE_CLASSIFIER_CONFIG", "PIXELSIEVE_DATABASE"


def variable(name: str, env: dict | None = None) -> str | None:
    """An environment variable; an empty one counts as unset."""
    return (os.environ if env is None else env).get(name) or None


def entries(text: str) -> list[tuple[str, str]]:
    lines = [line.strip() for line in text.splitlines()]
    return [tuple(part.strip() for part in line.split("=", 1)) for line in lines if line and not line.startswith("#") and "=" in line]


def parse_config(text: str, folder: str | Path) -> ClassifierConfig | None:
    """A configuration; None for an unknown key or kind, or without a model path."""
    found: dict[str, str] = {}
    for key, value in entries(text):
        if key not in ("model_path", "manifest_path", "kind") or key == "kind" and value not in CLASSIFIER_KINDS:
            return None
        found[key] = value
    if not found.get("model_path"):
        return None
    at = lambda p: str(Path(folder) / p)  # noqa: E731  absolute paths stay
    model = at(found["model_path"])
    manifest = at(found["manifest_path"]) if found.get("manifest_path") else str(Path(model).with_suffix(MANIFEST_SUFFIX))
    return ClassifierConfig(model, manifest, found.get("kind", "nudity"))


def load_config(path: str | None = None, env: dict | None = None) -> ClassifierConfig | None:
    """The configuration in a file, by default that of the environment."""
    path = path or variable(CONFIG_VARIABLE, env)
    if not path or not Path(path).is_file():
        return None
    return parse_config(Path(path).read_text(), Path(path).parent)


def _prefix(pattern: str, value: str, kind, default):
    """The number that a value starts with."""
    found = re.match(pattern, value.strip())
    return kind(found[0]) if found else default


def parse_manifest(text: str, stem: str) -> ModelMetadata:
    """A model's metadata; unknown keys become attributes, numbers may have trailing text."""
    out = ModelMetadata()
    inputs, mapping, extra = out.inputs, out.mapping, {}
    integer, number = r"[+-]?\d+", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    for key, value in entries(text):
        if key in ("name", "version", "description"):
            out = replace(out, **{key: value})
        elif key in ("input_width", "input_height", "input_channels"):
            field = key.removeprefix("input_")
            inputs = replace(inputs, **{field: _prefix(integer, value, int, getattr(inputs, field))})
        elif key == "scale":
            inputs = replace(inputs, scale=_prefix(number, value, float, inputs.scale))
        elif m := re.fullmatch("(mean|std)_([rgb])", key):
            numbers = list(getattr(inputs, m[1]))
            if not re.match(number, value):
                raise ValueError(f"{key} is no number: {value!r}")
            numbers["rgb".index(m[2])] = _prefix(number, value, float, 0.0)
            inputs = replace(inputs, **{m[1]: tuple(numbers)})
        elif key == "labels":
            mapping = replace(mapping, labels=tuple(x for x in (p.strip() for p in value.split(",")) if x))
        elif key == "detection_label":
            mapping = replace(mapping, detection_label=value)
        elif key == "detection_threshold":
            mapping = replace(mapping, detection_threshold=_prefix(number, value, float, mapping.detection_threshold))
        else:
            extra[key] = value
    return replace(out, name=out.name or stem, version=out.version or "0.0.0", inputs=inputs, mapping=mapping, attributes=extra)


def load_model(model_path: str, manifest_path: str | None = None) -> ModelMetadata | None:
    """The metadata of a model whose file exists; without a manifest it is named after the file."""
    if not Path(model_path).is_file():
        return None
    manifest = Path(manifest_path) if manifest_path else Path(model_path).with_suffix(MANIFEST_SUFFIX)
    if not manifest.is_file():
        return ModelMetadata(name=Path(model_path).stem)
    return parse_manifest(manifest.read_text(), manifest.stem)


def make_classifier(config: ClassifierConfig | None) -> Classifier | None:
    """A classifier, or None where the model or its manifest is missing."""
    if config is None or not (Path(config.model_path).is_file() and Path(config.manifest_path).is_file()):
        return None
    return Classifier(config.model_path, parse_manifest(Path(config.manifest_path).read_text(), Path(config.manifest_path).stem), config.kind)
