"""Configurations and table schemas of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

ALGORITHM, VERSION, COMPONENTS = 1, 1, 144

ALLOW, REVIEW, BLOCK = "ALLOW", "REVIEW", "BLOCK"
NO_MATCH, EXACT_MATCH, SIMILAR_MATCH = "no match", "exact match", "similar match"

FINGERPRINTS = "id string, seq long, algorithm tinyint, version int, bytes binary, label string, created_at timestamp"
BUCKETS = "id string, seq long, band_index int, bucket_key int"

METRICS = ("l1", "l2", "l2_squared")


def parse_metric(name: str | None) -> str | None:
    """The metric of a name; names are case-sensitive, unknown ones give None."""
    return {"l1": "l1", "l2": "l2", "l2_squared": "l2_squared", "l2-squared": "l2_squared"}.get(name or "")


@dataclass(frozen=True)
class DecodeLimits:
    max_encoded_bytes: int = 20 * 1024 * 1024
    max_width: int = 8192
    max_height: int = 8192
    max_decoded_pixels: int = 64 * 1024 * 1024


@dataclass(frozen=True)
class MatchConfig:
    """How fingerprints are compared; ``use_normalized`` overrides the metric."""

    metric: str = "l2"
    threshold: float = 10.0
    use_normalized: bool = False
    max_results: int = 0

    def resolved(self, metric: str | None = None, threshold: float | None = None, env: dict | None = None) -> MatchConfig:
        """Explicit values win over the environment, which wins over these; invalid ones are passed by."""
        from pixelsieve.functions.codec import parse_double

        env = os.environ if env is None else env
        out = self
        if name := parse_metric(env.get("PIXELSIEVE_MATCH_METRIC")):
            out = replace(out, metric=name)
        if (value := parse_double(env.get("PIXELSIEVE_MATCH_THRESHOLD") or "")) is not None:
            out = replace(out, threshold=value)
        if name := parse_metric(metric):
            out = replace(out, metric=name)
        return out if threshold is None else replace(out, threshold=threshold)

    def effective_limit(self, limit: int = 0) -> int:
        """0 is unlimited, else the smaller of those that are set."""
        return min((n for n in (limit, self.max_results) if n > 0), default=0)


@dataclass(frozen=True)
class PolicyConfig:
    block_threshold: float = 0.97
    review_threshold: float = 0.70
    exact_match: str = BLOCK
    similar_match: str = REVIEW
    default: str = ALLOW


@dataclass(frozen=True)
class InputRequirements:
    width: int = 224
    height: int = 224
    channels: int = 3
    scale: float = 1 / 255
    mean: tuple[float, float, float] = (0.0, 0.0, 0.0)
    std: tuple[float, float, float] = (1.0, 1.0, 1.0)


@dataclass(frozen=True)
class TensorContract:
    """What a model takes; only this layout is supported."""

    layout: str = "NCHW"
    color: str = "RGB"
    element: str = "float32"
    batch: int = 1


@dataclass(frozen=True)
class OutputMapping:
    labels: tuple[str, ...] = ()
    detection_label: str = ""
    detection_threshold: float = 0.5


@dataclass(frozen=True)
class ModelMetadata:
    name: str = ""
    version: str = "0.0.0"
    description: str = ""
    inputs: InputRequirements = field(default_factory=InputRequirements)
    contract: TensorContract = field(default_factory=TensorContract)
    mapping: OutputMapping = field(default_factory=OutputMapping)
    attributes: dict[str, str] = field(default_factory=dict)


CLASSIFIER_KINDS = ("nudity", "violence", "weapons", "drugs", "child_safety")


@dataclass(frozen=True)
class ClassifierConfig:
    model_path: str
    manifest_path: str
    kind: str = "nudity"
