"""Validated configuration of the anonymisers, from values or from properties text."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


def parse_properties(text: str) -> dict[str, str]:
    """key=value lines; blank lines and lines that start with # or ! are skipped."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def parse_yaml(text: str) -> dict[str, str]:
    """A flat or nested mapping of scalars and lists in YAML, as key=value texts; nested keys are joined by points, lists by commas.

    Block mappings, block lists and [a, b] lists are read; comments are skipped.
    """
    out: dict[str, str] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not bare.strip() or bare.strip() == "---":
            continue
        depth, body = len(bare) - len(bare.lstrip()), bare.strip()
        if body.startswith("- "):
            name = ".".join(x for _, x in path)
            out[name] = ",".join(x for x in (out.get(name, ""), _scalar(body[2:])) if x)
            continue
        key, _, value = body.partition(":")
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, _scalar(key)))
        if value.strip():
            value = value.strip()
            listed = value.startswith("[") and value.endswith("]")
            out[".".join(x for _, x in path)] = ",".join(map(_scalar, value[1:-1].split(","))) if listed else _scalar(value)
    return out


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _typed(cls, values: Mapping[str, str], names: Mapping[str, str]):
    known, out = {f.name: f for f in fields(cls)}, {}
    for key, value in values.items():
        name = names.get(key, key)
        if name not in known:
            continue
        kind = known[name].type
        if kind == "bool":
            out[name] = value.lower() in ("true", "1", "yes")
        elif kind.startswith("tuple[float"):
            out[name] = tuple(float(x) for x in value.split(",") if x.strip())
        elif kind.startswith("tuple"):
            out[name] = tuple(x.strip() for x in value.split(",") if x.strip())
        else:
            out[name] = {"int": int, "float": float}.get(kind, str)(value)
    return cls(**out)


def weights_of(headers: tuple[str, ...], weights: tuple[float, ...]) -> dict[str, float]:
    """Weight of each header; none given: 1 each."""
    if weights and len(weights) != len(headers):
        raise ValueError(f"{len(weights)} weights for {len(headers)} fields")
    return dict(zip(headers, weights or (1.0,) * len(headers), strict=True))


@dataclass(frozen=True)
class CastleConfig:
    """k tuples and l sensitive values a release, delta tuples of delay, beta open clusters."""

    k: int = 3
    delta: int = 10
    beta: int = 5
    sample: float = 1.0  # probability that a tuple is kept, with noise on
    mu: int = 5
    l: int = 3  # noqa: E741
    phi: float = 0.693148
    noise: bool = False
    headers: tuple[str, ...] = ("kwh",)
    sensitive: str = "kwh"
    weights: tuple[float, ...] = ()
    outlier: str = "suppress"
    seed: int = 0
    published: int = 0  # newest published clusters that a key keeps for reuse; 0: all
    # k counts individuals (pids); tuples without pid are one each. shipped counts tuples.
    shipped: bool = False  # the defaults' observed behaviour instead of the described one

    def __post_init__(self) -> None:
        if self.k < 1 or self.l < 1 or self.delta < 0 or self.beta < 1 or self.mu < 1:
            raise ValueError("k, l, beta and mu are at least 1, delta at least 0")
        if self.published < 0:
            raise ValueError("published is at least 0")
        if not 0 <= self.sample <= 1 or not (self.phi > 0 and math.isfinite(self.phi)):
            raise ValueError("sample lies in [0, 1], phi is positive")
        if not self.headers or self.outlier not in ("suppress", "most_used"):
            raise ValueError("headers are named; outlier is suppress or most_used")
        weights_of(self.headers, self.weights)

    @staticmethod
    def from_properties(text: str) -> CastleConfig:
        return _typed(CastleConfig, parse_properties(text), {"bigBeta": "sample", "useDiffPrivacy": "noise", "sensitive_attribute": "sensitive", "prioritization": "weights"})


@dataclass(frozen=True)
class DocaConfig:
    """eps of the noise, tuples of delay, beta open clusters, delta share of the domain that is kept."""

    eps: float = 200.0
    delay: int = 100
    beta: int = 5
    delta: float = 1.0
    window: int = 200
    spread: float = 0.8
    history: int = 80
    held: int = 0  # newest tuples that wait for a stable domain, older ones are suppressed; 0: all wait
    headers: tuple[str, ...] = ("kwh",)
    weights: tuple[float, ...] = ()
    seed: int = 0

    def __post_init__(self) -> None:
        if self.eps <= 0 or self.delay < 0 or self.beta < 1 or not 0 < self.delta <= 1:
            raise ValueError("eps is positive, delay at least 0, beta at least 1, delta in (0, 1]")
        if not self.headers:
            raise ValueError("headers are named")
        weights_of(self.headers, self.weights)

    @staticmethod
    def from_properties(text: str) -> DocaConfig:
        return _typed(DocaConfig, parse_properties(text), {"delay_constraint": "delay"})


@dataclass(frozen=True)
class DocaAltConfig:
    """Uniform noise of width 1 / eps on every field, for histories that are given as a whole."""

    eps: float = 200.0
    headers: tuple[str, ...] = ("kwh",)
    weights: tuple[float, ...] = ()
    seed: int = 0

    def __post_init__(self) -> None:
        if self.eps <= 0 or not self.headers:
            raise ValueError("eps is positive and headers are named")
        weights_of(self.headers, self.weights)


@dataclass(frozen=True)
class PipelineConfig:
    """Where messages come from and go to, which fields are anonymised, by what."""

    source: str = "electromobility"
    sink: str = "output-test"
    algorithm: str = "castleguard"
    anonymized_fields: tuple[str, ...] = ("kwh",)
    weights: tuple[float, ...] = field(default=())
    metrics: bool = True
    id: str = "ae_session_id"
    key: str = ""  # field whose values are anonymised apart; none: all messages together
    order: str = "producer_timestamp"

    def __post_init__(self) -> None:
        if self.algorithm not in ("castleguard", "doca", "doca-alt"):
            raise ValueError(f"unknown algorithm {self.algorithm}")
        weights_of(self.anonymized_fields, self.weights)

    @staticmethod
    def from_properties(text: str) -> PipelineConfig:
        return PipelineConfig.from_values(parse_properties(text))

    @staticmethod
    def from_yaml(text: str) -> PipelineConfig:
        return PipelineConfig.from_values(parse_yaml(text))

    @staticmethod
    def from_values(values: Mapping[str, str]) -> PipelineConfig:
        return _typed(PipelineConfig, values, {"input-topic": "source", "output-topic": "sink", "enable-metrics": "metrics", "prioritization": "weights"})
