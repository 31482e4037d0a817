"""Weights and thresholds of the quality, routing and drift rules, in one immutable place. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QualityWeights:
    """Page and document scores: 1 is pristine."""

    degradation: tuple[tuple[str, float], ...] = (("blur", 0.30), ("noise", 0.25), ("contrast", 0.20), ("illumination", 0.15), ("artifacts", 0.10))
    simplified: tuple[tuple[str, float], ...] = (("blur", 0.4), ("noise", 0.3), ("contrast", 0.3))
    layout_base: tuple[tuple[str, float], ...] = (("single_column", 0.1), ("multi_column", 0.4), ("three_column", 0.6), ("complex", 0.9))
    layout_unknown: float = 0.5
    features: tuple[tuple[str, float], ...] = (("has_tables", 0.20), ("has_figures", 0.15), ("has_dense_math", 0.15), ("has_handwriting", 0.10))
    risk: tuple[float, float] = (0.4, 0.3)
    risk_image_only: float = 0.2
    risk_hybrid: float = 0.1
    risk_handwriting: float = 0.1
    blend: tuple[float, float] = (0.7, 0.3)


@dataclass(frozen=True)
class Routing:
    text_layer: float = 0.90
    low_quality: float = 0.6
    script_confidence: float = 0.55
    warping: float = 0.75
    table_complexity: float = 0.6
    orientation: float = 0.5
    sparse_elements: int = 5
    risk: float = 0.6
    fast_quality: float = 0.8


@dataclass(frozen=True)
class Drift:
    bins: int = 50
    epsilon: float = 1e-10
    kl: tuple[float, float] = (0.15, 0.30)
    psi: tuple[float, float] = (0.10, 0.25)
    drop: tuple[float, float] = (0.03, 0.05)
    cooldown_minutes: int = 60
    min_samples: int = 100


@dataclass(frozen=True)
class Discrepancy:
    """Head: threshold and weight."""

    heads: tuple[tuple[str, float, float], ...] = (("blur", 0.25, 1.2), ("contrast", 0.30, 1.0), ("skew", 0.20, 0.8), ("noise", 0.35, 1.0), ("compression", 0.35, 0.9))
    aggregate: float = 0.25


@dataclass(frozen=True)
class Settings:
    quality: QualityWeights = field(default_factory=QualityWeights)
    routing: Routing = field(default_factory=Routing)
    drift: Drift = field(default_factory=Drift)
    discrepancy: Discrepancy = field(default_factory=Discrepancy)


DEFAULT = Settings()
