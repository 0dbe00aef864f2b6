"""Parameters of every stage, with their defaults in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# The floors, thresholds and defaults here and in the classes below.
MIN_VALID_MS = 30_000
TTL_DAYS = 90
MIN_WINDOW_EVENTS = 5
FEATURES = ("bpm", "energy", "valence", "danceability", "acousticness", "instrumentalness")

# The calendar. Hours are half-open, weekdays and months inclusive; a range may wrap.
DAY_PARTS = {"morning": (6, 12), "day": (12, 18), "evening": (18, 23), "night": (23, 6)}
WEEKDAY_KINDS = {"weekday": (1, 5), "weekend": (6, 7)}
SEASONS = {"winter": (12, 2), "spring": (3, 5), "summer": (6, 8), "autumn": (9, 11)}


@dataclass(frozen=True)
class ValidationParams:
    n_threshold: int = 1000
    t_threshold_days: int = 180
    confidence: float = 0.6
    stability: float = 0.5
    evidence_count: int = 50
    coverage_root: float = 0.5
    coverage_tendency: float = 0.3


@dataclass(frozen=True)
class AudioParams:
    min_cluster_size: int = 50
    min_samples: int = 10
    cluster_features: tuple[str, ...] = ("bpm", "energy", "valence", "danceability")
    features: tuple[str, ...] = FEATURES
    bpm_bands: tuple[float, float] = (100.0, 140.0)
    bands: tuple[float, float] = (0.4, 0.66)
    samples: int = 5


@dataclass(frozen=True)
class SceneParams:
    k_grid: tuple[int, ...] = (3, 5, 8, 13)
    coherence_floor: float = 0.15
    top_tags: int = 10
    top_artists: int = 5
    samples: int = 5
    max_iter: int = 1000


@dataclass(frozen=True)
class TemporalParams:
    day_parts: dict = field(default_factory=lambda: DAY_PARTS)
    weekday_kinds: dict = field(default_factory=lambda: WEEKDAY_KINDS)
    seasons: dict = field(default_factory=lambda: SEASONS)
    lift_floor: float = 1.3
    event_count_floor: int = 30


@dataclass(frozen=True)
class EpochParams:
    window_days: int = 60
    step_days: int = 14
    p_value: float = 0.01


@dataclass(frozen=True)
class Params:
    validation: ValidationParams = ValidationParams()
    audio: AudioParams = AudioParams()
    scene: SceneParams = SceneParams()
    temporal: TemporalParams = field(default_factory=TemporalParams)
    epochs: EpochParams = EpochParams()
