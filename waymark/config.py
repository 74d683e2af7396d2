"""Thresholds of the analysis, with the invariants they must keep."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # sessions and prefixes
    session_gap_minutes: int = 30
    max_prefixes: int = 8
    seed: int = 42
    test_share_mod: int = 5
    at_risk_threshold: float = 0.5
    # detection
    friction_prob_threshold: float = 0.6
    theme_min_prob: float = 0.6
    anomaly_z: float = 3.0
    anomaly_ratio: float = 2.5
    anomaly_window_minutes: tuple[int, ...] = (15, 30, 60)
    anomaly_min_count: int = 8
    anomaly_baseline_hours: int = 48
    anomaly_baseline_days: int = 7
    # how many affected sessions must agree before an aggregate packet counts as supported
    rule_support_share: float = 0.2
    model_support_share: float = 0.3
    # confidence, gates, priority
    weight_rule: float = 0.30
    weight_model: float = 0.30
    weight_text: float = 0.20
    weight_aggregate: float = 0.20
    gate_high: float = 0.80
    gate_medium: float = 0.50
    impact_critical: float = 500_000.0
    impact_high: float = 50_000.0
    # investigation and live sessions
    investigate_limit: int = 400
    idle_minutes: float = 2.0
    state_hours: float = 48.0  # how long a live session's events and messages stay in the state
    # recovery
    messages_per_day: int = 2
    holdout_share: float = 0.10
    consent_share: float = 0.85
    # scale: a key with more rows than this is cut into time chunks of about this size
    hot_rows: int = 5_000_000
    max_chunks: int = 1000

    def __post_init__(self) -> None:
        weights = self.weight_rule + self.weight_model + self.weight_text + self.weight_aggregate
        if abs(weights - 1.0) > 1e-9:
            raise ValueError(f"confidence weights must sum to 1, got {weights}")
        if not 0 < self.gate_medium < self.gate_high <= 1:
            raise ValueError("gates must satisfy 0 < medium < high <= 1")
        if self.impact_high >= self.impact_critical:
            raise ValueError("the high impact must be below the critical impact")


DEFAULTS = Settings()
