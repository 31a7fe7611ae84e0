"""A target-trial study as one spec and one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import design
from tidewell.operators.joins import star


@dataclass(frozen=True)
class StudySpec:
    """Which events start, treat, end and describe a unit; all times in hours.

    The same spec serves every study: other items, windows and bounds, one plan.
    """

    key: str = "user_id"
    start: str = "error"
    treatment: str = "purchase"
    outcome: str = "purchase"
    treatment_hours: float = 24.0
    outcome_hours: float = 168.0
    lookback_hours: float = 6.0
    grace_hours: float = 0.0
    washout_hours: float | None = None
    measures: Mapping[str, str] = field(default_factory=lambda: {"view": "view", "click": "click"})
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class EffectConfig:
    """A dataset's roles and estimation settings."""

    id_column: str = "id"
    subject: str = "subject"
    treatment: str = "t"
    outcome: str = "y"
    drop: tuple[str, ...] = ()
    ps_clip: tuple[float, float] = (0.01, 0.99)
    weight_trim: tuple[float, float] = (0.01, 0.99)
    folds: int = 5
    split: tuple[float, float] = (0.7, 0.15)
    seed: int = 42
    policy_rule: str = "tau_le_thr"
    thresholds: tuple[float, ...] = tuple(round(-0.3 + 0.9 * i / 19, 4) for i in range(20))


#: Named settings; a study names one and overrides what differs.
CONFIGS: dict[str, EffectConfig] = {
    "default": EffectConfig(),
    "small": EffectConfig(folds=2),
    "narrow_clip": EffectConfig(ps_clip=(0.05, 0.95)),
    "wide_trim": EffectConfig(weight_trim=(0.05, 0.95)),
    "benefit_positive": EffectConfig(policy_rule="tau_ge_thr", thresholds=tuple(round(0.05 + 0.85 * i / 9, 4) for i in range(10))),
}


def config(name: str, **changes: object) -> EffectConfig:
    if name not in CONFIGS:
        raise KeyError(f"unknown configuration {name}; there are {', '.join(CONFIGS)}")
    return replace(CONFIGS[name], **changes)


def build(cohort: DataFrame, events: DataFrame, spec: StudySpec) -> DataFrame:
    """One row per unit: t0, treatment, outcome, baseline covariates, has_ flags. events: key, event_id, ts, event_type, value."""
    of = lambda kind: events.where(F.col("event_type") == kind)
    spine = design.time_zero(cohort.select(spec.key), events, spec.key, F.col("event_type") == spec.start)
    if spec.washout_hours is not None:
        spine = design.washed_out(spine, of(spec.treatment), spec.key, spec.washout_hours)
    treated = design.exposure(spine, of(spec.treatment), spec.key, spec.treatment_hours)
    outcome = design.outcome_in_horizon(spine, of(spec.outcome), spec.key, spec.outcome_hours, spec.treatment_hours)
    covariates = design.baseline(spine, events, spec.key, spec.lookback_hours, spec.grace_hours, spec.measures)
    out = star(spine, [treated, outcome, covariates], spec.key)
    return design.clip_and_flag(out, spec.bounds) if spec.bounds else out
