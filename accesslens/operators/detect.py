"""Deviation from the profile, anomaly score, risk, severity and verdict as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.functions.numeric import clamp, norm_circular, norm_frequency, norm_zscore, risk_scale, round_dp
from accesslens.operators.profiles import KEY, VALUE_KINDS, Profiles
from accesslens.operators.scan import SkewConfig, add_salt, hot_by_history, skew_join
from accesslens.schemas import DIMENSIONS

# Weights and thresholds of scoring and risk.
DIMENSION_WEIGHTS = {
    "temporal": 1.0, "device": 1.2, "resource": 1.2, "geographic": 1.5, "authentication": 1.3, "session": 0.8,
}
FAILURE_STREAK = 3
BURST_EVENTS = 10.0
IMPLAUSIBLE_KMH = 900.0
UNKNOWN_PROFILE_DEVIATION = 0.5
WORKING_HOURS_CAP = 12.0


@dataclass(frozen=True)
class RiskConfig:
    deviation: float = 0.40
    indicator: float = 0.25
    confidence: float = 0.15
    trust: float = 0.10
    cold_start: float = 0.10
    insufficient_data_floor: float = 0.5
    warming_up_floor: float = 0.2
    established_floor: float = 0.0

    def __post_init__(self) -> None:
        total = self.deviation + self.indicator + self.confidence + self.trust + self.cold_start
        if not math.isclose(total, 1.0, abs_tol=1e-6):
            raise ValueError(f"risk weights must sum to 1, not {total}")


@dataclass(frozen=True)
class ThresholdConfig:
    """Lower risk bound of each severity. Equal neighbours are accepted; ``informational`` is never read."""

    informational: float = 5.0
    low: float = 10.0
    medium: float = 25.0
    high: float = 45.0
    critical: float = 55.0

    def __post_init__(self) -> None:
        levels = [self.informational, self.low, self.medium, self.high, self.critical]
        if levels != sorted(levels) or levels[0] < 0.0 or levels[-1] > 100.0:
            raise ValueError(f"severity levels must rise within [0, 100]: {levels}")


# ---- scoring strategies: dict of dimension -> deviation column, to one column ----

ScoringStrategy = Callable[[dict[str, Column]], Column]


def weighted_average(deviations: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = DIMENSION_WEIGHTS if weights is None else weights
    used = {name: weights.get(name, 1.0) for name in deviations}
    if not used or sum(used.values()) <= 0:
        return F.lit(0.0)
    total = sum((deviations[name] * F.lit(weight) for name, weight in used.items()), F.lit(0.0))
    return round_dp(total / F.lit(sum(used.values())), 4)


def max_deviation(deviations: dict[str, Column]) -> Column:
    return round_dp(F.greatest(*deviations.values()), 4) if deviations else F.lit(0.0)


_STRATEGIES: dict[str, ScoringStrategy] = {"weighted_average": weighted_average, "max_deviation": max_deviation}


def register_scoring_strategy(name: str, strategy: ScoringStrategy) -> None:
    _STRATEGIES[name] = strategy


def scoring_strategy(name: str) -> ScoringStrategy:
    if name not in _STRATEGIES:
        raise ValueError(f"unknown scoring strategy {name!r}, have {sorted(_STRATEGIES)}")
    return _STRATEGIES[name]


@dataclass(frozen=True)
class DetectConfig:
    strategy: str = "weighted_average"
    risk: RiskConfig = field(default_factory=RiskConfig)
    thresholds: ThresholdConfig = field(default_factory=ThresholdConfig)


# ---- expressions over an event joined with its profile (profile columns carry a p_ prefix) ----

PROFILE_COLUMNS = (
    "entity_type", "version", "avg_login_hour", "login_hour_std", "avg_session_duration", "session_duration_std",
    "failure_rate", "drift_score", "confidence_score", "warmup_strategy", "resource_sharing_score",
)


def profile_side(core: DataFrame) -> DataFrame:
    return core.select(KEY, *[F.col(c).alias(f"p_{c}") for c in PROFILE_COLUMNS])


def join_profile(
    events: DataFrame, profiles: Profiles, skew: SkewConfig, hot: DataFrame | None, previous: str = "previous_resource"
) -> DataFrame:
    """Latest profile fields, the shares of the event's own values and its transition probability.

    Value and transition tables are joined on (entity, value), so no row holds
    an entity's whole distribution. Hot entities are salted.
    """
    df = skew_join(add_salt(events, KEY, "event_id", skew, hot), profile_side(profiles.core), [KEY], KEY, skew, hot)
    for kind, column in VALUE_KINDS.items():
        shares = profiles.values.filter(F.col("kind") == kind).select(
            KEY, F.col("value").alias(column), F.col("share").alias(f"f_{kind}")
        )
        df = skew_join(df, shares, [KEY, column], KEY, skew, hot)
    steps = profiles.transitions.filter(F.col("kind") == "resource").select(
        KEY, F.col("from_state").alias(previous), F.col("to_state").alias("resource_accessed"),
        F.col("probability").alias("f_transition"),
    )
    return skew_join(df, steps, [KEY, previous, "resource_accessed"], KEY, skew, hot).drop("_slot")


def has_profile() -> Column:
    return F.col("p_version").isNotNull()


def _share(kind: str) -> Column:
    return F.coalesce(f"f_{kind}", F.lit(0.0))


def dev_temporal() -> Column:
    hour, mean, std = F.col("login_hour").cast("double"), F.col("p_avg_login_hour"), F.col("p_login_hour_std")
    by_hour = F.when(std > 0, norm_zscore(hour, mean, std)).otherwise(norm_circular(hour, mean, 24.0))
    by_schedule = clamp(F.col("working_hours_deviation") / F.lit(WORKING_HOURS_CAP))
    return round_dp(F.greatest(by_hour, by_schedule), 4)


def dev_device() -> Column:
    return round_dp(norm_frequency(_share("device")), 4)


def dev_resource() -> Column:
    rare = norm_frequency(_share("resource"))
    unlikely = norm_frequency(_share("transition"))
    return F.when(F.col("previous_resource").isNotNull(), round_dp((rare + unlikely) / F.lit(2.0), 4)).otherwise(
        round_dp(rare, 4)
    )


def dev_geographic() -> Column:
    return round_dp(norm_frequency(_share("location")), 4)


def dev_authentication() -> Column:
    return F.when(F.col("login_result") == "failure", round_dp(F.lit(1.0) - F.col("p_failure_rate"), 4)).otherwise(0.0)


def dev_session() -> Column:
    x = F.col("session_duration").cast("double")
    return round_dp(norm_zscore(x, F.col("p_avg_session_duration"), F.col("p_session_duration_std")), 4)


def deviations() -> dict[str, Column]:
    """The six deviations; all neutral where the entity has no profile."""
    known = {
        "temporal": dev_temporal(), "device": dev_device(), "resource": dev_resource(),
        "geographic": dev_geographic(), "authentication": dev_authentication(), "session": dev_session(),
    }
    return {name: F.when(has_profile(), known[name]).otherwise(UNKNOWN_PROFILE_DEVIATION) for name in DIMENSIONS}


def attack_indicator() -> Column:
    """Share of five structural warning signs present in the features."""
    signs = (
        F.col("consecutive_failures") >= FAILURE_STREAK,
        F.col("fingerprint_mismatch"),
        F.col("os_novelty") | F.col("mac_novelty"),
        F.col("geo_velocity_kmh") > IMPLAUSIBLE_KMH,
        F.col("burst_access_score") >= BURST_EVENTS,
    )
    return round_dp(sum((s.cast("int") for s in signs), F.lit(0)) / F.lit(float(len(signs))), 4)


def risk_components(anomaly: Column, config: RiskConfig) -> dict[str, Column]:
    """The five additive parts of the risk, before weighting, and the two values behind them."""
    known = has_profile()
    confidence = F.coalesce("p_confidence_score", F.lit(0.0))
    trust = F.when(known, round_dp(clamp(F.lit(1.0) - F.col("p_drift_score")), 4)).otherwise(0.0)
    floor = (
        F.when(F.col("p_warmup_strategy") == "established", config.established_floor)
        .when(F.col("p_warmup_strategy") == "warming_up", config.warming_up_floor)
        .otherwise(config.insufficient_data_floor)
    )
    return {
        "risk_deviation_component": round_dp(clamp(anomaly), 4),
        "risk_indicator_component": attack_indicator(),
        "risk_confidence_component": round_dp(F.lit(1.0) - confidence, 4),
        "risk_trust_component": round_dp(F.lit(1.0) - trust, 4),
        "risk_cold_start_component": floor,
        "historical_confidence": confidence,
        "entity_trust": trust,
    }


def risk_score(config: RiskConfig) -> Column:
    c = F.col
    return risk_scale(
        F.lit(config.deviation) * c("risk_deviation_component")
        + F.lit(config.indicator) * c("risk_indicator_component")
        + F.lit(config.confidence) * c("risk_confidence_component")
        + F.lit(config.trust) * c("risk_trust_component")
        + F.lit(config.cold_start) * c("risk_cold_start_component")
    )


def severity(risk: Column, t: ThresholdConfig | None = None) -> Column:
    t = t or ThresholdConfig()
    return (
        F.when(risk >= t.critical, "critical").when(risk >= t.high, "high").when(risk >= t.medium, "medium")
        .when(risk >= t.low, "low").otherwise("informational")
    )


def verdict(level: Column) -> Column:
    return F.when(level.isin("high", "critical"), "anomalous").when(level == "medium", "suspicious").otherwise("normal")


EVENT_COLUMNS = (
    "event_id", "entity_id", "timestamp", "login_hour", "working_hours_deviation", "session_duration",
    "resource_accessed", "device_fingerprint", "geo_location", "login_result", "consecutive_failures",
    "fingerprint_mismatch", "os_novelty", "mac_novelty", "geo_velocity_kmh", "burst_access_score", "previous_resource",
)


def score(joined: DataFrame, config: DetectConfig) -> DataFrame:
    """Detection columns for events already joined with their profile; batch and stream share it."""
    scored = joined.withColumns({f"deviation_{name}": value for name, value in deviations().items()})
    anomaly = scoring_strategy(config.strategy)({name: F.col(f"deviation_{name}") for name in DIMENSIONS})
    scored = scored.withColumn("anomaly_score", anomaly)
    scored = scored.withColumns(risk_components(F.col("anomaly_score"), config.risk))
    scored = scored.withColumn("risk_score", risk_score(config.risk))
    level = severity(F.col("risk_score"), config.thresholds)
    scored = scored.withColumn("severity", level).withColumn("verdict", verdict(F.col("severity")))
    return scored.select(
        "event_id", "entity_id", "timestamp", F.col("p_entity_type").alias("entity_type"), "anomaly_score",
        "risk_score", "severity", "verdict", F.lit(config.strategy).alias("scoring_strategy"),
        F.col("p_version").alias("profile_version"),
        *[f"deviation_{name}" for name in DIMENSIONS],
        "risk_deviation_component", "risk_indicator_component", "risk_confidence_component", "risk_trust_component",
        "risk_cold_start_component", "historical_confidence", "entity_trust",
        *[c for c in ("is_attack",) if c in joined.columns],
    )


def detect(
    engineered: DataFrame, latest: Profiles, config: DetectConfig | None = None, skew: SkewConfig | None = None
) -> DataFrame:
    """Score every event against its entity's latest profile.

    The expressions see no label; ``is_attack`` is only carried past them.
    """
    config, skew = config or DetectConfig(), skew or SkewConfig()
    label = [c for c in ("is_attack",) if c in engineered.columns]
    hot = hot_by_history(engineered, KEY, skew)
    return score(join_profile(engineered.select(*EVENT_COLUMNS, *label), latest, skew, hot), config)
