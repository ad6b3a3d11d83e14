"""Attack types of flagged events from evidence checks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.functions.numeric import clamp, round_dp
from accesslens.functions.text import fixed
from accesslens.operators.detect import BURST_EVENTS, FAILURE_STREAK, IMPLAUSIBLE_KMH
from accesslens.operators.profiles import KEY, Profiles, profile_drift_trend
from accesslens.operators.scan import SkewConfig, add_salt, hot_by_history, skew_join
from accesslens.sources import dims

# Share of checks below which no type is named.
UNKNOWN_SCORE_FLOOR = 0.4
CHECKS_PER_TYPE = 5


@dataclass(frozen=True)
class ConfidenceConfig:
    match: float = 0.5
    margin: float = 0.3
    detection: float = 0.2
    unknown_cap: float = 0.4

    def __post_init__(self) -> None:
        if not math.isclose(self.match + self.margin + self.detection, 1.0, abs_tol=1e-6):
            raise ValueError("confidence weights must sum to 1")
        if not 0.0 <= self.unknown_cap <= 1.0:
            raise ValueError("unknown_cap must lie in [0, 1]")


@dataclass(frozen=True)
class ClassifyConfig:
    strategy: str = "rule_based"
    confidence: ConfidenceConfig = field(default_factory=ConfidenceConfig)
    unknown_floor: float = UNKNOWN_SCORE_FLOOR


#: Both, so that tables that lie by entity are joined where they lie.
KEYS = ("entity_id", "event_id")


def filter_flagged(detection: DataFrame) -> DataFrame:
    return detection.filter(F.col("verdict") != "normal")


def join_detection_features(detection: DataFrame, engineered: DataFrame) -> DataFrame:
    own = [c for c in schemas.CLASSIFY_FEATURE_COLUMNS if c not in KEYS]
    features = engineered.select(*KEYS, *own, "previous_resource")
    return detection.select(*schemas.CLASSIFY_DETECTION_COLUMNS).join(features, list(KEYS), "left")


def evidence_bundle(
    detection: DataFrame, engineered: DataFrame, store: Profiles, latest: Profiles, skew: SkewConfig | None = None
) -> DataFrame:
    """Flagged events with features, profile evidence and the entity's drift trend.

    ``previous_resource`` was taken over all events before the filter.
    """
    skew = skew or SkewConfig()
    hot = hot_by_history(engineered, KEY, skew)
    flagged = add_salt(join_detection_features(filter_flagged(detection), engineered), KEY, "event_id", skew, hot)
    profile = latest.core.select(
        KEY, "resource_sharing_score", F.col("drift_score").alias("profile_drift_score"), "drifted_dimensions",
        "warmup_strategy", F.lit(True).alias("has_profile"),
    )
    steps = latest.transitions.filter(F.col("kind") == "resource").select(
        KEY, F.col("from_state").alias("previous_resource"), F.col("to_state").alias("resource_accessed"), "probability"
    )
    df = skew_join(flagged, profile, [KEY], KEY, skew, hot)
    df = skew_join(df, profile_drift_trend(store), [KEY], KEY, skew, hot)
    df = skew_join(df, steps, [KEY, "previous_resource", "resource_accessed"], KEY, skew, hot).drop("_slot")
    known = F.coalesce("has_profile", F.lit(False)) & F.col("previous_resource").isNotNull()
    return df.select(
        *[c for c in df.columns if c not in ("probability", "has_profile", "drift_rising", "profile_version_count")],
        F.when(known, F.coalesce("probability", F.lit(0.0))).alias("resource_transition_probability"),
        F.coalesce("profile_version_count", F.lit(0)).alias("profile_version_count"),
        F.coalesce("drift_rising", F.lit(False)).alias("drift_rising"),
    )


Check = tuple[Column, Column]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def rule_checks() -> dict[str, list[Check]]:
    """Per attack type, its checks as (condition, evidence text)."""
    c = F.col
    failure, success = c("login_result") == "failure", c("login_result") == "success"
    new_system = c("os_novelty") | c("mac_novelty")
    strange_device = c("fingerprint_mismatch") | new_system
    streak, burst = c("consecutive_failures"), c("burst_access_score")

    def deviates(dimension: str, bound: float) -> Check:
        value = c(f"deviation_{dimension}")
        return value >= bound, _text(f"{dimension} deviation=", fixed(value, 2), f" >= {bound:.2f}")

    def below(name: str, bound: float) -> Check:
        return c(name) < bound, _text(f"{name}=", fixed(c(name), 2), f" < {bound:.2f}")

    def at_least(name: str, bound: float, dp: int = 2) -> Check:
        return c(name) >= bound, _text(f"{name}=", fixed(c(name), dp), f" >= {bound:.{dp}f}")

    failed = (failure, F.lit("login_result=failure"))
    accepted = (success, F.lit("login_result=success"))
    sensitive = (c("sensitive_resource_access"), F.lit("sensitive_resource_access=true"))
    tenure = c("history_length") >= 10
    return {
        "brute_force": [
            failed,
            (streak >= FAILURE_STREAK, _text("consecutive_failures=", streak.cast("string"), f" >= {FAILURE_STREAK}")),
            at_least("burst_access_score", BURST_EVENTS, 1),
            deviates("authentication", 0.5),
            (~strange_device, F.lit("device identity is one the entity is known for")),
        ],
        "impossible_travel": [
            (c("geo_velocity_kmh") > IMPLAUSIBLE_KMH, _text("geo_velocity_kmh=", fixed(c("geo_velocity_kmh"), 0), " > 900")),
            (c("country_change"), F.lit("country_change=true")),
            (c("geo_novelty"), F.lit("geo_novelty=true")),
            deviates("geographic", 0.5),
            accepted,
        ],
        "credential_stuffing": [
            failed,
            below("device_familiarity_score", 0.3),
            (strange_device, F.lit("device identity is new for the entity")),
            ((streak >= 1) & (streak < 10), _text("consecutive_failures=", streak.cast("string"), " within 1..9")),
            below("burst_access_score", BURST_EVENTS),
        ],
        "lateral_movement": [
            (c("resource_novelty"), F.lit("resource_novelty=true")),
            sensitive,
            below("resource_sharing_score", 0.2),
            below("resource_transition_probability", 0.05),
            deviates("resource", 0.5),
        ],
        "device_spoofing": [
            (c("fingerprint_mismatch"), F.lit("fingerprint_mismatch=true")),
            (new_system, F.lit("os_novelty or mac_novelty=true")),
            below("device_familiarity_score", 0.2),
            deviates("device", 0.5),
            accepted,
        ],
        "low_and_slow_exfiltration": [
            sensitive,
            at_least("resource_diversity", 0.6),
            at_least("historical_percentile_session_duration", 85.0, 1),
            below("burst_access_score", 5.0),
            deviates("session", 0.3),
        ],
        "insider_drift": [
            at_least("behaviour_drift_score", 0.35),
            (c("session_entropy") <= 0.1, _text("session_entropy=", fixed(c("session_entropy"), 2), " <= 0.10")),
            (~c("new_entity_flag"), F.lit("entity has a history")),
            at_least("resource_diversity", 0.2),
            (
                c("drift_rising") | tenure,
                F.when(c("drift_rising"), F.lit("drift rises over the stored profile versions")).otherwise(
                    _text("history_length=", c("history_length").cast("string"), " >= 10")
                ),
            ),
        ],
    }


def rule_based() -> dict[str, tuple[Column, Column]]:
    """Attack type -> (score, texts of the checks that fired). A check on a null fails."""
    result = {}
    for name, checks in rule_checks().items():
        fired = [F.coalesce(condition, F.lit(False)) for condition, _ in checks]
        share = round_dp(sum((f.cast("int") for f in fired), F.lit(0)) / F.lit(float(len(checks))), 4)
        texts = F.filter(
            F.array(*[F.when(f, text) for f, (_, text) in zip(fired, checks)]), lambda t: t.isNotNull()
        )
        if name == "insider_drift":
            # Varied commands speak against drift: half the score, evidence kept.
            share = F.when(F.col("session_entropy") > 0.5, round_dp(share * F.lit(0.5), 4)).otherwise(share)
        result[name] = (share, texts)
    return result


ClassificationStrategy = Callable[[], dict[str, tuple[Column, Column]]]
_STRATEGIES: dict[str, ClassificationStrategy] = {"rule_based": rule_based}


def register_classification_strategy(name: str, strategy: ClassificationStrategy) -> None:
    _STRATEGIES[name] = strategy


def classification_strategy(name: str) -> ClassificationStrategy:
    if name not in _STRATEGIES:
        raise ValueError(f"unknown classification strategy {name!r}, have {sorted(_STRATEGIES)}")
    return _STRATEGIES[name]


def select_attack_type(floor: float = UNKNOWN_SCORE_FLOOR) -> Column:
    """Best score; ties go to the type whose own dimension deviates most, then to the larger name."""
    best = F.array_max(
        F.array(
            *[
                F.struct(
                    F.col(f"score_{name}").alias("score"),
                    F.col(f"deviation_{dims.PRIMARY_DIMENSION[name]}").alias("deviation"),
                    F.lit(name).alias("name"),
                )
                for name in dims.KNOWN_ATTACKS
            ]
        )
    )
    return F.when(best["score"] < floor, "unknown").otherwise(best["name"])


def chosen_score() -> Column:
    cases = F.lit(0.0)
    for name in dims.KNOWN_ATTACKS:
        cases = F.when(F.col("attack_type") == name, F.col(f"score_{name}")).otherwise(cases)
    return cases


def runner_up_score() -> Column:
    scores = F.array(*[F.col(f"score_{name}") for name in dims.KNOWN_ATTACKS])
    return F.element_at(F.sort_array(scores, asc=False), 2)


def classification_confidence(config: ConfidenceConfig | None = None, anomaly: str = "anomaly_score") -> Column:
    config = config or ConfidenceConfig()
    top = chosen_score()
    raw = clamp(
        F.lit(config.match) * top
        + F.lit(config.margin) * clamp(top - runner_up_score())
        + F.lit(config.detection) * clamp(F.col(anomaly))
    )
    return round_dp(F.when(F.col("attack_type") == "unknown", F.least(raw, F.lit(config.unknown_cap))).otherwise(raw), 4)


def mitre_map(df: DataFrame, severity_name: str = "severity") -> DataFrame:
    """Attack type to display name, tactic, technique and typical severity (eight fixed rows)."""
    registry = dims.attack_registry(df.sparkSession).select(
        "attack_type", "display_name", "mitre_tactic", "mitre_technique", F.col("typical_severity").alias(severity_name)
    )
    return df.join(F.broadcast(registry), "attack_type")


def attach_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """The labelled type, after the decision."""
    labels = truth.select(*KEYS, F.col("attack_type").alias("ground_truth_attack_type"))
    return df.join(labels, list(KEYS), "left")


def classify(evidence: DataFrame, truth: DataFrame | None = None, config: ClassifyConfig | None = None) -> DataFrame:
    """Type, confidence and evidence for each flagged event in an evidence bundle."""
    config = config or ClassifyConfig()
    scored = classification_strategy(config.strategy)()
    df = evidence.withColumns(
        {f"score_{n}": s for n, (s, _) in scored.items()} | {f"_e_{n}": t for n, (_, t) in scored.items()}
    )
    df = df.withColumn("attack_type", select_attack_type(config.unknown_floor))
    df = df.withColumn("confidence", classification_confidence(config.confidence))
    matched = F.array().cast("array<string>")
    for name in dims.KNOWN_ATTACKS:
        matched = F.when(F.col("attack_type") == name, F.col(f"_e_{name}")).otherwise(matched)
    df = df.select(
        "event_id", "entity_id", "timestamp", "entity_type", "attack_type", "confidence", matched.alias("evidence"),
        F.lit(config.strategy).alias("classification_strategy"),
        F.col("anomaly_score").alias("detection_anomaly_score"),
        F.col("risk_score").alias("detection_risk_score"),
        F.col("severity").alias("detection_severity"),
        F.col("verdict").alias("detection_verdict"),
        *[f"score_{name}" for name in dims.KNOWN_ATTACKS],
    )
    df = mitre_map(df)
    return attach_truth(df, truth) if truth is not None else df.withColumn(
        "ground_truth_attack_type", F.lit(None).cast("string")
    )
