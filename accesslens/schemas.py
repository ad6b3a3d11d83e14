"""Explicit schemas, column lists and value domains."""

from __future__ import annotations

from pyspark.sql import types as T



def _ddl(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Column names of the data model, in file order.
REQUIRED_EVENT_COLUMNS = (
    "event_id", "timestamp", "entity_id", "entity_type", "source_ip", "geo_location", "resource_accessed",
    "auth_method", "session_duration", "command_sequence", "device_fingerprint", "login_result",
    "risk_context", "label",
)
OPTIONAL_EVENT_COLUMNS = ("device_os", "device_mac")
ATTACK_COLUMNS = (
    "attack_id", "attack_type", "severity", "mitre_tactic", "mitre_technique", "confidence", "injected", "description",
)
LABELLED_EVENT_COLUMNS = REQUIRED_EVENT_COLUMNS + OPTIONAL_EVENT_COLUMNS + ATTACK_COLUMNS
GROUND_TRUTH_COLUMNS = (
    "event_id", "entity_id", "is_attack", "attack_id", "attack_type", "severity", "mitre_tactic", "mitre_technique",
    "confidence",
)

EVENT_DDL = (
    "event_id string, timestamp timestamp, entity_id string, entity_type string, source_ip string, "
    "geo_location string, resource_accessed string, auth_method string, session_duration bigint, "
    "command_sequence string, device_fingerprint string, login_result string, risk_context string, label string, "
    "device_os string, device_mac string"
)
ENTITY_DDL = (
    "entity_id string, entity_type string, display_name string, department string, role string, "
    "privilege_level string, home_location string, home_country string, timezone string, working_hours_start int, "
    "working_hours_end int, active_days string, normal_resources string, authentication_methods string, "
    "trusted_device_count int, normal_login_frequency double, is_remote boolean, network_cidr string, "
    "schedule_type string"
)
GROUND_TRUTH_DDL = (
    "event_id string, entity_id string, is_attack boolean, attack_id string, attack_type string, severity string, "
    "mitre_tactic string, mitre_technique string, confidence double"
)


def event_schema() -> T.StructType:
    return _ddl(EVENT_DDL)


def entity_schema() -> T.StructType:
    return _ddl(ENTITY_DDL)


def ground_truth_schema() -> T.StructType:
    return _ddl(GROUND_TRUTH_DDL)


# The engineered features as (name, category, type), in registry order.
FEATURES = (
    ("login_hour", "temporal", "int"),
    ("day_of_week", "temporal", "int"),
    ("is_weekend", "temporal", "bool"),
    ("working_hours_deviation", "temporal", "float"),
    ("time_since_previous_login_seconds", "temporal", "float"),
    ("session_duration_zscore", "temporal", "float"),
    ("geo_novelty", "geographic", "bool"),
    ("geo_velocity_kmh", "geographic", "float"),
    ("country_change", "geographic", "bool"),
    ("city_change_frequency", "geographic", "float"),
    ("device_familiarity_score", "device", "float"),
    ("fingerprint_mismatch", "device", "bool"),
    ("os_novelty", "device", "bool"),
    ("mac_novelty", "device", "bool"),
    ("success_ratio", "authentication", "float"),
    ("failure_ratio", "authentication", "float"),
    ("consecutive_failures", "authentication", "int"),
    ("mfa_usage_frequency", "authentication", "float"),
    ("resource_novelty", "behaviour", "bool"),
    ("resource_diversity", "behaviour", "float"),
    ("command_sequence_complexity", "behaviour", "float"),
    ("session_entropy", "behaviour", "float"),
    ("burst_access_score", "behaviour", "float"),
    ("behaviour_drift_score", "behaviour", "float"),
    ("privilege_change_indicator", "privilege", "bool"),
    ("sensitive_resource_access", "privilege", "bool"),
    ("rolling_mean_session_duration", "statistical", "float"),
    ("rolling_std_session_duration", "statistical", "float"),
    ("moving_avg_session_duration", "statistical", "float"),
    ("historical_percentile_session_duration", "statistical", "float"),
    ("history_length", "cold_start", "int"),
    ("new_entity_flag", "cold_start", "bool"),
    ("confidence_score", "cold_start", "float"),
)
FEATURE_NAMES = tuple(name for name, _, _ in FEATURES)

# Decimals each real-valued feature is rounded to.
FEATURE_DECIMALS = {
    "working_hours_deviation": 1, "time_since_previous_login_seconds": 2, "session_duration_zscore": 4,
    "geo_velocity_kmh": 2, "city_change_frequency": 4, "device_familiarity_score": 4, "success_ratio": 4,
    "failure_ratio": 4, "mfa_usage_frequency": 4, "resource_diversity": 4, "command_sequence_complexity": 4,
    "session_entropy": 4, "burst_access_score": 1, "behaviour_drift_score": 4, "rolling_mean_session_duration": 2,
    "rolling_std_session_duration": 2, "moving_avg_session_duration": 2,
    "historical_percentile_session_duration": 2, "confidence_score": 4,
}

# Value domains.
ENTITY_TYPES = ("user", "service_account", "edge_device", "iot_device")
SEVERITIES = ("informational", "low", "medium", "high", "critical")
VERDICTS = ("normal", "suspicious", "anomalous")
WARMUP_STATES = ("insufficient_data", "warming_up", "established")
CONFIDENCE_LEVELS = ("low", "medium", "high")
PRIORITIES = ("immediate", "high", "standard")
TRIAGE_STATES = ("open", "investigating", "resolved", "false_positive")
DIMENSIONS = ("temporal", "device", "resource", "geographic", "authentication", "session")
DEVIATION_COLUMNS = tuple(f"deviation_{name}" for name in DIMENSIONS)

# Features that are shares.
RATIO_FEATURES = (
    "success_ratio", "failure_ratio", "mfa_usage_frequency", "resource_diversity", "city_change_frequency",
    "confidence_score", "command_sequence_complexity", "device_familiarity_score", "behaviour_drift_score",
)
BOOLEAN_FEATURES = tuple(name for name, _, kind in FEATURES if kind == "bool")

# The columns each later stage reads; labels are left out on purpose.
CLASSIFY_FEATURE_COLUMNS = (
    "event_id", "resource_accessed", "login_result", "consecutive_failures", "burst_access_score",
    "mfa_usage_frequency", "geo_velocity_kmh", "country_change", "geo_novelty", "device_familiarity_score",
    "fingerprint_mismatch", "os_novelty", "mac_novelty", "resource_novelty", "resource_diversity",
    "sensitive_resource_access", "privilege_change_indicator", "session_entropy", "command_sequence_complexity",
    "behaviour_drift_score", "historical_percentile_session_duration", "history_length", "new_entity_flag",
)
CLASSIFY_DETECTION_COLUMNS = (
    "event_id", "entity_id", "timestamp", "entity_type", "anomaly_score", "risk_score", "severity", "verdict",
) + DEVIATION_COLUMNS
EXPLAIN_FEATURE_COLUMNS = tuple(
    dict.fromkeys(
        CLASSIFY_FEATURE_COLUMNS
        + ("login_hour", "working_hours_deviation", "session_duration", "device_fingerprint", "geo_location")
    )
)
