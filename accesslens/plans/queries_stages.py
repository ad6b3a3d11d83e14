"""Queries on features, profiles, detection, classification, explanations and alert export."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.operators import alerts as al
from accesslens.operators import classify as cl
from accesslens.operators import detect as de
from accesslens.operators import explain as ex
from accesslens.operators import features as fe
from accesslens.operators import profiles as pr
from accesslens.operators import reports as rp
from accesslens.operators.scan import SkewConfig
from accesslens.plans.oracle_base import CONFIDENCE_TEXT, DEV_SQL, MAXDEV, R
from accesslens.plans.pipeline import Pipeline
from accesslens.plans.queries_data import (
    ALERT_BRIEF_SQL, CLS_SQL, CORE_SQL, DET_SQL, FEATURES_ALL_SQL, SUMMARY_SQL, alert_brief, classification_columns,
    core_columns, detection_columns, summary_columns,
)
from accesslens.plans.registry import add, us
from accesslens.sources import dims

# ---- features ----

FEATURE_QUERIES = {
    "feat_history_length": "history_length", "feat_new_entity_flag": "new_entity_flag", "feat_confidence_score": "confidence_score",
    "feat_login_hour": "login_hour", "feat_day_of_week": "day_of_week", "feat_is_weekend": "is_weekend",
    "feat_working_hours_deviation": "working_hours_deviation", "feat_time_since_previous": "time_since_previous_login_seconds",
    "feat_session_zscore": "session_duration_zscore", "feat_geo_novelty": "geo_novelty", "feat_geo_velocity": "geo_velocity_kmh",
    "feat_country_change": "country_change", "feat_city_change_frequency": "city_change_frequency",
    "feat_device_familiarity": "device_familiarity_score", "feat_fingerprint_mismatch": "fingerprint_mismatch",
    "feat_os_novelty": "os_novelty", "feat_mac_novelty": "mac_novelty", "feat_success_ratio": "success_ratio",
    "feat_failure_ratio": "failure_ratio", "feat_consecutive_failures": "consecutive_failures", "feat_mfa_usage": "mfa_usage_frequency",
    "feat_resource_novelty": "resource_novelty", "feat_resource_diversity": "resource_diversity",
    "feat_command_complexity": "command_sequence_complexity", "feat_session_entropy": "session_entropy",
    "feat_burst_access": "burst_access_score", "feat_behaviour_drift": "behaviour_drift_score",
    "feat_privilege_change": "privilege_change_indicator", "feat_sensitive_resource": "sensitive_resource_access",
    "feat_rolling_mean": "rolling_mean_session_duration", "feat_rolling_std": "rolling_std_session_duration",
    "feat_moving_avg": "moving_avg_session_duration", "feat_historical_percentile": "historical_percentile_session_duration",
}
for _name, _column in FEATURE_QUERIES.items():
    add(
        _name, lambda p, c=_column: p.engineered().select("event_id", "entity_id", c),
        f"SELECT event_id, entity_id, {_column} FROM feat", "feat",
    )


def engineered_now(p: Pipeline, config: fe.FeatureConfig | None = None, skew: SkewConfig | None = None) -> DataFrame:
    return fe.engineer_features(p.events(), p.entities(), config, skew or p.skew)


add("engineer_features", lambda p: engineered_now(p).select("event_id", *schemas.FEATURE_NAMES), FEATURES_ALL_SQL, "feat")
# The same features with every entity above 60 events cut into blocks of 16, as for very long histories.
add(
    "engineer_features_blocked",
    lambda p: engineered_now(p, skew=SkewConfig(hot_rows=60, block_rows=16, salts=4)).select("event_id", *schemas.FEATURE_NAMES),
    FEATURES_ALL_SQL, "feat",
)
add(
    "feat_burst_access_day",
    lambda p: engineered_now(p, fe.FeatureConfig(burst_window_minutes=1440)).select("event_id", "burst_access_score"),
    "SELECT event_id, burst_day::DOUBLE AS burst_access_score FROM feat", "feat",
)
add(
    "previous_resource", lambda p: p.engineered().select("event_id", F.coalesce("previous_resource", F.lit("-")).alias("previous_resource")),
    "SELECT event_id, coalesce(lag(resource_accessed) OVER (PARTITION BY entity_id ORDER BY us, event_id), '-') AS previous_resource FROM lab", "lab",
)
add(
    "first_seen_flag",
    lambda p: fe.first_seen_values(p.events(), "resource_accessed", p.skew).select("event_id", "first_seen"),
    "SELECT event_id, row_number() OVER (PARTITION BY entity_id, resource_accessed ORDER BY us, event_id) = 1 AS first_seen FROM lab", "lab",
)
add(
    "profile_version_lag",
    lambda p: pr.previous_version(p.store()).select("entity_id", "version", "previous_version"),
    "SELECT entity_id, version, version - 1 AS previous_version FROM store WHERE version > 1", "store",
)

# ---- profiles ----


def _normal(p: Pipeline) -> DataFrame:
    return pr.filter_normal(p.engineered())


add(
    "profile_statistical", lambda p: pr.statistical(_normal(p)),
    "SELECT entity_id, sample_count, avg_login_hour, login_hour_std, avg_session_duration, session_duration_std, "
    "authentication_frequency_per_day, failure_rate, working_hour_ratio FROM stat2", "stat2",
)
add("profile_value_frequency", lambda p: pr.value_frequency(_normal(p)), "SELECT entity_id, kind, value, uses, share FROM val2", "val2")
TR_SQL = "SELECT entity_id, from_state, to_state, uses, probability FROM tr2 WHERE kind = '{}'"
add("profile_command_transitions", lambda p: pr.command_transitions(_normal(p)).drop("kind"), TR_SQL.format("command"), "tr2")
add(
    "profile_resource_transitions", lambda p: pr.resource_transitions(pr.resource_steps(_normal(p), p.skew)).drop("kind"),
    TR_SQL.format("resource"), "tr2",
)
SEQ_SQL = "SELECT entity_id, a AS first, b AS second, c AS third, uses, rank FROM seq2"
add("profile_common_sequences", lambda p: p.latest().sequences.drop("version"), SEQ_SQL, "seq2")
add(
    "topk_trigrams",
    lambda p: pr.common_sequences(pr.resource_steps(_normal(p), replace(p.skew, hot_rows=20, block_rows=16)), 5),
    SEQ_SQL, "seq2",
)
INDEX_SQL = "SELECT department, resource, uses, rank FROM didx2"
add("profile_department_index", lambda p: pr.department_index(pr.value_frequency(_normal(p)), p.entities(), 10), INDEX_SQL, "didx2")
add("topk_department_resources", lambda p: pr.department_index(p.latest().values, p.entities(), 10), INDEX_SQL, "didx2")
add(
    "profile_relationship",
    lambda p: pr.relationship(p.latest()).withColumn("department_common_resources", F.array_join("department_common_resources", "|")),
    "SELECT entity_id, coalesce(department, '-') AS department, resource_sharing_score, resources, devices, locations, "
    "coalesce(common, '') AS department_common_resources FROM core2 JOIN ("
    "SELECT entity_id, count(DISTINCT resource_accessed) AS resources, count(DISTINCT device_fingerprint) AS devices, "
    "count(DISTINCT geo_location) AS locations FROM nrm2 GROUP BY 1) USING (entity_id) LEFT JOIN ("
    "SELECT department, string_agg(resource, '|' ORDER BY rank) AS common FROM didx2 GROUP BY 1) USING (department)", "core2", "nrm2", "didx2",
)
add(
    "profile_drift",
    lambda p: p.latest().core.select(
        "entity_id", "drift_score", F.array_join("drifted_dimensions", ",").alias("drifted_dimensions"), "is_significant_drift",
        "historical_sample_count", "current_sample_count", "adaptation_window_days"),
    "SELECT entity_id, drift_score, drifted_dimensions, is_significant_drift, historical_sample_count, current_sample_count, "
    "30 AS adaptation_window_days FROM core2", "core2",
)
add(
    "profile_cold_start", lambda p: p.store().core.select("entity_id", "version", "is_new_entity", "confidence_score", "warmup_strategy"),
    "SELECT entity_id, version, is_new_entity, confidence_score, warmup_strategy FROM store", "store",
)
add(
    "profile_build",
    lambda p: core_columns(pr.build_profiles(
        p.engineered(), p.entities(), p.builds()[1], first_version(p), skew=p.skew).core),
    CORE_SQL.format("core2"), "core2",
)


def first_version(p: Pipeline) -> pr.Profiles:
    return pr.Profiles(*[part.filter(F.col("version") == 1) for part in p.store().parts().values()])


add(
    "profile_drift_trend",
    lambda p: pr.profile_drift_trend(p.store()).select(
        "entity_id", "profile_version_count", F.element_at("drift_score_trend", 1).alias("first_drift"),
        F.element_at("drift_score_trend", -1).alias("last_drift"), F.element_at("sample_count_trend", -1).alias("last_samples"), "drift_rising"),
    "SELECT entity_id, profile_version_count, drift_score_trend[1] AS first_drift, drift_score_trend[-1] AS last_drift, "
    "sample_count_trend[-1] AS last_samples, drift_score_trend[-1] > drift_score_trend[1] AS drift_rising FROM trend", "trend",
)

# ---- detection ----


def joined(p: Pipeline) -> DataFrame:
    return de.join_profile(p.engineered(), p.latest(), p.skew, None)


for _dim in schemas.DIMENSIONS:
    add(
        f"dev_{_dim}", lambda p, d=_dim: joined(p).select("event_id", de.deviations()[d].alias("deviation")),
        f"SELECT event_id, {DEV_SQL[_dim]} AS deviation FROM det0", "det0",
    )


def _half_unknown(p: Pipeline) -> pr.Profiles:
    return pr.Profiles(*[part.filter(~F.col("entity_id").endswith("3")) for part in p.latest().parts().values()])


add(
    "dev_unknown_profile",
    lambda p: de.detect(p.engineered(), _half_unknown(p), skew=p.skew).filter(F.col("profile_version").isNull()).select(
        "event_id", *schemas.DEVIATION_COLUMNS, "anomaly_score", "risk_cold_start_component", "entity_trust"),
    "SELECT event_id, " + ", ".join(f"0.5e0 AS {c}" for c in schemas.DEVIATION_COLUMNS)
    + ", 0.5e0 AS anomaly_score, 0.5e0 AS risk_cold_start_component, 0e0 AS entity_trust FROM feat WHERE entity_id LIKE '%3'", "feat",
)
_dev_map = lambda: {d: F.col(f"deviation_{d}") for d in schemas.DIMENSIONS}
add(
    "score_weighted_average", lambda p: p.detection().select("event_id", de.weighted_average(_dev_map()).alias("score")),
    "SELECT event_id, anomaly_score AS score FROM det", "det",
)
add(
    "score_max_deviation", lambda p: p.detection().select("event_id", de.max_deviation(_dev_map()).alias("score")),
    f"SELECT event_id, {MAXDEV} AS score FROM det", "det",
)
add(
    "score_strategy",
    lambda p: de.detect(p.engineered(), p.latest(), de.DetectConfig(strategy="max_deviation"), p.skew).select("event_id", "scoring_strategy", "anomaly_score"),
    "SELECT event_id, 'max_deviation' AS scoring_strategy, max_deviation_score AS anomaly_score FROM det", "det",
)
add(
    "attack_indicator", lambda p: p.engineered().select("event_id", de.attack_indicator().alias("indicator")),
    "SELECT event_id, risk_indicator_component AS indicator FROM det", "det",
)
add(
    "risk_score", lambda p: p.detection().select("event_id", de.risk_score(de.RiskConfig()).alias("risk"), "risk_confidence_component", "risk_trust_component"),
    "SELECT event_id, risk_score AS risk, risk_confidence_component, risk_trust_component FROM det", "det",
)
add(
    "severity", lambda p: p.detection().select("event_id", de.severity(F.col("risk_score")).alias("severity"), de.severity(F.col("risk_score") * 2).alias("doubled")),
    "SELECT event_id, severity, CASE WHEN risk_score * 2 >= 55 THEN 'critical' WHEN risk_score * 2 >= 45 THEN 'high' WHEN risk_score * 2 >= 25 THEN 'medium' "
    "WHEN risk_score * 2 >= 10 THEN 'low' ELSE 'informational' END AS doubled FROM det", "det",
)
add(
    "verdict", lambda p: p.detection().select("event_id", de.verdict(de.severity(F.col("risk_score") * 2)).alias("verdict")),
    "SELECT event_id, CASE WHEN risk_score * 2 >= 45 THEN 'anomalous' WHEN risk_score * 2 >= 25 THEN 'suspicious' ELSE 'normal' END AS verdict FROM det", "det",
)
add("detect", lambda p: detection_columns(de.detect(p.engineered(), p.latest(), skew=p.skew)), DET_SQL, "det")
add(
    "detect_salted",
    lambda p: detection_columns(de.detect(p.engineered(), p.latest(), skew=SkewConfig(hot_rows=60, block_rows=16, salts=4))),
    DET_SQL, "det",
)

# ---- classification ----

add(
    "evidence_bundle",
    lambda p: p.evidence().select(
        "event_id", "anomaly_score", "session_entropy", "resource_sharing_score", "profile_drift_score", "warmup_strategy", "profile_version_count",
        "drift_rising", F.coalesce("resource_transition_probability", F.lit(-1.0)).alias("transition_probability")),
    "SELECT event_id, anomaly_score, session_entropy, p_sharing AS resource_sharing_score, p_drift AS profile_drift_score, p_warm AS warmup_strategy, "
    "profile_version_count, drift_rising, coalesce(transition_probability, -1e0) AS transition_probability FROM evi", "evi",
)
for _attack, _query in {
    "brute_force": "score_brute_force", "credential_stuffing": "score_credential_stuffing", "impossible_travel": "score_impossible_travel",
    "device_spoofing": "score_device_spoofing", "lateral_movement": "score_lateral_movement",
    "low_and_slow_exfiltration": "score_exfiltration", "insider_drift": "score_insider_drift",
}.items():
    add(
        _query,
        lambda p, a=_attack: p.evidence().select(
            "event_id", cl.rule_based()[a][0].alias("score"), F.array_join(cl.rule_based()[a][1], " | ").alias("evidence")),
        f"SELECT event_id, score_{_attack} AS score, array_to_string(e_{_attack}, ' | ') AS evidence FROM cls1", "cls1",
    )
add(
    "matched_indicators", lambda p: p.classified().select("event_id", F.posexplode("evidence").alias("i", "indicator")).select("event_id", (F.col("i") + 1).alias("place"), "indicator"),
    "SELECT event_id, place, evidence[place] AS indicator FROM (SELECT event_id, evidence, unnest(range(1, len(evidence) + 1)) AS place FROM cls)", "cls",
)


def _scored(p: Pipeline) -> DataFrame:
    return p.evidence().withColumns({f"score_{n}": s for n, (s, _) in cl.rule_based().items()})


add(
    "select_attack_type",
    lambda p: _scored(p).select("event_id", cl.select_attack_type().alias("attack_type"), cl.select_attack_type(0.9).alias("strict")),
    "SELECT event_id, chosen AS attack_type, CASE WHEN top < 0.9e0 THEN 'unknown' ELSE chosen END AS strict FROM cls", "cls",
)
add(
    "classification_confidence",
    lambda p: _scored(p).withColumn("attack_type", cl.select_attack_type(0.7)).select("event_id", "attack_type", cl.classification_confidence().alias("confidence")),
    "SELECT event_id, CASE WHEN top < 0.7e0 THEN 'unknown' ELSE chosen END AS attack_type, CASE WHEN top < 0.7e0 THEN "
    + R("least(0.4e0, 0.2e0 * anomaly_score)", 4) + " ELSE conf END AS confidence FROM cls", "cls",
)
add(
    "mitre_map", lambda p: p.classified().select("event_id", "attack_type", "mitre_tactic", "mitre_technique"),
    "SELECT event_id, chosen AS attack_type, tactic AS mitre_tactic, technique AS mitre_technique FROM cls", "cls",
)
add(
    "attach_truth",
    lambda p: cl.attach_truth(p.classified().select("entity_id", "event_id", "attack_type"), p.truth()).select(
        "event_id", "attack_type", F.coalesce("ground_truth_attack_type", F.lit("-")).alias("truth")),
    "SELECT event_id, chosen AS attack_type, coalesce(attack_type, '-') AS truth FROM cls", "cls",
)
add("classify", lambda p: classification_columns(cl.classify(p.evidence(), p.truth())), CLS_SQL, "cls")

# ---- explanations ----

add(
    "explain_evidence",
    lambda p: p.explain_inputs().select(
        "event_id", "attack_type", "avg_session_duration", "failure_rate", "f_device", "f_resource", "f_location", "profile_version", "profile_version_count"),
    "SELECT event_id, chosen AS attack_type, p_dur AS avg_session_duration, p_fail AS failure_rate, coalesce(f_device, 0e0) AS f_device, "
    "coalesce(f_resource, 0e0) AS f_resource, coalesce(f_location, 0e0) AS f_location, p_version AS profile_version, profile_version_count FROM cls", "cls",
)


def _contributions(p: Pipeline) -> DataFrame:
    return p.explained().select("event_id", F.posexplode("contributions").alias("i", "c")).select(
        "event_id", (F.col("i") + 1).alias("place"), "c.*")


add(
    "feature_attribution", lambda p: _contributions(p).drop("explanation"),
    "SELECT event_id, place, dimension, raw_deviation, pct AS contribution_percentage FROM con", "con",
)
add("attribution_text", lambda p: _contributions(p).select("event_id", "dimension", "explanation"), "SELECT event_id, dimension, explanation FROM con", "con")
add(
    "topk_contributors",
    lambda p: p.explained().select("event_id", F.array_join(ex.topk_contributors(F.col("contributions")), " | ").alias("top_indicators")),
    "SELECT event_id, top_indicators FROM top3", "top3",
)
for _name, _column in {
    "reason_deviation": "behaviour_deviation", "reason_history": "historical_comparison", "reason_impact": "feature_impact",
    "reason_indicators": "attack_indicators",
}.items():
    add(_name, lambda p, c=_column: p.explained().select("event_id", c), f"SELECT event_id, {_column} FROM exp", "exp")
add(
    "confidence_level", lambda p: p.classified().select("event_id", ex.confidence_level(F.col("confidence")).alias("level")),
    "SELECT event_id, level FROM exp", "exp",
)
add(
    "confidence_decomposition", lambda p: p.explained().select("event_id", "match_strength", "margin", "detection_strength", "confidence_narrative"),
    f"SELECT event_id, match_strength, margin, detection_strength, {CONFIDENCE_TEXT} AS confidence_narrative FROM exp", "exp",
)
add(
    "recommend_actions",
    lambda p: p.explained().select("event_id", F.posexplode("actions").alias("i", "a")).select("event_id", (F.col("i") + 1).alias("place"), "a.priority", "a.action"),
    "SELECT event_id, place, priority, action FROM act", "act",
)


def _escalated(p: Pipeline) -> DataFrame:
    level = F.when(F.col("detection_risk_score") >= 30, "critical").otherwise("medium")
    acts = ex.recommend_actions(F.col("attack_type"), level)
    return p.classified().select("event_id", F.posexplode(acts).alias("i", "a")).select("event_id", (F.col("i") + 1).alias("place"), "a.priority", "a.action")


add(
    "recommend_actions_escalated", _escalated,
    "SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY rank, i) AS place, priority, action FROM ("
    "SELECT event_id, i, rank, priority, action FROM cls JOIN cat ON type_name = chosen UNION ALL "
    f"SELECT event_id, 0, 0, '{dims.ESCALATION[0]}', '{dims.ESCALATION[1]}' FROM cls WHERE risk_score >= 30)", "cls", "cat",
)
add("analyst_summary", lambda p: summary_columns(ex.analyst_summary(p.explained())), SUMMARY_SQL, "exp", "actl")
add(
    "explain",
    lambda p: ex.explain(p.explain_inputs()).select(
        "event_id", us(), "risk_score", "attack_type", "confidence_level", "severity", "behaviour_deviation", "historical_comparison", "feature_impact",
        "attack_indicators", F.size("actions").alias("actions"), F.element_at("contributions", 1)["dimension"].alias("first_dimension")),
    "SELECT event_id, us, risk_score, chosen AS attack_type, level AS confidence_level, severity, behaviour_deviation, historical_comparison, feature_impact, "
    "attack_indicators, n AS actions, dimension AS first_dimension FROM exp JOIN (SELECT event_id, count(*) AS n FROM act GROUP BY 1) USING (event_id) "
    "JOIN (SELECT event_id, dimension FROM con WHERE place = 1) USING (event_id)", "exp", "act", "con",
)

# ---- alert export ----

add(
    "build_alerts",
    lambda p: alert_brief(al.build_alerts(p.classified(), p.detection(), p.explained(), p.engineered(), p.entities(), p.latest())),
    ALERT_BRIEF_SQL, "alr", "hist",
)
add(
    "alert_contributions",
    lambda p: p.alerts().select("eventId", F.posexplode("featureContributions").alias("i", "c")).select(
        "eventId", (F.col("i") + 1).alias("place"), "c.dimension", "c.contributionPercentage", "c.explanation"),
    'SELECT event_id AS "eventId", place, dimension, pct AS "contributionPercentage", explanation FROM con WHERE event_id IN (SELECT event_id FROM alr)',
    "con", "alr",
)
add(
    "alert_profile_baseline",
    lambda p: p.alerts().select("eventId", "profileBaseline.*"),
    'SELECT event_id AS "eventId", p_dur AS "avgSessionDuration", p_dur_sd AS "sessionDurationStd", p_hour AS "avgLoginHour", p_hour_sd AS "loginHourStd", '
    'c.sample_count AS "sampleCount", p_fail AS "failureRate", p_version AS "profileVersion", p_drift AS "driftScore", p_warm AS "warmupStrategy" '
    "FROM alr JOIN core2 c USING (entity_id)", "alr", "core2",
)
add(
    "mitre_reference",
    lambda p: dims.attack_registry(p.spark).join(rp.counts_by(p.classified(), "attack_type"), "attack_type", "left").fillna(0, ["events"]),
    "SELECT type_name AS attack_type, display_name, tactic AS mitre_tactic, technique AS mitre_technique, typical AS typical_severity, about AS description, "
    "(SELECT count(*) FROM cls WHERE chosen = type_name) AS events FROM reg", "reg", "cls",
)
add(
    "export_row_counts",
    lambda p: rp.export_row_counts({
        "detection": p.detection(), "classification": p.classified(), "explanation": p.explained(), "alerts": al.export_feed(p.alerts()), "profiles": p.latest().core}),
    "SELECT 'detection' AS source, count(*) AS rows FROM det UNION ALL SELECT 'classification', count(*) FROM cls UNION ALL "
    "SELECT 'explanation', count(*) FROM exp UNION ALL SELECT 'alerts', count(*) FROM alr WHERE alert_place <= 45 UNION ALL SELECT 'profiles', count(*) FROM core2",
    "det", "cls", "exp", "alr", "core2",
)
add(
    "topk_alerts_per_type",
    lambda p: al.topk_alerts_per_type(p.classified()).select("event_id", "attack_type", "detection_risk_score"),
    "SELECT event_id, chosen AS attack_type, risk_score AS detection_risk_score FROM alr WHERE alert_place <= 45", "alr",
)

# ---- extension points ----


def _extended(p: Pipeline) -> DataFrame:
    """A strategy a user adds: the mean of the two largest deviations."""

    def two_largest(deviations):
        ordered = F.sort_array(F.array(*deviations.values()), asc=False)
        return de.round_dp((F.element_at(ordered, 1) + F.element_at(ordered, 2)) / 2.0, 4)

    de.register_scoring_strategy("two_largest", two_largest)
    return de.detect(p.engineered(), p.latest(), de.DetectConfig(strategy="two_largest"), p.skew).select("event_id", "anomaly_score", "scoring_strategy")


_sorted = "list_reverse_sort([" + ", ".join(f"deviation_{d}" for d in schemas.DIMENSIONS) + "])"
add(
    "ext_scoring_strategy", _extended,
    f"SELECT event_id, {R(f'({_sorted}[1] + {_sorted}[2]) / 2e0', 4)} AS anomaly_score, 'two_largest' AS scoring_strategy FROM det", "det",
)


def _extended_types(p: Pipeline) -> DataFrame:
    """A classifier a user adds: each type scores its own primary deviation."""

    def by_dimension():
        return {
            name: (F.col(f"deviation_{dim}"), F.array(F.lit(f"{dim} deviation"))) for name, dim in dims.PRIMARY_DIMENSION.items()
        }

    cl.register_classification_strategy("by_dimension", by_dimension)
    done = cl.classify(p.evidence(), None, cl.ClassifyConfig(strategy="by_dimension"))
    return done.select("event_id", "attack_type", "classification_strategy")


_types = " UNION ALL ".join(f"SELECT event_id, '{n}' AS name, deviation_{d} AS score FROM evi" for n, d in dims.PRIMARY_DIMENSION.items())
add(
    "ext_classification_strategy", _extended_types,
    f"SELECT event_id, CASE WHEN score < 0.4e0 THEN 'unknown' ELSE name END AS attack_type, 'by_dimension' AS classification_strategy FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, name DESC) AS r FROM ({_types})) WHERE r = 1", "evi",
)


def _thresholds(p: Pipeline) -> DataFrame:
    config = de.DetectConfig(
        risk=de.RiskConfig(deviation=0.6, indicator=0.2, confidence=0.1, trust=0.05, cold_start=0.05),
        thresholds=de.ThresholdConfig(5.0, 20.0, 20.0, 35.0, 50.0),
    )
    return de.detect(p.engineered(), p.latest(), config, p.skew).select("event_id", "risk_score", "severity", "verdict")


_risk2 = R("100e0 * greatest(0e0, least(1e0, 0.6e0 * risk_deviation_component + 0.2e0 * risk_indicator_component + 0.1e0 * risk_confidence_component "
           "+ 0.05e0 * risk_trust_component + 0.05e0 * risk_cold_start_component))", 2)
add(
    "ext_thresholds", _thresholds,
    f"SELECT event_id, r AS risk_score, CASE WHEN r >= 50 THEN 'critical' WHEN r >= 35 THEN 'high' WHEN r >= 20 THEN 'medium' ELSE 'informational' END AS severity, "
    f"CASE WHEN r >= 35 THEN 'anomalous' WHEN r >= 20 THEN 'suspicious' ELSE 'normal' END AS verdict FROM (SELECT event_id, {_risk2} AS r FROM det)", "det",
)
