"""Alert documents and the triage queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.operators.explain import topk_contributors
from accesslens.operators.profiles import KEY, Profiles
from accesslens.operators.scan import running_totals, slot

# Report sizes.
ALERTS_PER_TYPE = 45
HISTORY_EVENTS = 12
PAGE_SIZE = 25
PREVIEW_ENTITIES = 6

# Field names of the exported documents.
HISTORY_FIELDS = {
    "timestamp": "timestamp", "resourceAccessed": "resource_accessed", "deviceFingerprint": "device_fingerprint",
    "geoLocation": "geo_location", "loginResult": "login_result", "sessionDuration": "session_duration", "authMethod": "auth_method",
}
BASELINE_FIELDS = {
    "avgSessionDuration": "avg_session_duration", "sessionDurationStd": "session_duration_std", "avgLoginHour": "avg_login_hour",
    "loginHourStd": "login_hour_std", "sampleCount": "sample_count", "failureRate": "failure_rate", "profileVersion": "version",
    "driftScore": "drift_score", "warmupStrategy": "warmup_strategy",
}


def topk_alerts_per_type(classified: DataFrame, k: int = ALERTS_PER_TYPE) -> DataFrame:
    """The k riskiest classified events of each attack type."""
    best = Window.partitionBy("attack_type").orderBy(F.desc("detection_risk_score"), "event_id")
    return classified.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= k).drop("_place")


def alert_history_window(engineered: DataFrame, wanted: DataFrame, events: int = HISTORY_EVENTS) -> DataFrame:
    """For each wanted event (entity_id, event_id), its entity's last events up to and including it, oldest first.

    ``history_length`` is an event's position in its entity, so a wanted event names the positions it needs, and
    these meet the events in one equi-join on entity and position. Entities of any length spread over all tasks,
    no history is sorted, and a small ``wanted`` lets Spark send it to the events instead of moving them.
    """
    columns = tuple(HISTORY_FIELDS.values())
    if "history_length" not in wanted.columns:
        wanted = wanted.select(KEY, "event_id").join(engineered.select(KEY, "event_id", "history_length"), [KEY, "event_id"])
    first = F.greatest(F.col("history_length") - (events - 1), F.lit(0))
    needed = wanted.select(KEY, "event_id", F.explode(F.sequence(first, F.col("history_length"))).alias("_at"))
    # One column for both keys: rows placed by entity must not count as placed by position.
    needed = needed.select(KEY, "event_id", "_at", slot(KEY, "_at").alias("_slot"))
    shown = engineered.select(slot(KEY, "history_length").alias("_slot"), F.struct(*[F.col(c).alias(n) for n, c in HISTORY_FIELDS.items()]).alias("_shown"))
    listed = needed.join(shown, "_slot").groupBy(KEY, "event_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_shown"))).alias("_rows"))
    return listed.select(KEY, "event_id", F.transform("_rows", lambda r: r["_shown"]).alias("history"))


def alert_profile_baseline(core: DataFrame) -> DataFrame:
    """The snapshot of profile fields an alert shows."""
    fields = [F.col(c).alias(n) for n, c in BASELINE_FIELDS.items()]
    return core.select(KEY, F.struct(*fields).alias("profile_baseline"))


def join_entity_meta(alerts: DataFrame, entities: DataFrame) -> DataFrame:
    return alerts.join(entities.select(KEY, "department", "role", "home_location", "timezone"), KEY, "left")


def join_alert_inputs(
    classified: DataFrame, detection: DataFrame, explained: DataFrame, engineered: DataFrame
) -> DataFrame:
    """Classification with deviations, explanation and features, all by entity and event."""
    feature_columns = (
        "login_result", "login_hour", "session_duration", "resource_accessed", "device_fingerprint", "geo_location",
        "consecutive_failures", "geo_velocity_kmh", "auth_method", "sensitive_resource_access", "history_length",
    )
    return (
        classified.join(detection.select(KEY, "event_id", *schemas.DEVIATION_COLUMNS), [KEY, "event_id"], "left")
        .join(
            explained.select(
                KEY, "event_id", "confidence_level", "contributions", "confidence_narrative", "actions",
                F.concat_ws(
                    " ", "behaviour_deviation", "historical_comparison", "feature_impact", "attack_indicators"
                ).alias("evidence_summary"),
            ),
            [KEY, "event_id"],
            "left",
        )
        .join(engineered.select(KEY, "event_id", *feature_columns), [KEY, "event_id"], "left")
    )


def alert_contributions(contributions: Column) -> Column:
    return F.transform(
        F.filter(contributions, lambda e: e["dimension"].isNotNull()),
        lambda e: F.struct(
            e["dimension"].alias("dimension"),
            e["contribution_percentage"].alias("contributionPercentage"),
            e["explanation"].alias("explanation"),
        ),
    )


def build_alerts(
    classified: DataFrame, detection: DataFrame, explained: DataFrame, engineered: DataFrame, entities: DataFrame,
    latest: Profiles, per_type: int | None = None,
) -> DataFrame:
    """The alert feed: every flagged event, or the riskiest ``per_type`` of each type, before the wide joins."""
    sample = classified if per_type is None else topk_alerts_per_type(classified, per_type)
    df = join_entity_meta(join_alert_inputs(sample, detection, explained, engineered), entities)
    df = df.join(alert_history_window(engineered, df), [KEY, "event_id"], "left")
    df = df.join(alert_profile_baseline(latest.core), KEY, "left")
    camel = {
        "eventId": "event_id", "entityId": "entity_id", "entityType": "entity_type", "department": "department",
        "role": "role", "homeLocation": "home_location", "timezone": "timezone", "timestamp": "timestamp",
        "riskScore": "detection_risk_score", "anomalyScore": "detection_anomaly_score",
        "severity": "detection_severity", "verdict": "detection_verdict", "attackType": "attack_type",
        "attackDisplayName": "display_name", "confidence": "confidence",
        "mitreTactic": "mitre_tactic", "mitreTechnique": "mitre_technique",
    }
    return df.select(
        *[F.col(source).alias(name) for name, source in camel.items()],
        F.coalesce("confidence_level", F.lit("low")).alias("confidenceLevel"),
        F.struct(*[F.col(f"deviation_{d}").alias(d) for d in schemas.DIMENSIONS]).alias("dimensionDeviations"),
        topk_contributors(F.col("contributions")).alias("topIndicators"),
        alert_contributions(F.col("contributions")).alias("featureContributions"),
        F.coalesce("evidence_summary", F.lit("")).alias("evidenceSummary"),
        F.coalesce("confidence_narrative", F.lit("")).alias("confidenceExplanation"),
        F.col("actions").alias("recommendedActions"),
        F.col("evidence").alias("matchedIndicators"),
        F.struct(
            F.col("login_result").alias("loginResult"), F.col("login_hour").alias("loginHour"),
            F.col("session_duration").alias("sessionDuration"), F.col("resource_accessed").alias("resourceAccessed"),
            F.col("device_fingerprint").alias("deviceFingerprint"), F.col("geo_location").alias("geoLocation"),
            F.col("consecutive_failures").alias("consecutiveFailures"),
            F.col("geo_velocity_kmh").alias("geoVelocityKmh"), F.col("auth_method").alias("authMethod"),
            F.col("sensitive_resource_access").alias("sensitiveResourceAccess"),
        ).alias("feature"),
        F.col("history"),
        F.col("profile_baseline").alias("profileBaseline"),
    )


def export_feed(alerts: DataFrame, k: int = ALERTS_PER_TYPE) -> DataFrame:
    """The alerts that the exported file shows: the k riskiest of each type."""
    best = Window.partitionBy("attackType").orderBy(F.desc("riskScore"), "eventId")
    return alerts.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= k).drop("_place")


# ---- triage over alerts (camelCase alert columns) ----


def join_triage_status(alerts: DataFrame, status: DataFrame) -> DataFrame:
    """Analyst status per alert; an alert nobody touched is open."""
    states = status.select(F.col("event_id").alias("eventId"), "status")
    return alerts.join(states, "eventId", "left").withColumn("status", F.coalesce("status", F.lit("open")))


def alert_search(alerts: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring over entity, event, attack name and technique; blank finds all."""
    text = query.strip().lower()
    if not text:
        return alerts
    fields = ("entityId", "eventId", "attackDisplayName", "mitreTechnique")
    hit = F.lit(False)
    for name in fields:
        hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(text)), F.lit(False))
    return alerts.filter(hit)


def alert_filter(
    alerts: DataFrame, severity: str | None = None, attack_type: str | None = None, status: str | None = None
) -> DataFrame:
    for column, wanted in (("severity", severity), ("attackType", attack_type), ("status", status)):
        if wanted is not None:
            alerts = alerts.filter(F.col(column) == wanted)
    return alerts


SORT_KEYS = {"timestamp": "timestamp", "risk": "riskScore", "confidence": "confidence"}


def sort_alerts(alerts: DataFrame, by: str = "risk", descending: bool = True) -> DataFrame:
    column = F.col(SORT_KEYS[by])
    return alerts.orderBy(column.desc() if descending else column.asc(), "eventId")


def paginate_alerts(
    alerts: DataFrame, page: int, by: str = "risk", descending: bool = True, size: int = PAGE_SIZE
) -> DataFrame:
    """One page in sort order; a page past the end becomes the last one. Positions come from a distributed count."""
    column = F.col(SORT_KEYS[by])
    placed = running_totals(
        alerts, [column.desc() if descending else column.asc(), F.col("eventId")], {"position": F.lit(1)}
    )
    total = placed.select(F.coalesce(F.max("position"), F.lit(1))).scalar()
    wanted = F.greatest(F.lit(1), F.least(F.lit(page), F.ceil(total / F.lit(size))))
    return placed.filter(F.ceil(F.col("position") / F.lit(size)) == wanted)


def distinct_attack_types(alerts: DataFrame) -> DataFrame:
    return alerts.select("attackType").distinct().orderBy("attackType")


def _severity_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, schemas.SEVERITIES)), level)


def entity_alert_summary(alerts: DataFrame) -> DataFrame:
    """Per entity: its type and department, alerts, highest risk and severity, last sight and latest alert."""
    latest = F.struct("timestamp", "eventId")
    return alerts.groupBy("entityId").agg(
        F.max("entityType").alias("entity_type"),
        F.max("department").alias("department"),
        F.count("*").alias("alert_count"),
        F.max("riskScore").alias("max_risk"),
        F.max_by("severity", _severity_rank(F.col("severity"))).alias("highest_severity"),
        F.max("timestamp").alias("last_seen"),
        F.max_by("eventId", latest).alias("most_recent_alert"),
    ).orderBy(F.desc("max_risk"), "entityId")


def alert_value_counts(alerts: DataFrame) -> DataFrame:
    """Devices and locations inside each alert's history, with counts."""
    event = F.explode("history")
    pairs = F.array(
        F.struct(F.lit("device").alias("kind"), F.col("h.deviceFingerprint").alias("value")),
        F.struct(F.lit("location").alias("kind"), F.col("h.geoLocation").alias("value")),
    )
    flat = alerts.select("eventId", event.alias("h")).select("eventId", F.explode(pairs).alias("p"))
    return flat.groupBy("eventId", F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).agg(
        F.count("*").alias("events")
    )


def previous_alerts(alerts: DataFrame, event_id: str) -> DataFrame:
    """The other alerts of one alert's entity."""
    focus = alerts.filter(F.col("eventId") == event_id).select("entityId")
    return alerts.join(F.broadcast(focus), "entityId", "left_semi").filter(F.col("eventId") != event_id)


def topk_open_alert_per_entity(alerts: DataFrame, k: int = PREVIEW_ENTITIES) -> DataFrame:
    """The riskiest open alert of each entity, for the k entities with the highest."""
    best = F.min_by(F.struct("eventId", "riskScore", "severity", "attackType"), F.struct((-F.col("riskScore")).alias("r"), "eventId"))
    per_entity = alerts.filter(F.col("status") == "open").groupBy("entityId").agg(best.alias("a"))
    return per_entity.select("entityId", "a.*").orderBy(F.desc("riskScore"), "eventId").limit(k)

