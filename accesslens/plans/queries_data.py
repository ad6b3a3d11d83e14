"""Queries on sources, sinks, projections, filters, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens import schemas
from accesslens.functions import numeric as nu
from accesslens.functions import text as tx
from accesslens.operators import alerts as al
from accesslens.operators import classify as cl
from accesslens.operators import detect as de
from accesslens.operators import evaluate as ev
from accesslens.operators import explain as ex
from accesslens.operators import features as fe
from accesslens.operators import profiles as pr
from accesslens.operators import quality as qa
from accesslens.operators import reports as rp
from accesslens.plans.oracle_base import CONFIDENCE_TEXT, FEATURE_SQL, FIRST_BUILD_SQL, HAVERSINE, R
from accesslens.plans.pipeline import Pipeline
from accesslens.plans.registry import add, tagged, us
from accesslens.sources import dims, readers, sinks

def event_columns() -> list:
    return [
        "event_id", us(), "entity_id", "entity_type", "source_ip", "geo_location", "resource_accessed", "auth_method",
        "session_duration", F.coalesce("command_sequence", F.lit("")).alias("command_sequence"), "device_fingerprint",
        "login_result", "risk_context", "label", F.coalesce("device_os", F.lit("-")).alias("device_os"),
        F.coalesce("device_mac", F.lit("-")).alias("device_mac"),
    ]


EVENT_SQL = (
    "SELECT event_id, us, entity_id, entity_type, source_ip, geo_location, resource_accessed, auth_method, session_duration, "
    "command_sequence, device_fingerprint, login_result, risk_context, label, coalesce(device_os, '-') AS device_os, "
    "coalesce(device_mac, '-') AS device_mac FROM lab"
)
ENT_SQL = (
    "SELECT entity_id, entity_type, display_name, coalesce(department, '-') AS department, coalesce(role, '-') AS role, privilege_level, "
    "home_location, home_country, timezone, wh_start AS working_hours_start, wh_end AS working_hours_end, active_days, "
    "normal_resources, is_remote, network_cidr FROM ent"
)


def entity_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "entity_id", "entity_type", "display_name", F.coalesce("department", F.lit("-")).alias("department"),
        F.coalesce("role", F.lit("-")).alias("role"), "privilege_level", "home_location", "home_country", "timezone",
        "working_hours_start", "working_hours_end", "active_days", "normal_resources", "is_remote", "network_cidr",
    )


# ---- sources ----


def events_csv(p: Pipeline) -> str:
    return p.once("events.csv", lambda path: sinks.sink_csv(p.events(), path))


def _events_from(p: Pipeline, suffix: str) -> DataFrame:
    path = p.once(f"sized{suffix}", lambda base: (
        sinks.sink_csv(p.events(), base + suffix) if suffix == ".csv" else sinks.sink_parquet(p.events(), base + suffix)))
    return readers.scan_events(p.spark, path + suffix)


def backwards(df: DataFrame) -> DataFrame:
    """The columns in reverse, which a reader that goes by name must not notice."""
    return df.select(*reversed(df.columns))


add("scan_events", lambda p: readers.scan_events(p.spark, events_csv(p)).select(*event_columns()), EVENT_SQL, "lab")
add(
    "scan_entities",
    lambda p: entity_columns(readers.scan_entities(
        p.spark, p.once("entities.csv", lambda path: sinks.sink_csv(backwards(p.entities()), path)))),
    ENT_SQL, "ent",
)
TRUTH_SQL = ("SELECT event_id, entity_id, is_attack, coalesce(attack_id, '-') AS attack_id, coalesce(attack_type, '-') AS attack_type, "
             "coalesce(severity, '-') AS severity, coalesce(confidence, -1e0) AS confidence FROM lab")


def truth_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "entity_id", "is_attack",
        *[F.coalesce(c, F.lit("-")).alias(c) for c in ("attack_id", "attack_type", "severity")],
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
    )


add(
    "scan_ground_truth",
    lambda p: truth_columns(readers.scan_ground_truth(
        p.spark, p.once("truth.csv", lambda path: sinks.sink_csv(backwards(p.truth()), path)))),
    TRUTH_SQL, "lab",
)
def _with_bad_values(p: Pipeline) -> str:
    """The events as CSV, some of them with a duration or timestamp that is none."""
    duration = F.when(F.col("event_id").endswith("00"), F.lit("12.5")).otherwise(F.col("session_duration").cast("string"))
    when = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    stamp = F.when(F.col("event_id").endswith("50"), F.lit("yesterday")).otherwise(when)
    return p.once("bad.csv", lambda path: sinks.sink_csv(p.events().withColumns({"session_duration": duration, "timestamp": stamp}), path))


def _quarantined(p: Pipeline) -> DataFrame:
    good, bad = readers.scan_events_quarantined(p.spark, _with_bad_values(p))
    return good.select("event_id", "session_duration", F.lit("").alias("bad_columns")).unionByName(
        bad.select("values.event_id", F.lit(None).cast("long").alias("session_duration"), F.array_join("bad_columns", ",").alias("bad_columns")))


add(
    "scan_events_quarantine", _quarantined,
    "SELECT event_id, CASE WHEN right(event_id, 2) NOT IN ('00', '50') THEN session_duration END AS session_duration, "
    "CASE right(event_id, 2) WHEN '00' THEN 'session_duration' WHEN '50' THEN 'timestamp' ELSE '' END AS bad_columns FROM lab", "lab",
)
add(
    "scan_by_suffix",
    lambda p: tagged(parquet=_events_from(p, ".parquet"), csv=_events_from(p, ".csv")).groupBy("source", "entity_id").agg(
        F.count("*").alias("events"), F.sum("session_duration").alias("seconds"), F.max(F.unix_micros("timestamp")).alias("last_us")),
    "SELECT source, entity_id, count(*) AS events, sum(session_duration)::BIGINT AS seconds, max(us) AS last_us "
    "FROM lab CROSS JOIN (VALUES ('parquet'), ('csv')) s(source) GROUP BY ALL", "lab",
)

CORE = (
    "entity_id", "entity_type", "version", "sample_count", *pr.STATISTICS, "resource_sharing_score", "drift_score",
    "is_significant_drift", "historical_sample_count", "current_sample_count", "history_length", "is_new_entity",
    "confidence_score", "warmup_strategy",
)


def core_columns(core: DataFrame) -> DataFrame:
    return core.select(
        *CORE, F.coalesce("department", F.lit("-")).alias("department"),
        F.array_join("drifted_dimensions", ",").alias("drifted_dimensions"),
    )


CORE_SQL = "SELECT " + ", ".join(CORE) + ", coalesce(department, '-') AS department, drifted_dimensions FROM {}"
add("scan_profiles_latest", lambda p: core_columns(p.latest().core), CORE_SQL.format("core2"), "core2")
add(
    "scan_profile_history",
    lambda p: pr.scan_profile_history(p.store()).select("entity_id", F.posexplode("history").alias("pos", "v")).select(
        "entity_id", (F.col("pos") + 1).alias("position"), "v.version", "v.drift_score", "v.sample_count"),
    "SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY version) AS position, version, drift_score, sample_count FROM store",
    "store",
)
add("list_profiled_entities", lambda p: pr.list_profiled_entities(p.store()), "SELECT DISTINCT entity_id FROM store", "store")
add(
    "add_optional_columns",
    lambda p: readers.add_optional_columns(p.events().drop("device_os", "device_mac")).select(
        "event_id", F.col("device_os").isNull().alias("os_missing"), F.col("device_mac").isNull().alias("mac_missing")),
    "SELECT event_id, true AS os_missing, true AS mac_missing FROM lab", "lab",
)
add(
    "require_columns",
    lambda p: readers.require_columns(p.events(), schemas.REQUIRED_EVENT_COLUMNS, "events").select("event_id", "entity_id", us()),
    "SELECT event_id, entity_id, us FROM lab", "lab",
)


def _mixed(p: Pipeline) -> DataFrame:
    raw = (
        F.when(F.col("attack_type") == "brute_force", "TRUE").when(F.col("is_attack"), "True")
        .when(F.col("entity_id").endswith("7"), F.lit(None).cast("string")).when(F.col("entity_id").endswith("3"), "unclear")
        .otherwise("False")
    )
    return p.truth().select("event_id", tx.mixed_bool(raw).alias("flag"))


add(
    "parse_mixed_bool",
    lambda p: _mixed(p).select("event_id", F.coalesce(F.col("flag").cast("string"), F.lit("null")).alias("flag")),
    "SELECT event_id, CASE WHEN is_attack THEN 'true' WHEN entity_id LIKE '%7' OR entity_id LIKE '%3' THEN 'null' ELSE 'false' END AS flag FROM lab",
    "lab",
)
ALERT_BRIEF_SQL = (
    "SELECT a.event_id AS \"eventId\", a.entity_id AS \"entityId\", risk_score AS \"riskScore\", chosen AS \"attackType\", "
    "conf AS confidence, level AS \"confidenceLevel\", h.n AS history_events, len(evidence) AS indicators "
    "FROM alr a JOIN (SELECT event_id, count(*) AS n FROM hist GROUP BY 1) h USING (event_id)"
)


def alert_brief(df: DataFrame) -> DataFrame:
    return df.select(
        "eventId", "entityId", "riskScore", "attackType", "confidence", "confidenceLevel",
        F.size("history").alias("history_events"), F.size("matchedIndicators").alias("indicators"),
    )


add(
    "scan_alert_documents",
    lambda p: alert_brief(readers.scan_alert_documents(
        p.spark, p.once("alerts.json", lambda path: sinks.sink_json(p.alerts(), path)), p.alerts().schema)),
    ALERT_BRIEF_SQL, "alr", "hist",
)

# ---- sinks: written, then read back ----

add(
    "sink_csv",
    lambda p: entity_columns(readers.read_csv(p.spark, sinks.sink_csv(p.entities(), p.path("entities")), schemas.entity_schema())),
    ENT_SQL, "ent",
)
add(
    "sink_parquet",
    lambda p: entity_columns(p.spark.read.schema(schemas.entity_schema()).parquet(sinks.sink_parquet(p.entities(), p.path("entities")))),
    ENT_SQL, "ent",
)
add(
    "sink_json",
    lambda p: entity_columns(p.spark.read.schema(schemas.entity_schema()).json(sinks.sink_json(p.entities(), p.path("entities")))),
    ENT_SQL, "ent",
)
add(
    "sink_profiles_append",
    # The newest build is appended once more, which must change nothing.
    lambda p: tagged(**{
        name: part.groupBy("version").agg(F.count("*").alias("rows"))
        for name, part in pr.scan_store(p.spark, pr.sink_profiles_append(p.latest(), p.store_path())).parts().items()}),
    " UNION ALL ".join(
        f"SELECT '{name}' AS source, {v} AS version, count(*) AS rows FROM {table}{v}"
        for v in (1, 2) for name, table in (("core", "core"), ("values", "val"), ("transitions", "tr"), ("sequences", "seq"))),
    *[f"{t}{v}" for v in (1, 2) for t in ("core", "val", "tr", "seq")],
)


def csv_back(p: Pipeline, df: DataFrame, name: str) -> DataFrame:
    """The CSV half of a two-format sink, read with the types of the source (arrays as text)."""
    path, _ = sinks.sink_both(df, p.path(name))
    flat = sinks.flat(df).schema
    return readers.read_csv(p.spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in flat.fields]))


FEATURES_ALL_SQL = "SELECT event_id, " + ", ".join(FEATURE_SQL) + " FROM feat"
add(
    "sink_engineered", lambda p: csv_back(p, p.engineered(), "engineered").select("event_id", *schemas.FEATURE_NAMES),
    FEATURES_ALL_SQL, "feat",
)
DET_COLS = (
    "event_id", "entity_id", "anomaly_score", "risk_score", "severity", "verdict", *schemas.DEVIATION_COLUMNS,
    "risk_deviation_component", "risk_indicator_component", "risk_confidence_component", "risk_trust_component",
    "risk_cold_start_component", "historical_confidence", "entity_trust", "is_attack",
)
DET_SQL = "SELECT " + ", ".join(DET_COLS) + ", us, p_type AS entity_type, p_version AS profile_version FROM det"


def detection_columns(df: DataFrame) -> DataFrame:
    return df.select(*DET_COLS, us(), "entity_type", "profile_version")


add("sink_detection", lambda p: detection_columns(csv_back(p, p.detection(), "detection")), DET_SQL, "det")
CLS_SQL = (
    "SELECT event_id, entity_id, us, chosen AS attack_type, display_name, conf AS confidence, typical AS severity, tactic AS mitre_tactic, "
    "technique AS mitre_technique, array_to_string(evidence, ' | ') AS evidence, severity AS detection_severity, verdict AS detection_verdict, "
    "anomaly_score AS detection_anomaly_score, risk_score AS detection_risk_score, coalesce(attack_type, '-') AS ground_truth_attack_type, "
    + ", ".join(f"score_{n}" for n in dims.KNOWN_ATTACKS) + " FROM cls"
)


def classification_columns(df: DataFrame) -> DataFrame:
    evidence = F.col("evidence")
    if isinstance(df.schema["evidence"].dataType, T.ArrayType):
        evidence = F.array_join("evidence", tx.LIST_JOINER)
    return df.select(
        "event_id", "entity_id", us(), "attack_type", "display_name", "confidence", "severity", "mitre_tactic", "mitre_technique",
        F.coalesce(evidence, F.lit("")).alias("evidence"), "detection_severity", "detection_verdict", "detection_anomaly_score",
        "detection_risk_score", F.coalesce("ground_truth_attack_type", F.lit("-")).alias("ground_truth_attack_type"),
        *[f"score_{n}" for n in dims.KNOWN_ATTACKS],
    )


add("sink_classification", lambda p: classification_columns(csv_back(p, p.classified(), "classified")), CLS_SQL, "cls")
_slots = ", ".join(
    f"max(dimension) FILTER (place = {i}) AS top{i}_dimension, max(pct) FILTER (place = {i}) AS top{i}_contribution_pct, "
    f"max(explanation) FILTER (place = {i}) AS top{i}_explanation" for i in range(1, 7))
EXPL_SQL = (
    "SELECT event_id, entity_id, risk_score, chosen AS attack_type, conf AS confidence, level AS confidence_level, severity, "
    + ", ".join(f"top{i}_{s}" for i in range(1, 7) for s in ("dimension", "contribution_pct", "explanation"))
    + ", behaviour_deviation, historical_comparison, feature_impact, attack_indicators, match_strength, margin, detection_strength, "
    + CONFIDENCE_TEXT + " AS confidence_narrative, actions_brief AS recommended_actions "
    f"FROM exp JOIN (SELECT event_id, {_slots} FROM con GROUP BY 1) USING (event_id) JOIN actl USING (event_id)"
)
add("sink_explanations", lambda p: csv_back(p, ex.explanation_rows(p.explained()), "explanations"), EXPL_SQL, "exp", "con", "actl")
SUMMARY_SQL = (
    "SELECT event_id, entity_id, p_type AS entity_type, us, risk_score, chosen AS attack_type, display_name, conf AS confidence, "
    "level AS confidence_level, severity, tactic AS mitre_tactic, technique AS mitre_technique, top_indicators, "
    "concat_ws(' ', behaviour_deviation, historical_comparison, feature_impact, attack_indicators) AS evidence_summary, "
    "actions_text AS recommended_actions, " + CONFIDENCE_TEXT + " AS confidence_explanation FROM exp JOIN actl USING (event_id)"
)


def summary_columns(df: DataFrame) -> DataFrame:
    return df.select(*[us() if c == "timestamp" else c for c in df.columns])


add(
    "sink_analyst_summary", lambda p: summary_columns(csv_back(p, ex.analyst_summary(p.explained()), "summary")),
    SUMMARY_SQL, "exp", "actl",
)


def ledger_runs(p: Pipeline) -> DataFrame:
    """Run records made from what the checks found and how many rows each stage holds; an older failed run comes first."""
    first = None
    for stage, table, found in (
        ("detection", p.detection(), qa.dq_score_ranges(p.detection())),
        ("classification", p.classified(), qa.dq_confidence_ranges(p.classified())),
        ("explanation", p.explained(), qa.dq_narrative_complete(p.explained())),
    ):
        row = table.agg(F.count("*").alias("rows")).select(
            F.lit(stage).alias("stage"), "rows", found.agg(F.count("*")).scalar().alias("errors"))
        first = row if first is None else first.unionByName(row)
    runs = F.array(
        F.struct(F.lit("run-1").alias("run_id"), F.lit(1).alias("finished_at"), F.lit(1).cast("long").alias("extra")),
        F.struct(F.lit("run-2").alias("run_id"), F.lit(2).alias("finished_at"), F.lit(0).cast("long").alias("extra")),
    )
    return first.withColumn("r", F.explode(runs)).select(
        "stage", "rows", "r.run_id", "r.finished_at", (F.col("errors") + F.col("r.extra")).alias("errors"))


LEDGER_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS stage, 'run-2' AS last_run_id, true AS last_run_passed, count(*) AS events_processed, 'operational' AS status FROM {t}"
    for s, t in (("detection", "det"), ("classification", "cls"), ("explanation", "exp")))
add("stage_ledger", lambda p: rp.stage_ledger(ledger_runs(p)), LEDGER_SQL, "det", "cls", "exp")


def _dashboard(p: Pipeline) -> DataFrame:
    documents = {
        "overview": rp.overview_metrics(p.detection()),
        "alerts": al.export_feed(p.alerts()),
        "analytics": rp.analytics_document(p.detection(), p.classified(), p.engineered()),
        "registry": dims.attack_registry(p.spark),
        "health": rp.stage_ledger(ledger_runs(p)),
    }
    base = p.once("dashboard", lambda path: [sinks.sink_json(df, f"{path}/{name}") for name, df in documents.items()])
    read = {name: p.spark.read.schema(df.schema).json(f"{base}/{name}") for name, df in documents.items()}
    return rp.export_row_counts(read)


add(
    "sink_dashboard", _dashboard,
    "SELECT 'overview' AS source, 1 AS rows UNION ALL SELECT 'alerts', count(*) FROM alr WHERE alert_place <= 45 UNION ALL SELECT 'analytics', 1 "
    "UNION ALL SELECT 'registry', count(*) FROM reg UNION ALL SELECT 'health', 3", "alr", "reg",
)
PROFILE_SUMMARY_COLUMNS = (
    "entity_id", "entity_type", "version", "sample_count", "avg_login_hour", "avg_session_duration", "failure_rate",
    "working_hour_ratio", "resource_sharing_score", "drift_score", "is_significant_drift", "history_length",
    "confidence_score", "warmup_strategy",
)


def _profile_summary(p: Pipeline) -> DataFrame:
    table = pr.profile_summary(p.latest().core)
    path = sinks.sink_csv(table, p.path("profile_summary"))
    back = readers.read_csv(p.spark, path, table.schema)
    return back.select(*PROFILE_SUMMARY_COLUMNS, F.coalesce("department", F.lit("-")).alias("department"))


add(
    "sink_profile_summary", _profile_summary,
    "SELECT " + ", ".join(PROFILE_SUMMARY_COLUMNS) + ", coalesce(department, '-') AS department FROM core2", "core2",
)
RANKED_SQL = (
    "SELECT position, risk_score, hit, sum(hit) OVER o AS tp, sum(1 - hit) OVER o AS fp, sum(hit) OVER () AS p, sum(1 - hit) OVER () AS n, "
    "count(*) OVER () AS total FROM (SELECT risk_score, is_attack::INT AS hit, "
    "row_number() OVER (ORDER BY risk_score DESC, entity_id, us, event_id) AS position FROM det) WINDOW o AS (ORDER BY position)"
)
ROC_SQL = (f"SELECT position, risk_score AS threshold, fp / n::DOUBLE AS x, tp / p::DOUBLE AS y FROM ({RANKED_SQL}) "
           f"UNION ALL SELECT 0, max(risk_score) + 1e0, 0e0, 0e0 FROM det")
PR_SQL = f"SELECT position - 1 AS position, risk_score AS threshold, tp / p::DOUBLE AS x, tp / (tp + fp)::DOUBLE AS y FROM ({RANKED_SQL})"


def sampled_sql(curve: str) -> str:
    keep = ("position IN (SELECT CAST(round_even(i * (SELECT max(position) FROM c) / 199e0, 0) AS BIGINT) FROM range(200) t(i))"
            " OR (SELECT max(position) FROM c) < 200")
    return (f"WITH c AS MATERIALIZED ({curve}) SELECT position, {R('threshold', 4)} AS threshold, {R('x', 6)} AS x, {R('y', 6)} AS y "
            f"FROM c WHERE {keep}")


def _curves(p: Pipeline) -> DataFrame:
    ranked = p.stage("ranked", lambda: ev.ranked_scores(p.detection()))
    roc, prc = ev.curve_downsample(ev.roc_curve(ranked)), ev.curve_downsample(ev.pr_curve(ranked))
    base = p.path("curves")
    back = {
        name: readers.read_csv(p.spark, sinks.sink_csv(df, f"{base}/{name}"), df.schema) for name, df in (("roc", roc), ("pr", prc))
    }
    return tagged(**back)


add(
    "sink_curves", _curves,
    f"SELECT 'roc' AS source, * FROM ({sampled_sql(ROC_SQL)}) UNION ALL SELECT 'pr', * FROM ({sampled_sql(PR_SQL)})", "det",
)


def period_sql(unit: str) -> str:
    start = f"date_trunc('{unit}', ts)"
    label = (f"year({start})::VARCHAR || '-W' || lpad(week({start})::VARCHAR, 2, '0')" if unit == "week"
             else f"year({start})::VARCHAR || '-' || lpad(month({start})::VARCHAR, 2, '0')")
    scaled = "sum(CAST(floor(behaviour_drift_score * 1e4 + 0.5e0) AS BIGINT))::DOUBLE / (count(*)::DOUBLE * 1e4)"
    return (f"SELECT {label} AS period_label, count(*) AS event_count, {R(scaled, 4)} AS avg_drift_score, "
            f"{R('quantile_cont(behaviour_drift_score, 0.9)', 4)} AS p90_drift_score FROM feat GROUP BY 1")


def _drift_periods(p: Pipeline) -> DataFrame:
    base = p.path("drift_periods")
    back = {}
    for name, unit in (("weekly", "week"), ("monthly", "month")):
        df = rp.period_drift(p.engineered(), unit)
        back[name] = readers.read_csv(p.spark, sinks.sink_csv(df, f"{base}/{name}"), df.schema)
    return tagged(**back)


add(
    "sink_drift_periods", _drift_periods,
    f"SELECT 'weekly' AS source, * FROM ({period_sql('week')}) UNION ALL SELECT 'monthly', * FROM ({period_sql('month')})", "feat",
)


def _runs(p: Pipeline) -> DataFrame:
    path = p.path("runs")
    for run in ("run-a", "run-b"):
        sinks.sink_run_partition(p.detection(), path, run)
    schema = T.StructType([*p.detection().schema.fields, T.StructField("run_id", T.StringType())])
    return p.spark.read.schema(schema).parquet(path).groupBy("run_id", "verdict").agg(F.count("*").alias("events"))


add(
    "sink_run_partition", _runs,
    "SELECT run_id, verdict, count(*) AS events FROM det CROSS JOIN (VALUES ('run-a'), ('run-b')) r(run_id) GROUP BY ALL", "det",
)

# ---- projections and filters ----

add(
    "project_feature_columns",
    lambda p: p.engineered().select(*schemas.CLASSIFY_FEATURE_COLUMNS),
    "SELECT " + ", ".join(schemas.CLASSIFY_FEATURE_COLUMNS) + " FROM feat", "feat",
)
add("filter_normal", lambda p: pr.filter_normal(p.engineered()).select("event_id", "entity_id"), "SELECT event_id, entity_id FROM nrm2", "nrm2")
add(
    "filter_flagged", lambda p: cl.filter_flagged(p.detection()).select("event_id", "verdict", "risk_score"),
    "SELECT event_id, verdict, risk_score FROM det WHERE verdict <> 'normal'", "det",
)
add(
    "filter_labeled",
    lambda p: p.classified().filter(F.col("ground_truth_attack_type").isNotNull()).select("event_id", "ground_truth_attack_type", "attack_type"),
    "SELECT event_id, attack_type AS ground_truth_attack_type, chosen AS attack_type FROM cls WHERE attack_type IS NOT NULL", "cls",
)


def merged(p: Pipeline) -> DataFrame:
    return rp.join_cold_start(p.detection(), p.engineered())


SEGMENT_SQL = {
    "New Users": "entity_type = 'user' AND new_entity_flag",
    "New Service Accounts": "entity_type = 'service_account' AND new_entity_flag",
    "New Devices (fingerprint novel)": "fingerprint_mismatch",
    "Established Baseline": "NOT new_entity_flag",
}
add(
    "filter_segment",
    lambda p: tagged(**{name: rp.filter_segment(merged(p), name).select("event_id") for name in rp.SEGMENTS}),
    " UNION ALL ".join(f"SELECT '{n}' AS source, event_id FROM det WHERE {c}" for n, c in SEGMENT_SQL.items()), "det",
)


def triaged(p: Pipeline) -> DataFrame:
    return al.join_triage_status(p.alerts(), p.triage())


ALERT_COLS = ("eventId", "entityId", "attackType", "severity", "riskScore", "confidence")
ALERT_SQL = ('SELECT event_id AS "eventId", entity_id AS "entityId", chosen AS "attackType", severity, risk_score AS "riskScore", '
             "conf AS confidence FROM alt")
add(
    "alert_search", lambda p: al.alert_search(p.alerts(), " T1110 ").select(*ALERT_COLS),
    ALERT_SQL + " WHERE lower(technique) LIKE '%t1110%' OR lower(entity_id) LIKE '%t1110%' OR lower(event_id) LIKE '%t1110%' "
    "OR lower(display_name) LIKE '%t1110%'", "alt",
)
add(
    "alert_filter",
    lambda p: al.alert_filter(triaged(p), severity="medium", attack_type="impossible_travel", status="open").select(*ALERT_COLS),
    ALERT_SQL + " WHERE severity = 'medium' AND chosen = 'impossible_travel' AND status = 'open'", "alt",
)

# ---- joins ----

add(
    "join_features_to_events",
    lambda p: fe.join_features_to_events(p.events().select("event_id", "login_result"), p.engineered()).select(
        "event_id", "login_result", "history_length", "geo_velocity_kmh", "resource_diversity"),
    "SELECT event_id, login_result, history_length, geo_velocity_kmh, resource_diversity FROM feat", "feat",
)
add(
    "join_ground_truth",
    lambda p: fe.join_ground_truth(
        p.events().select("entity_id", "event_id"), p.truth()).select("event_id", "is_attack"),
    "SELECT event_id, is_attack FROM lab", "lab",
)
add(
    "join_entity_static",
    lambda p: fe.join_entity_static(p.events(), p.entities(), p.skew, None).select(
        "event_id", F.coalesce("timezone", F.lit("UTC")).alias("zone"), F.coalesce("working_hours_start", F.lit(-1)).alias("start"),
        F.coalesce("department", F.lit("-")).alias("department"), F.coalesce("_known", F.lit(False)).alias("known")),
    "SELECT event_id, coalesce(e.timezone, 'UTC') AS zone, coalesce(e.wh_start, -1) AS start, coalesce(e.department, '-') AS department, "
    "e.entity_id IS NOT NULL AS known FROM lab LEFT JOIN ent e USING (entity_id)", "lab", "ent",
)
add(
    "join_detection_features",
    lambda p: cl.join_detection_features(p.detection(), p.engineered()).select(
        "event_id", "risk_score", "resource_accessed", "login_result", "session_entropy", "history_length",
        F.coalesce("previous_resource", F.lit("-")).alias("previous_resource")),
    "SELECT event_id, risk_score, resource_accessed, login_result, session_entropy, history_length, "
    "coalesce(previous_resource, '-') AS previous_resource FROM det", "det",
)
add(
    "join_explain_inputs",
    lambda p: ex.join_explain_inputs(p.classified(), p.detection(), p.engineered()).select(
        "event_id", "attack_type", "confidence", "deviation_device", "risk_indicator_component", "login_hour", "geo_location"),
    "SELECT event_id, chosen AS attack_type, conf AS confidence, deviation_device, risk_indicator_component, login_hour, geo_location FROM cls",
    "cls",
)
add(
    "join_alert_inputs",
    lambda p: al.join_alert_inputs(p.classified(), p.detection(), p.explained(), p.engineered()).select(
        "event_id", "attack_type", "deviation_session", "confidence_level", F.size("contributions").alias("contributions"),
        "auth_method", "session_duration", "evidence_summary"),
    "SELECT event_id, chosen AS attack_type, deviation_session, level AS confidence_level, 6 AS contributions, auth_method, session_duration, "
    "concat_ws(' ', behaviour_deviation, historical_comparison, feature_impact, attack_indicators) AS evidence_summary FROM exp", "exp",
)
add(
    "join_entity_meta",
    lambda p: al.join_entity_meta(p.classified(), p.entities()).select(
        "event_id", F.coalesce("department", F.lit("-")).alias("department"), F.coalesce("role", F.lit("-")).alias("role"),
        "home_location", "timezone"),
    "SELECT event_id, coalesce(e.department, '-') AS department, coalesce(e.role, '-') AS role, e.home_location, e.timezone "
    "FROM cls c LEFT JOIN ent e USING (entity_id)", "cls", "ent",
)


add(
    "join_profile",
    lambda p: de.join_profile(p.engineered(), p.latest(), p.skew, None).select(
        "event_id", de.has_profile().alias("has_profile"), F.coalesce("p_avg_login_hour", F.lit(-1.0)).alias("avg_login_hour"),
        *[F.coalesce(f"f_{k}", F.lit(0.0)).alias(f"share_{k}") for k in ("device", "resource", "location", "transition")]),
    "SELECT event_id, p_hour IS NOT NULL AS has_profile, coalesce(p_hour, -1e0) AS avg_login_hour, "
    + ", ".join(f"coalesce(f_{k}, 0e0) AS share_{k}" for k in ("device", "resource", "location", "transition")) + " FROM det", "det",
)
add(
    "join_cold_start",
    lambda p: merged(p).select("event_id", "entity_type_detection", "entity_type", "new_entity_flag", "fingerprint_mismatch", "history_length", "risk_score"),
    "SELECT event_id, p_type AS entity_type_detection, entity_type, new_entity_flag, fingerprint_mismatch, history_length, risk_score FROM det", "det",
)
add(
    "semi_flagged_events", lambda p: rp.semi_flagged_events(p.engineered(), p.detection()).select("event_id", "resource_accessed", "login_hour"),
    "SELECT event_id, resource_accessed, login_hour FROM feat WHERE event_id IN (SELECT event_id FROM det WHERE verdict <> 'normal')", "feat", "det",
)
add(
    "semi_entities",
    lambda p: rp.semi_entities(p.engineered(), p.entities().filter(F.col("department") == "Security")).select("event_id", "entity_id"),
    "SELECT event_id, entity_id FROM feat WHERE entity_id IN (SELECT entity_id FROM ent WHERE department = 'Security')", "feat", "ent",
)
add(
    "anti_orphan_entities",
    lambda p: tagged(
        whole=qa.anti_orphan_entities(p.engineered(), p.entities()),
        without_hr=qa.anti_orphan_entities(p.engineered(), p.entities().filter(F.coalesce("department", F.lit("-")) != "HR"))),
    "SELECT 'whole' AS source, entity_id FROM feat WHERE entity_id NOT IN (SELECT entity_id FROM ent) UNION "
    "SELECT 'without_hr', entity_id FROM feat WHERE entity_id NOT IN (SELECT entity_id FROM ent WHERE coalesce(department, '-') <> 'HR')", "feat", "ent",
)
BEHAVIOUR_SQL = f"""
SELECT e.entity_id, e.entity_type, coalesce(e.department, '-') AS department, coalesce(e.role, '-') AS role, e.privilege_level, e.is_remote,
  coalesce(n, 0) AS total_events, coalesce(nr, 0) AS unique_resources_used, coalesce(top_resource, '-') AS top_resource,
  coalesce(nd, 0) AS unique_devices_used, coalesce(top_hour, -1) AS most_common_hour, coalesce({R('we / n::DOUBLE', 6)}, -1e0) AS weekend_event_ratio,
  coalesce({R('fl / n::DOUBLE', 6)}, -1e0) AS login_failure_rate, coalesce({R('sx / n::DOUBLE', 6)}, -1e0) AS avg_session_duration_seconds,
  coalesce(lo, -1) AS first_us, coalesce(hi, -1) AS last_us,
  coalesce({R("n / (SELECT greatest(1, (max(us) - min(us)) // 86400000000)::DOUBLE FROM lab)", 6)}, -1e0) AS avg_events_per_day
FROM ent e LEFT JOIN (
  SELECT entity_id, count(*) AS n, count(DISTINCT resource_accessed) AS nr, count(DISTINCT device_fingerprint) AS nd,
    count(*) FILTER (isodow(ts) >= 6) AS we, count(*) FILTER (login_result = 'failure') AS fl, sum(session_duration)::BIGINT AS sx, min(us) AS lo, max(us) AS hi
  FROM lab GROUP BY 1) s USING (entity_id)
LEFT JOIN (SELECT entity_id, v AS top_resource FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, v) AS r FROM
  (SELECT entity_id, resource_accessed AS v, count(*) AS c FROM lab GROUP BY 1, 2)) WHERE r = 1) m USING (entity_id)
LEFT JOIN (SELECT entity_id, v AS top_hour FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, v) AS r FROM
  (SELECT entity_id, hour(ts) AS v, count(*) AS c FROM lab GROUP BY 1, 2)) WHERE r = 1) k USING (entity_id)
"""


def _behaviour(p: Pipeline) -> DataFrame:
    df = pr.behaviour_summary(p.entities(), p.events())
    return df.select(
        "entity_id", "entity_type", F.coalesce("department", F.lit("-")).alias("department"), F.coalesce("role", F.lit("-")).alias("role"),
        "privilege_level", "is_remote",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_events", "unique_resources_used", "unique_devices_used")],
        F.coalesce("top_resource", F.lit("-")).alias("top_resource"), F.coalesce("most_common_hour", F.lit(-1)).alias("most_common_hour"),
        *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in
          ("weekend_event_ratio", "login_failure_rate", "avg_session_duration_seconds", "avg_events_per_day")],
        F.coalesce(F.unix_micros("first_event_at"), F.lit(-1)).alias("first_us"), F.coalesce(F.unix_micros("last_event_at"), F.lit(-1)).alias("last_us"),
    )


add("join_behaviour_summary", _behaviour, BEHAVIOUR_SQL, "ent", "lab")
add(
    "behaviour_summary", lambda p: _behaviour(p).filter(F.col("total_events") > 0).drop("department", "role", "privilege_level", "is_remote"),
    f"SELECT * EXCLUDE (department, role, privilege_level, is_remote) FROM ({BEHAVIOUR_SQL}) WHERE total_events > 0", "ent", "lab",
)
add(
    "join_triage_status", lambda p: triaged(p).select("eventId", "status", "severity"),
    'SELECT event_id AS "eventId", status, severity FROM alt', "alt",
)
add(
    "join_attack_registry",
    lambda p: p.truth().select("event_id", "attack_type").join(
        F.broadcast(dims.attack_registry(p.spark)), "attack_type").select("event_id", "attack_type", "display_name", "mitre_tactic", "mitre_technique", "typical_severity"),
    "SELECT event_id, attack_type, display_name, tactic AS mitre_tactic, technique AS mitre_technique, typical AS typical_severity "
    "FROM lab JOIN reg ON type_name = attack_type", "lab", "reg",
)


def _history(p: Pipeline) -> DataFrame:
    wanted = p.alerts().select(F.col("entityId").alias("entity_id"), F.col("eventId").alias("event_id"))
    return al.alert_history_window(p.engineered(), wanted)


add(
    "alert_history_window",
    lambda p: _history(p).select("event_id", F.explode("history").alias("h")).select(
        "event_id", us("h.timestamp"), "h.*").withColumnsRenamed({n: c for n, c in al.HISTORY_FIELDS.items() if n != "timestamp"}).drop("timestamp"),
    "SELECT event_id, us, resource_accessed, device_fingerprint, geo_location, login_result, session_duration, auth_method FROM hist", "hist",
)


def _focus(p: Pipeline) -> DataFrame:
    """The alerts beside the riskiest alert of the entity with the most alerts."""
    ranked = p.alerts().groupBy("entityId").agg(F.count("*").alias("n"), F.min("eventId").alias("first"))
    focus = ranked.orderBy(F.desc("n"), "entityId").limit(1).first()["first"]
    return al.previous_alerts(p.alerts(), focus)


add(
    "previous_alerts", lambda p: _focus(p).select("entityId", "eventId", "riskScore"),
    'WITH f AS (SELECT entity_id, min(event_id) AS first FROM alr GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1) '
    'SELECT entity_id AS "entityId", event_id AS "eventId", risk_score AS "riskScore" FROM alr WHERE entity_id = (SELECT entity_id FROM f) '
    "AND event_id <> (SELECT first FROM f)", "alr",
)

# ---- set operations ----


def _union_injected(p: Pipeline) -> DataFrame:
    rows = p.labelled()
    return rp.union_injected(rows.filter(~F.col("injected")), rows.filter("injected"))


LABELLED_SQL = (
    "SELECT event_id, us, entity_id, label, is_attack AS injected, coalesce(attack_id, '-') AS attack_id, coalesce(attack_type, '-') AS attack_type, "
    "coalesce(severity, '-') AS severity, coalesce(mitre_tactic, '-') AS mitre_tactic, coalesce(confidence, -1e0) AS confidence, "
    "coalesce(description, '-') AS description FROM lab"
)


def labelled_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", us(), "entity_id", "label", "injected",
        *[F.coalesce(c, F.lit("-")).alias(c) for c in ("attack_id", "attack_type", "severity", "mitre_tactic", "description")],
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
    )


add("union_injected", lambda p: labelled_columns(_union_injected(p)), LABELLED_SQL, "lab")
add(
    "union_ground_truth",
    lambda p: truth_columns(rp.union_ground_truth(p.labelled().filter(~F.col("injected")), p.labelled().filter("injected"))),
    TRUTH_SQL, "lab",
)
add("sort_chronological", lambda p: rp.sort_chronological(_union_injected(p)).select("event_id", us()), "SELECT event_id, us FROM lab", "lab")
add("sort_causal", lambda p: fe.sort_causal(p.events()).select("entity_id", us(), "event_id"), "SELECT entity_id, us, event_id FROM lab", "lab")
add(
    "jaccard_resources",
    lambda p: pr.resource_sharing(p.latest().values, p.entities(), pr.department_index(p.latest().values, p.entities(), 10)),
    "SELECT entity_id, resource_sharing_score FROM shr2", "shr2",
)


add(
    "set_difference_resources", lambda p: pr.set_difference_resources(p.engineered(), F.lit(p.builds()[0])),
    f"SELECT entity_id, resource_accessed AS resource FROM feat WHERE ts >= {FIRST_BUILD_SQL} "
    f"EXCEPT SELECT entity_id, resource_accessed FROM feat WHERE ts < {FIRST_BUILD_SQL}", "feat",
)
add(
    "union_class_labels", lambda p: ev.union_class_labels(p.classified()),
    "SELECT attack_type AS class FROM cls WHERE attack_type IS NOT NULL UNION SELECT chosen FROM cls WHERE attack_type IS NOT NULL", "cls",
)

# ---- scalar functions, over the event table ----

add(
    "fn_clamp", lambda p: p.engineered().select("event_id", nu.clamp(F.col("session_duration_zscore"), -1.0, 1.0).alias("clamped")),
    "SELECT event_id, greatest(-1e0, least(1e0, session_duration_zscore)) AS clamped FROM feat", "feat",
)
add(
    "fn_norm_zscore",
    lambda p: p.engineered().select("event_id", nu.round_dp(nu.norm_zscore(
        F.col("session_duration").cast("double"), F.col("rolling_mean_session_duration"), F.col("rolling_std_session_duration")), 6).alias("z")),
    f"SELECT event_id, {R('CASE WHEN rolling_std_session_duration > 0 THEN greatest(0e0, least(1e0, abs(session_duration - rolling_mean_session_duration) / rolling_std_session_duration / 3e0)) ELSE 0e0 END', 6)} AS z FROM feat",
    "feat",
)
add(
    "fn_norm_circular",
    lambda p: p.engineered().select("event_id", nu.round_dp(nu.norm_circular(F.col("login_hour").cast("double"), F.lit(22.5), 24.0), 6).alias("d")),
    f"SELECT event_id, {R('least(1e0, least(abs(login_hour - 22.5e0), 24e0 - abs(login_hour - 22.5e0)) / 12e0)', 6)} AS d FROM feat", "feat",
)
add(
    "fn_norm_frequency", lambda p: p.engineered().select("event_id", nu.round_dp(nu.norm_frequency(F.col("device_familiarity_score")), 4).alias("d")),
    f"SELECT event_id, {R('1e0 - device_familiarity_score', 4)} AS d FROM feat", "feat",
)
add(
    "fn_risk_scale", lambda p: p.engineered().select("event_id", nu.risk_scale(F.col("session_duration_zscore") / 3.0).alias("risk")),
    f"SELECT event_id, {R('100e0 * greatest(0e0, least(1e0, session_duration_zscore / 3e0))', 2)} AS risk FROM feat", "feat",
)
add(
    "fn_haversine",
    lambda p: p.events().join(p.entities().select("entity_id", "home_location"), "entity_id").select("event_id", nu.round_dp(nu.haversine_km(
        dims.office_latitude(F.col("home_location")), dims.office_longitude(F.col("home_location")),
        dims.office_latitude(F.col("geo_location")), dims.office_longitude(F.col("geo_location"))), 3).alias("km")),
    f"SELECT event_id, {R(HAVERSINE, 3)} AS km FROM (SELECT event_id, geo_location, home_location AS prev_geo FROM lab JOIN ent USING (entity_id))",
    "lab", "ent",
)
add(
    "fn_entropy", lambda p: p.events().select("event_id", nu.round_dp(nu.entropy_bits(tx.split_list(F.col("command_sequence"))), 4).alias("bits")),
    f"SELECT event_id, CASE WHEN command_sequence = '' THEN 0e0 ELSE {R('list_entropy(string_split(command_sequence, chr(124)))', 4)} END AS bits FROM lab",
    "lab",
)


def _cosine(p: Pipeline) -> DataFrame:
    """Login methods in the two halves of the month; the maps have one key per method of a fixed list."""
    late = F.col("timestamp") >= F.lit(p.builds()[0])
    counts = p.events().groupBy("entity_id", "auth_method").agg(
        F.count_if(~late).cast("double").alias("a"), F.count_if(late).cast("double").alias("b"))
    maps = counts.groupBy("entity_id").agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col(c) > 0, F.struct("auth_method", c)))).alias(c) for c in ("a", "b")])
    return maps.select("entity_id", nu.cosine_distance(F.col("a"), F.col("b")).alias("distance"))


add(
    "fn_cosine_distance", _cosine,
    f"""SELECT entity_id, CASE WHEN aa = 0 AND bb = 0 THEN 0e0 WHEN aa = 0 OR bb = 0 THEN 1e0 ELSE {R('greatest(0e0, 1e0 - ab / (sqrt(aa) * sqrt(bb)))', 4)} END AS distance
FROM (SELECT entity_id, sum(a * b)::DOUBLE AS ab, sum(a * a)::DOUBLE AS aa, sum(b * b)::DOUBLE AS bb FROM (
  SELECT entity_id, auth_method, count(*) FILTER (ts < {FIRST_BUILD_SQL}) AS a, count(*) FILTER (ts >= {FIRST_BUILD_SQL}) AS b FROM lab GROUP BY ALL) GROUP BY 1)""",
    "lab",
)
add(
    "fn_split_list",
    lambda p: p.entities().select(
        "entity_id", F.size(tx.split_list(F.col("normal_resources"))).alias("resources"),
        F.aggregate(tx.split_ints(F.col("active_days")), F.lit(0), lambda a, v: a + v).alias("day_sum"),
        F.size(tx.split_list(F.lit(""))).alias("blank")),
    "SELECT entity_id, 3 AS resources, list_sum(list_transform(string_split(active_days, ','), lambda d: d::INT)) AS day_sum, 0 AS blank FROM ent", "ent",
)
add(
    "fn_blank_to_null", lambda p: p.events().select("event_id", tx.blank_to_null(F.col("command_sequence")).isNull().alias("blank")),
    "SELECT event_id, command_sequence = '' AS blank FROM lab", "lab",
)
add(
    "fn_parse_country", lambda p: p.events().select("event_id", tx.parse_country(F.col("geo_location")).alias("country")),
    "SELECT event_id, regexp_extract(geo_location, '.*, (.*)', 1) AS country FROM lab", "lab",
)
add("fn_risk_context", lambda p: p.events().select("event_id", "risk_context"), "SELECT event_id, risk_context FROM lab", "lab")


def _within(p: Pipeline) -> DataFrame:
    local = F.from_utc_timestamp("timestamp", F.col("timezone"))
    return p.events().join(p.entities().select("entity_id", "timezone", "active_days", "working_hours_start", "working_hours_end"), "entity_id").select(
        "event_id", tx.within_working_hours(
            F.weekday(local), F.hour(local), tx.split_ints(F.col("active_days")), F.col("working_hours_start"), F.col("working_hours_end")).alias("inside"))


add(
    "fn_within_working_hours", _within, "SELECT event_id, risk_context LIKE 'in_hours%' AS inside FROM lab", "lab",
)
add(
    "fn_parse_actions",
    lambda p: ex.analyst_summary(p.explained()).select("event_id", F.posexplode(tx.parse_actions(F.col("recommended_actions"))).alias("i", "a")).select(
        "event_id", (F.col("i") + 1).alias("place"), "a.priority", "a.action", "a.rationale"),
    "SELECT event_id, place, priority, action, rationale FROM act", "act",
)
add(
    "fn_round_dp", lambda p: p.events().select("event_id", nu.round_dp(F.col("session_duration") / 7.0, 2).alias("rounded")),
    "SELECT event_id, CAST(round(session_duration::DECIMAL(18,6) / 7, 2) AS DOUBLE) AS rounded FROM lab", "lab",
)
