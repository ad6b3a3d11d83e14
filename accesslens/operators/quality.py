"""Data-quality checks: each is a table of violations (check, severity, subject, message)."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens import schemas
from accesslens.functions.text import blank_to_null
from accesslens.operators.detect import ThresholdConfig, severity, verdict
from accesslens.operators.profiles import KEY, Profiles
from accesslens.session import written
from accesslens.sources import dims

VIOLATION_DDL = "check string, severity string, subject string, message string"
UNIT = (0.0, 1.0)
RISK = (0.0, 100.0)


def violations(df: DataFrame, check: str, rules: dict[str, Column], subject: Column | str, level: str = "error") -> DataFrame:
    """Rows for which a rule holds; a rule maps a message to its breach condition."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for message, bad in rules.items()])
    who = F.col(subject) if isinstance(subject, str) else subject
    return df.select(
        F.lit(check).alias("check"), F.lit(level).alias("severity"), who.cast("string").alias("subject"),
        F.explode(F.filter(found, lambda m: m.isNotNull())).alias("message"),
    )


def together(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def dq_report(found: DataFrame) -> DataFrame:
    """Error and warning counts; a run passes without errors."""
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return found.agg((errors == 0).alias("passed"), errors.alias("errors"), warnings.alias("warnings"))


def outside(column: Column | str, bounds: tuple[float, float]) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return ~value.between(*bounds)


def _ranges(columns: tuple[str, ...], bounds: tuple[float, float]) -> dict[str, Column]:
    return {f"{c} outside [{bounds[0]:g}, {bounds[1]:g}]": outside(c, bounds) for c in columns}


def _problem(df: DataFrame, check: str, messages: list[str], level: str = "error") -> DataFrame:
    """Violations known from the schema alone."""
    rows = [(check, level, "schema", m) for m in messages]
    return df.sparkSession.createDataFrame(rows, VIOLATION_DDL)


# ---- features ----


def dq_schema_complete(engineered: DataFrame) -> DataFrame:
    """Every registered feature is a column, and holds a value somewhere if there are rows."""
    present = [n for n in schemas.FEATURE_NAMES if n in engineered.columns]
    counts = engineered.agg(F.count("*").alias("_rows"), *[F.count(n).alias(n) for n in present])
    missing = [F.lit(f"missing feature {n}") for n in schemas.FEATURE_NAMES if n not in present]
    blank = [F.when((F.col("_rows") > 0) & (F.col(n) == 0), F.lit(f"feature {n} has no value")) for n in present]
    messages = F.explode(F.array_compact(F.array(*missing, *blank)))
    return counts.select(messages.alias("_m")).select(
        *[c.alias(name) for name, c in zip(T.StructType.fromDDL(VIOLATION_DDL).names, (F.lit("schema_completeness"), F.lit("error"), F.lit("schema"), F.col("_m")))]
    )


def dq_row_count(engineered: DataFrame, events: DataFrame) -> DataFrame:
    """One output row per input row."""
    sizes = engineered.agg(F.count("*").alias("rows")).select(
        "rows", events.agg(F.count("*")).scalar().alias("expected")
    )
    return violations(sizes, "row_count", {"row count differs from the input": F.col("rows") != F.col("expected")}, "rows")


def dq_no_nulls(engineered: DataFrame) -> DataFrame:
    return violations(
        engineered, "no_unexpected_nulls", {f"{n} is null": F.col(n).isNull() for n in schemas.FEATURE_NAMES}, "event_id"
    )


def dq_feature_ranges(engineered: DataFrame) -> DataFrame:
    booleans = {
        f"{c} is not boolean": F.lit(not isinstance(engineered.schema[c].dataType, T.BooleanType))
        for c in schemas.BOOLEAN_FEATURES
    }
    rules = (
        _ranges(("login_hour",), (0, 23)) | _ranges(("day_of_week",), (0, 6))
        | _ranges(("historical_percentile_session_duration",), RISK) | _ranges(schemas.RATIO_FEATURES, UNIT) | booleans
    )
    return violations(engineered, "value_ranges", rules, "event_id")


FINGERPRINT_BUCKETS = 4096


def fingerprint(df: DataFrame, buckets: int = FINGERPRINT_BUCKETS) -> DataFrame:
    """Rows and two sums of 64-bit row hashes per bucket of rows: equal for equal multisets, whatever their order and layout.

    Each task sums up its own rows, so at most ``buckets`` rows of it move.
    """
    # Each value goes in with its null flag: a hash skips nulls.
    every = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashes = df.select(F.xxhash64(*every).alias("a"), F.xxhash64(F.lit(7), *every).alias("b"))
    wide = "decimal(38,0)"
    return hashes.groupBy(F.pmod("a", F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(F.col("a").cast(wide)).alias("sum_a"), F.sum(F.col("b").cast(wide)).alias("sum_b"))


def dq_determinism(first: DataFrame, second: DataFrame, key: str = "event_id", buckets: int = FINGERPRINT_BUCKETS) -> DataFrame:
    """Rows present in only one of two runs.

    Buckets of rows are compared by fingerprint; only rows of buckets that differ are moved and compared themselves.
    """
    second = second.select(*first.columns)
    one, other = fingerprint(first, buckets), fingerprint(second, buckets)
    same = one.join(other, ["bucket", "n", "sum_a", "sum_b"], "left_anti").unionByName(other.join(one, ["bucket", "n", "sum_a", "sum_b"], "left_anti"))
    suspects = written(same.select("bucket").distinct(), "buckets")
    every = [x for c in first.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    bucket = F.pmod(F.xxhash64(*every), F.lit(buckets)).cast("int").alias("_bucket")

    def within(df: DataFrame) -> DataFrame:  # at most ``buckets`` rows are sent to the tasks
        return df.select("*", bucket).join(F.broadcast(suspects.withColumnRenamed("bucket", "_bucket")), "_bucket", "left_semi").drop("_bucket")

    if suspects.isEmpty():
        differing = first.limit(0)
    else:
        differing = within(first).exceptAll(within(second)).unionByName(within(second).exceptAll(within(first)))
    return violations(differing, "determinism", {"result differs between runs": F.lit(True)}, key)


# ---- profiles ----


def dq_distribution_sums(profiles: Profiles, tolerance: float = 0.01) -> DataFrame:
    """Shares per (entity, kind) and probabilities per (entity, kind, state) add up to 1."""
    values = profiles.values.groupBy(KEY, "kind").agg(F.sum("share").alias("total"))
    steps = profiles.transitions.groupBy(KEY, "kind", "from_state").agg(F.sum("probability").alias("total"))
    rule = {"distribution does not add up to 1": F.abs(F.col("total") - 1.0) > tolerance}
    return together(
        violations(values, "probability_distributions", rule, F.concat_ws("/", KEY, "kind")),
        violations(steps, "probability_distributions", rule, F.concat_ws("/", KEY, "kind", "from_state")),
    )


def dq_profile_ranges(core: DataFrame) -> DataFrame:
    columns = ("failure_rate", "working_hour_ratio", "resource_sharing_score", "drift_score", "confidence_score")
    return violations(core, "value_ranges", _ranges(columns, UNIT) | {"version below 1": F.col("version") < 1}, KEY)


def dq_version_monotonic(core: DataFrame) -> DataFrame:
    """Versions of an entity are distinct and updated in order; numbers may be left out."""
    ordered = Window.partitionBy(KEY).orderBy("version", "updated_at")
    before = core.select(KEY, "version", "updated_at", F.lag("updated_at").over(ordered).alias("before"))
    repeated = core.groupBy(KEY, "version").agg(F.count("*").alias("n"))
    return together(
        violations(
            before, "version_monotonicity", {"older than the version before": F.col("updated_at") < F.col("before")},
            F.concat_ws("/", KEY, "version"),
        ),
        violations(repeated, "version_monotonicity", {"version stored twice": F.col("n") > 1}, F.concat_ws("/", KEY, "version")),
    )


def anti_orphan_entities(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity ids that occur in ``rows`` but not in the entity table."""
    return rows.select(KEY).distinct().join(entities.select(KEY), KEY, "left_anti")


def dq_entity_consistency(rows: DataFrame, entities: DataFrame) -> DataFrame:
    orphans = violations(anti_orphan_entities(rows, entities), "entity_consistency", {"unknown entity": F.lit(True)}, KEY)
    pairs = rows.groupBy(KEY, "entity_type").agg(F.count("*").alias("n"))
    known = entities.select(KEY, F.col("entity_type").alias("actual"))
    wrong = violations(
        pairs.join(known, KEY), "entity_consistency",
        {"entity_type differs from the entity table": ~F.col("entity_type").eqNullSafe(F.col("actual"))}, KEY,
    )
    return together(orphans, wrong)


# ---- detection ----


def dq_score_ranges(detection: DataFrame) -> DataFrame:
    rules = _ranges(("anomaly_score",) + schemas.DEVIATION_COLUMNS, UNIT) | _ranges(("risk_score",), RISK)
    return violations(detection, "score_ranges", rules, "event_id")


def dq_dimension_complete(detection: DataFrame) -> DataFrame:
    missing = [c for c in schemas.DEVIATION_COLUMNS if c not in detection.columns]
    present = [c for c in schemas.DEVIATION_COLUMNS if c in detection.columns]
    return together(
        _problem(detection, "dimension_completeness", [f"missing {c}" for c in missing]),
        violations(detection, "dimension_completeness", {f"{c} is null": F.col(c).isNull() for c in present}, "event_id"),
    )


def dq_verdict_consistency(detection: DataFrame, thresholds: ThresholdConfig | None = None) -> DataFrame:
    level = severity(F.col("risk_score"), thresholds)
    rules = {
        "severity does not follow from risk": F.col("severity") != level,
        "verdict does not follow from risk": F.col("verdict") != verdict(level),
    }
    return violations(detection, "verdict_consistency", rules, "event_id")


# ---- classification ----


def dq_confidence_ranges(classified: DataFrame) -> DataFrame:
    scores = tuple(f"score_{n}" for n in dims.KNOWN_ATTACKS)
    return violations(classified, "confidence_ranges", _ranges(("confidence",) + scores, UNIT), "event_id")


def dq_attack_registered(classified: DataFrame) -> DataFrame:
    names = F.broadcast(dims.attack_registry(classified.sparkSession).select("attack_type"))
    unknown = classified.join(names, "attack_type", "left_anti")
    return violations(unknown, "attack_type_registered", {"attack type is not registered": F.lit(True)}, "event_id")


def dq_mitre_complete(classified: DataFrame) -> DataFrame:
    registry = dims.attack_registry(classified.sparkSession).select(
        "attack_type", F.col("mitre_tactic").alias("_tactic"), F.col("mitre_technique").alias("_technique")
    )
    tactic, technique = blank_to_null(F.col("mitre_tactic")), blank_to_null(F.col("mitre_technique"))
    missing = tactic.isNull() | technique.isNull()
    rules = {
        "tactic or technique is missing": missing,
        "mapping differs from the registry": ~missing & ((tactic != F.col("_tactic")) | (technique != F.col("_technique"))),
    }
    return violations(classified.join(F.broadcast(registry), "attack_type", "left"), "mitre_completeness", rules, "event_id")


def dq_evidence_present(classified: DataFrame) -> DataFrame:
    bare = (F.col("attack_type") != "unknown") & (F.size("evidence") == 0)
    return violations(classified, "evidence_presence", {"named type without evidence": bare}, "event_id")


# ---- explanations ----


def dq_contribution_sum(explained: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Shares add up to 100 within the tolerance; counted in hundredths, so the check is exact."""
    cents = F.transform("contributions", lambda c: F.floor(c["contribution_percentage"] * 100 + 0.5).cast("long"))
    total = F.aggregate(cents, F.lit(0).cast("long"), lambda a, v: a + v)
    rules = {
        "shares do not add up to 100": F.abs(total - 10_000) > int(tolerance * 100),
        "share outside [0, 100]": F.exists(cents, lambda v: (v < 0) | (v > 10_000)),
    }
    return violations(explained, "contribution_percentages", rules, "event_id")


def dq_confidence_consistent(explained: DataFrame, classified: DataFrame) -> DataFrame:
    source = classified.select(KEY, "event_id", F.col("confidence").alias("_source"))
    rules = _ranges(("confidence",), UNIT) | {"confidence differs from classification": F.col("confidence") != F.col("_source")}
    return violations(explained.join(source, [KEY, "event_id"]), "confidence_level_consistency", rules, "event_id")


def dq_recommendations_present(explained: DataFrame) -> DataFrame:
    return violations(
        explained, "recommendations_present", {"no recommended action": F.coalesce(F.size("actions"), F.lit(0)) < 1}, "event_id"
    )


NARRATIVE = ("behaviour_deviation", "historical_comparison", "feature_impact", "attack_indicators")


def dq_narrative_complete(explained: DataFrame) -> DataFrame:
    rules = {f"{c} is blank": F.coalesce(F.trim(c), F.lit("")) == "" for c in NARRATIVE}
    return violations(explained, "narrative_completeness", rules, "event_id")


# ---- labelled events ----


def dq_attack_percentage(labelled: DataFrame, limit: float = 0.15) -> DataFrame:
    sizes = labelled.agg(F.count("*").alias("rows"), F.count_if(F.col("injected")).alias("attacks"))
    empty = violations(sizes, "attack_percentage", {"no events": F.col("rows") == 0}, "rows")
    share = F.col("attacks") / F.when(F.col("rows") > 0, F.col("rows"))
    return together(
        empty, violations(sizes, "attack_percentage", {"share of injected events above the limit": share > limit}, "rows", "warning")
    )


def dq_dataset_integrity(labelled: DataFrame) -> DataFrame:
    missing = [c for c in schemas.LABELLED_EVENT_COLUMNS if c not in labelled.columns]
    if missing:
        return _problem(labelled, "dataset_integrity", [f"missing column {c}" for c in missing])
    nulls = violations(
        labelled, "dataset_integrity", {"null event_id": F.col("event_id").isNull(), "null entity_id": F.col(KEY).isNull()}, "event_id"
    )
    repeated = labelled.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.count("*").alias("n"))
    return together(nulls, violations(repeated, "dataset_integrity", {"duplicate event_id": F.col("n") > 1}, "event_id"))


def dq_chronology(events: DataFrame, start: date, end: date) -> DataFrame:
    """Timestamps from the start day to the end of the end day, UTC."""
    low, high = F.lit(str(start)).cast("timestamp"), F.lit(str(end + timedelta(days=1))).cast("timestamp")
    rule = {"timestamp outside the dataset's days": (F.col("timestamp") < low) | (F.col("timestamp") >= high)}
    return violations(events, "chronological_consistency", rule, "event_id")


# ---- evaluation and export ----


def dq_metrics(
    detection_row: DataFrame, class_rows: DataFrame, matrix: DataFrame, segments: DataFrame, warmup: DataFrame,
    calibration: DataFrame, weekly: DataFrame, monthly: DataFrame, updates: DataFrame, labelled: int | Column,
    classified: int | Column,
) -> DataFrame:
    """Metrics in [0, 1], matrix totals, bins and periods."""
    rates = ("precision", "recall", "f1", "roc_auc", "pr_auc", "false_positive_rate", "false_negative_rate", "top_percentile_precision")
    cells = F.col("true_positive") + F.col("false_positive") + F.col("true_negative") + F.col("false_negative")
    detection_row = detection_row.withColumn("_labelled", labelled if isinstance(labelled, Column) else F.lit(labelled))
    total = matrix.agg(F.sum("events").alias("events")).withColumn("_classified", classified if isinstance(classified, Column) else F.lit(classified))
    periods = lambda df, name: violations(
        df.agg(F.count("*").alias("n")), f"concept_drift_{name}_present", {f"no {name} periods": F.col("n") == 0}, "n"
    )
    return together(
        violations(detection_row, "detection_metric_range", _ranges(rates, UNIT), F.lit("detection")),
        violations(detection_row, "detection_confusion_total", {"counts differ from labelled rows": cells != F.col("_labelled")}, F.lit("detection")),
        violations(class_rows, "classification_per_class_range", _ranges(("precision", "recall", "f1"), UNIT), "class"),
        violations(class_rows, "classification_metric_range", _ranges(("macro_f1", "weighted_f1", "accuracy"), UNIT), "class"),
        violations(total, "classification_confusion_total", {"matrix differs from labelled rows": F.coalesce("events", F.lit(0)) != F.col("_classified")}, F.lit("matrix")),
        violations(segments, "cold_start_flagged_rate", _ranges(("flagged_rate",), UNIT), "segment_name"),
        violations(segments, "cold_start_false_positive_rate", _ranges(("false_positive_rate",), UNIT), "segment_name"),
        violations(warmup, "cold_start_warmup_confidence", _ranges(("avg_historical_confidence",), UNIT), "history_length_range"),
        violations(calibration, "cold_start_calibration_accuracy", _ranges(("empirical_accuracy",), UNIT), "confidence_range"),
        periods(weekly, "weekly"),
        periods(monthly, "monthly"),
        violations(weekly, "concept_drift_score_range", _ranges(("avg_drift_score",), UNIT), "period_label"),
        violations(monthly, "concept_drift_score_range", _ranges(("avg_drift_score",), UNIT), "period_label"),
        violations(
            updates, "concept_drift_profile_updates",
            {"more updated entities than entities": F.col("entities_with_multiple_versions") > F.col("total_entities")}, F.lit("updates"),
        ),
    )


def dq_export(overview: DataFrame, alerts: DataFrame, hourly: DataFrame, registry: DataFrame, ledger: DataFrame) -> DataFrame:
    """Overview bounds, alert domains, 24 hours, registry size, stage ledger."""
    size = lambda df, check, rule: violations(df.agg(F.count("*").alias("n")), check, rule, "n")
    return together(
        violations(
            overview, "overview_bounds",
            {
                "no events": F.col("total_events") <= 0,
                "more anomalies than events": F.col("anomalies") > F.col("total_events"),
                "more critical alerts than anomalies": F.col("critical_alerts") > F.col("anomalies"),
            }
            | _ranges(("detection_accuracy", "false_positive_rate"), RISK),
            F.lit("overview"),
        ),
        size(alerts, "alerts_present", {"no alerts": F.col("n") == 0}),
        violations(
            alerts, "alert_domains",
            _ranges(("riskScore",), RISK) | _ranges(("confidence",), UNIT)
            | {
                "unknown severity": ~F.col("severity").isin(*schemas.SEVERITIES),
                "unknown verdict": ~F.col("verdict").isin(*schemas.VERDICTS),
            },
            "eventId",
        ),
        violations(
            alerts, "alert_details",
            {
                "unusual confidence level": ~F.col("confidenceLevel").isin(*schemas.CONFIDENCE_LEVELS),
                "no contributions": F.coalesce(F.size("featureContributions"), F.lit(0)) == 0,
            },
            "eventId", "warning",
        ),
        size(hourly, "analytics_hourly_completeness", {"not 24 hours": F.col("n") != 24}),
        violations(hourly, "analytics_hourly_bound", {"more anomalies than events": F.col("anomalous_events") > F.col("total_events")}, "login_hour"),
        size(registry, "mitre_registry_completeness", {"registry size differs": F.col("n") != len(dims.ATTACKS)}),
        violations(registry, "mitre_attack_type_known", {"unknown attack type": ~F.col("attack_type").isin(*dims.ATTACKS)}, "attack_type"),
        violations(
            ledger, "system_health",
            {
                "stage processed no rows": F.col("events_processed") <= 0,
                "stage without a run id": F.coalesce("last_run_id", F.lit("")) == "",
            },
            "stage",
        ),
    )
