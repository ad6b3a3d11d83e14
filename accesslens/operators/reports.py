"""Report aggregates. Shares are taken over aggregated rows; every average is formed from exact sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.functions.numeric import exact_avg, ratio, round_dp, sample_variance_numerator, scaled
from accesslens.operators.classify import filter_flagged
from accesslens.operators.profiles import KEY, Profiles
from accesslens.operators.scan import quantiles, running_totals
from accesslens.sources import dims

# Percentiles and bins of the reports.
PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
CONFIDENCE_BINS = ((0.0, 0.2, "0.0-0.2"), (0.2, 0.4, "0.2-0.4"), (0.4, 0.6, "0.4-0.6"), (0.6, 0.8, "0.6-0.8"), (0.8, 1.01, "0.8-1.0"))
HISTORY_BINS = ((0, 5, "0-5"), (5, 10, "5-10"), (10, 20, "10-20"), (20, 50, "20-50"), (50, 100, "50-100"), (100, None, "100+"))
TOP_N = 10
TOP_SUMMARIES = 25
MIN_STABILITY_EVENTS = 5


def share_of_total(n: str, dp: int = 2, scale: float = 100.0) -> Column:
    """A count as a share of the sum over all (few, aggregated) rows."""
    total = F.sum(n).over(Window.partitionBy())
    return F.coalesce(ratio(F.col(n) * F.lit(scale), total, dp), F.lit(0.0))


def counts_by(df: DataFrame, column: str, name: str = "events") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def over_domain(df: DataFrame, column: str, values: tuple, name: str = "events") -> DataFrame:
    """Counts for every value of a fixed domain, zeros kept, with their share."""
    full = dims.domain(df.sparkSession, column, values).join(counts_by(df, column, name), column, "left")
    return full.select(column, F.coalesce(name, F.lit(0)).alias(name)).withColumn("percentage", share_of_total(name))


def moments(value: str, dp_in: int, dp_out: int) -> list[Column]:
    """mean, sample deviation, min and max of a column with ``dp_in`` decimals, from exact sums."""
    units = scaled(F.col(value), dp_in).cast("decimal(19,0)")
    n, total = F.count(value).cast("double"), F.sum(units).cast("double")
    unit = F.lit(float(10**dp_in))
    # The difference of the two large sums is taken before anything is rounded.
    spread = sample_variance_numerator(F.count(value), F.sum(units), F.sum((units * units).cast("decimal(38,0)"))).cast("double")
    variance = F.greatest(spread, F.lit(0.0)) / F.when(n > 1, n * (n - 1))
    return [
        round_dp(total / (n * unit), dp_out).alias("mean"),
        round_dp(F.sqrt(variance) / unit, dp_out).alias("std"),
        round_dp(F.min(value), dp_out).alias("min"),
        round_dp(F.max(value), dp_out).alias("max"),
    ]


def distribution_stats(df: DataFrame, value: str, dp_in: int, dp_out: int) -> DataFrame:
    """Moments and percentiles of a score that has few decimals, so few distinct values."""
    points = F.percentile(value, F.array(*map(F.lit, PERCENTILES.values())))
    row = df.agg(F.count(value).alias("events"), *moments(value, dp_in, dp_out), points.alias("_p"))
    return row.select(
        "events", "mean", "std", "min", "max",
        *[round_dp(F.element_at("_p", i + 1), dp_out).alias(name) for i, name in enumerate(PERCENTILES)],
    )


def risk_distribution_stats(detection: DataFrame) -> DataFrame:
    return distribution_stats(detection, "risk_score", 2, 2)


def confidence_distribution(classified: DataFrame) -> DataFrame:
    return distribution_stats(classified, "confidence", 4, 4)


def injection_stats(labelled: DataFrame) -> DataFrame:
    """Per attack type: incidents, events, targeted entities, mean confidence and events per severity."""
    attacks = labelled.filter(F.col("attack_type").isNotNull())
    severities = schemas.SEVERITIES[1:]
    cells = attacks.groupBy("attack_type", "attack_id", KEY, "severity").agg(
        F.count("*").alias("n"), F.sum(scaled(F.col("confidence"), 4)).alias("c")
    )
    return cells.groupBy("attack_type").agg(
        F.countDistinct("attack_id").alias("incident_count"),
        F.sum("n").alias("event_count"),
        F.countDistinct(KEY).alias("targeted_entities"),
        round_dp(F.sum("c") / (F.sum("n") * F.lit(10_000.0)), 3).alias("mean_confidence"),
        *[
            F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(f"severity_{s}_count")
            for s in severities
        ],
    )


def label_counts(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Counts by entity type, department, label and login result as (column, value, count)."""

    def counted(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("counted"), F.col(c).alias("value")) for c in columns])
        flat = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
        return flat.groupBy("counted", "value").agg(F.count("*").alias("rows"))

    return counted(entities, ("entity_type", "department")).unionByName(counted(events, ("label", "login_result")))


def feature_summary(engineered: DataFrame) -> DataFrame:
    """One row per feature: moments, or true count and share for flags, and nulls. One pass over the table."""
    aggregates, rows = [F.count("*").alias("n")], []
    for name, _, kind in schemas.FEATURES:
        aggregates.append(F.count_if(F.col(name).isNull()).alias(f"{name}__nulls"))
        if kind == "bool":
            aggregates.append(F.count_if(name).alias(f"{name}__true"))
            stats = [F.lit(None).cast("double")] * 4 + [F.col(f"{name}__true")]
        else:
            parts = moments(name, schemas.FEATURE_DECIMALS.get(name, 0), 3)
            labels = [f"{name}__{s}" for s in ("mean", "std", "min", "max")]
            aggregates += [part.alias(label) for part, label in zip(parts, labels)]
            stats = [F.col(label) for label in labels] + [F.lit(None).cast("long")]
        rows.append(
            F.struct(
                F.lit(name).alias("feature"), F.lit(kind).alias("type"),
                *[s.alias(a) for s, a in zip(stats, ("mean", "std", "min", "max", "true_count"))],
                F.col(f"{name}__nulls").alias("nulls"),
            )
        )
    table = engineered.agg(*aggregates).select("n", F.explode(F.array(*rows)).alias("r")).select("n", "r.*")
    return table.select(
        "feature", "type", "mean", "std", "min", "max", "true_count",
        ratio(F.col("true_count") * F.lit(100.0), F.col("n"), 2).alias("true_percentage"), "nulls",
    )


def verdict_by_entity_type(detection: DataFrame) -> DataFrame:
    kinds = detection.withColumn("entity_type", F.coalesce("entity_type", F.lit("unknown")))
    return kinds.groupBy("entity_type").pivot("verdict", list(schemas.VERDICTS)).count().fillna(0)


def confusion(detection: DataFrame) -> DataFrame:
    """TP, FP, TN, FN of 'flagged' against the label, over labelled rows."""
    labelled = detection.filter(F.col("is_attack").isNotNull())
    flagged, attack = F.col("verdict") != "normal", F.col("is_attack")
    return labelled.agg(
        F.count_if(attack & flagged).alias("true_positive"),
        F.count_if(~attack & flagged).alias("false_positive"),
        F.count_if(~attack & ~flagged).alias("true_negative"),
        F.count_if(attack & ~flagged).alias("false_negative"),
    )


def detection_confusion(detection: DataFrame) -> DataFrame:
    """The four counts with unrounded-input F1, all to 4 decimals."""
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))
    return confusion(detection).select(
        "*",
        ratio(tp, tp + fp, 4).alias("precision"),
        ratio(tp, tp + fn, 4).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn, 4).alias("f1"),
        ratio(tp + tn, tp + fp + tn + fn, 4).alias("accuracy"),
    )


def attack_summary(classified: DataFrame) -> DataFrame:
    per_type = classified.groupBy("attack_type", "display_name", "mitre_tactic", "mitre_technique", "severity").agg(
        F.count("*").alias("events"), exact_avg(F.col("confidence"), 4, 4).alias("avg_confidence")
    )
    return per_type.withColumn("percentage", share_of_total("events"))


def truth_agreement(classified: DataFrame) -> DataFrame:
    """Agreement with the labelled type, per type and overall ('all')."""
    labelled = classified.filter(F.col("ground_truth_attack_type").isNotNull())
    per_type = labelled.groupBy("ground_truth_attack_type").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("attack_type") == F.col("ground_truth_attack_type")).alias("agreed"),
    )
    overall = per_type.agg(F.sum("events").alias("events"), F.sum("agreed").alias("agreed")).select(
        F.lit("all").alias("ground_truth_attack_type"), F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("agreed", F.lit(0)).alias("agreed"),
    )
    return per_type.unionByName(overall).withColumn("agreement_rate", ratio(F.col("agreed"), F.col("events"), 4))


def binned(value: Column, bins: tuple) -> Column:
    """Label of the half-open bin [low, high) that holds the value."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(bins):
        inside = value >= low if high is None else (value >= low) & (value < high)
        label = F.when(inside, name).otherwise(label)
    return label


def confidence_histogram(classified: DataFrame) -> DataFrame:
    placed = classified.select(binned(F.col("confidence"), CONFIDENCE_BINS).alias("bin"))
    return over_domain(placed, "bin", tuple(name for _, _, name in CONFIDENCE_BINS)).select("bin", "events")


def confidence_by_type(classified: DataFrame) -> DataFrame:
    return classified.groupBy("attack_type").agg(
        F.count("*").alias("events"), exact_avg(F.col("confidence"), 4, 4).alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
    )


def drift_report(core: DataFrame) -> DataFrame:
    return core.agg(
        F.count("*").alias("profiles"), F.count_if("is_significant_drift").alias("significant"),
        exact_avg(F.col("drift_score"), 4, 4).alias("mean_drift"), F.max("drift_score").alias("max_drift"),
    )


def significant_drift(core: DataFrame) -> DataFrame:
    return core.filter("is_significant_drift").select(
        KEY, "version", "drift_score", "drifted_dimensions", "historical_sample_count", "current_sample_count"
    ).orderBy(F.desc("drift_score"), KEY)


def warmup_distribution(core: DataFrame) -> DataFrame:
    return over_domain(core, "warmup_strategy", schemas.WARMUP_STATES, "entities")


def insufficient_data(core: DataFrame) -> DataFrame:
    return core.filter(F.col("warmup_strategy") == "insufficient_data").select(KEY, "history_length", "confidence_score").orderBy(KEY)


def attribution_summary(explained: DataFrame) -> DataFrame:
    """Per dimension: share statistics and how often it ranks first."""
    flat = explained.select(F.posexplode("contributions").alias("place", "c")).select("place", "c.*")
    per = flat.groupBy("dimension").agg(
        F.count("*").alias("events"),
        exact_avg(F.col("contribution_percentage"), 2, 2).alias("avg_share"),
        F.min("contribution_percentage").alias("min_share"), F.max("contribution_percentage").alias("max_share"),
        F.count_if(F.col("place") == 0).alias("times_first"),
    )
    return per.withColumn("first_percentage", ratio(F.col("times_first") * F.lit(100.0), F.col("events"), 2)).drop("events")


def recommendation_counts(explained: DataFrame) -> DataFrame:
    """Counts by priority, by action and by (attack type, action), told apart by ``counted``."""
    cells = (
        explained.select("attack_type", F.explode("actions").alias("a"))
        .groupBy("attack_type", F.col("a.priority").alias("priority"), F.col("a.action").alias("action"))
        .agg(F.count("*").alias("n"))
    )

    def level(name: str, type_: Column, value: str) -> DataFrame:
        return cells.groupBy(type_.alias("attack_type"), F.col(value).alias("value")).agg(F.sum("n").alias("n")).select(
            F.lit(name).alias("counted"), "attack_type", "value", "n"
        )

    return (
        level("priority", F.lit(""), "priority")
        .unionByName(level("action", F.lit(""), "action"))
        .unionByName(level("action_by_type", F.col("attack_type"), "action"))
    )


def summary_breakdowns(explained: DataFrame) -> DataFrame:
    columns = ("severity", "attack_type", "confidence_level")
    pairs = F.array(*[F.struct(F.lit(c).alias("counted"), F.col(c).alias("value")) for c in columns])
    return explained.select(F.explode(pairs).alias("p")).select("p.*").groupBy("counted", "value").agg(
        F.count("*").alias("events")
    )


def overview_metrics(detection: DataFrame) -> DataFrame:
    """Headline numbers; ``false_positive_rate`` here is FP/(TP+FP), as shown on the dashboard."""
    flagged, labelled, attack = F.col("verdict") != "normal", F.col("is_attack").isNotNull(), F.col("is_attack")
    hits = F.count_if(labelled & (attack == flagged))
    tp, fp = F.count_if(labelled & attack & flagged), F.count_if(labelled & ~attack & flagged)
    row = detection.agg(
        F.count("*").alias("total_events"), F.count_if(flagged).alias("anomalies"),
        F.count_if(flagged & (F.col("severity") == "critical")).alias("critical_alerts"),
        hits.alias("hits"), F.count_if(labelled).alias("labelled"), tp.alias("tp"), fp.alias("fp"),
        F.coalesce(F.sum(F.when(flagged, scaled(F.col("risk_score"), 2))), F.lit(0)).alias("risk"),
    )
    return row.select(
        "total_events", "anomalies", "critical_alerts",
        ratio(F.col("hits") * F.lit(100.0), F.col("labelled"), 2).alias("detection_accuracy"),
        ratio(F.col("risk"), F.col("anomalies") * F.lit(100.0), 2).alias("average_risk"),
        ratio(F.col("fp") * F.lit(100.0), F.col("tp") + F.col("fp"), 2).alias("false_positive_rate"),
    )


def attack_distribution(classified: DataFrame) -> DataFrame:
    return counts_by(classified, "attack_type").orderBy(F.desc("events"), "attack_type")


def severity_distribution(detection: DataFrame) -> DataFrame:
    return counts_by(filter_flagged(detection), "severity").orderBy(F.desc("events"), "severity")


def risk_histogram(detection: DataFrame) -> DataFrame:
    """Ten right-closed bins of width 10, the first including 0; empty bins kept."""
    place = F.greatest(F.ceil(F.col("risk_score") / F.lit(10.0)), F.lit(1)).cast("int")
    full = over_domain(detection.select(place.alias("bin")), "bin", tuple(range(1, 11)))
    label = F.concat(((F.col("bin") - 1) * 10).cast("string"), F.lit("-"), (F.col("bin") * 10).cast("string"))
    return full.select("bin", label.alias("label"), "events").orderBy("bin")


def semi_flagged_events(engineered: DataFrame, detection: DataFrame) -> DataFrame:
    return engineered.join(filter_flagged(detection).select(KEY, "event_id"), [KEY, "event_id"], "left_semi")


def hourly_activity(engineered: DataFrame, detection: DataFrame) -> DataFrame:
    """Events and flagged events for each of the 24 local hours."""
    total = counts_by(engineered, "login_hour", "total_events")
    flagged = counts_by(semi_flagged_events(engineered, detection), "login_hour", "anomalous_events")
    hours = dims.domain(engineered.sparkSession, "login_hour", tuple(range(24))).select("login_hour")
    joined = hours.join(total, "login_hour", "left").join(flagged, "login_hour", "left")
    return joined.fillna(0).orderBy("login_hour")


def topk_values(df: DataFrame, column: str, k: int = TOP_N) -> DataFrame:
    """The k most frequent values, ties by value."""
    return counts_by(df, column).orderBy(F.desc("events"), column).limit(k)


def analytics_document(detection: DataFrame, classified: DataFrame, engineered: DataFrame) -> DataFrame:
    """The dashboard's analytics as one row of six lists, each of a fixed or short length, in their display order."""
    flagged = semi_flagged_events(engineered, detection)

    def listed(df: DataFrame, name: str, key: str, *order: str) -> DataFrame:
        place = F.struct(*[(-F.col(c[1:])).alias(f"o{i}") if c[0] == "-" else F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        fields = [F.col(key).cast("string").alias("label"), *[F.col(c) for c in df.columns if c.endswith("events")]]
        rows = F.sort_array(F.collect_list(F.struct(place.alias("place"), F.struct(*fields).alias("entry"))))
        return df.agg(F.transform(rows, lambda r: r["entry"]).alias(name))

    parts = [
        listed(attack_distribution(classified), "attackDistribution", "attack_type", "-events", "attack_type"),
        listed(severity_distribution(detection), "severityDistribution", "severity", "-events", "severity"),
        listed(risk_histogram(detection), "riskDistribution", "label", "bin"),
        listed(hourly_activity(engineered, detection), "hourlyActivity", "login_hour", "login_hour"),
        listed(topk_values(flagged, "resource_accessed"), "topResources", "resource_accessed", "-events", "resource_accessed"),
        listed(topk_values(flagged, "geo_location"), "geoDistribution", "geo_location", "-events", "geo_location"),
    ]
    document = parts[0]
    for part in parts[1:]:  # one row each
        document = document.select("*", *[part.select(name).scalar().alias(name) for name in part.columns])
    return document


def topk_highest_risk(explained: DataFrame, k: int = TOP_SUMMARIES) -> DataFrame:
    return explained.orderBy(F.desc("risk_score"), "event_id").limit(k)


# ---- cold start and drift evaluation ----


def join_cold_start(detection: DataFrame, engineered: DataFrame) -> DataFrame:
    """Detection with the feature columns of the same event; the feature side names the entity type."""
    features = engineered.select(KEY, "event_id", "entity_type", "new_entity_flag", "fingerprint_mismatch", "history_length")
    return detection.withColumnRenamed("entity_type", "entity_type_detection").join(features, [KEY, "event_id"])


SEGMENTS = ("New Users", "New Service Accounts", "New Devices (fingerprint novel)", "Established Baseline")


def segment_predicates() -> dict[str, Column]:
    new = F.col("new_entity_flag")
    rules = (
        (F.col("entity_type") == "user") & new,
        (F.col("entity_type") == "service_account") & new,
        F.col("fingerprint_mismatch"),
        ~new,
    )
    return dict(zip(SEGMENTS, rules))


def filter_segment(merged: DataFrame, name: str) -> DataFrame:
    return merged.filter(segment_predicates()[name])


def cold_start_segments(merged: DataFrame) -> DataFrame:
    """Four overlapping segments in one pass; the false-positive rate is null without labelled negatives."""
    member = F.filter(
        F.array(*[F.when(rule, F.lit(name)) for name, rule in segment_predicates().items()]), lambda s: s.isNotNull()
    )
    flagged = F.col("verdict") != "normal"
    negative = F.col("is_attack").isNotNull() & ~F.col("is_attack")
    sums = merged.withColumn("segment_name", F.explode(member)).groupBy("segment_name").agg(
        F.count("*").alias("event_count"),
        F.sum(scaled(F.col("risk_score"), 2)).alias("risk"),
        F.sum(scaled(F.col("anomaly_score"), 4)).alias("anomaly"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(negative).alias("negatives"),
        F.count_if(negative & flagged).alias("false_positives"),
    )
    names = dims.domain(merged.sparkSession, "segment_name", SEGMENTS).select("segment_name")
    n = F.col("event_count")
    full = names.join(sums, "segment_name", "left").fillna(0)
    return full.select(
        "segment_name", n,
        ratio(F.col("risk"), n * F.lit(100.0), 4).alias("avg_risk_score"),
        ratio(F.col("anomaly"), n * F.lit(10_000.0), 4).alias("avg_anomaly_score"),
        ratio(F.col("flagged"), n, 6).alias("flagged_rate"),
        F.when(F.col("negatives") > 0, ratio(F.col("false_positives"), F.col("negatives"), 6)).alias("false_positive_rate"),
    )


def warmup_curve(merged: DataFrame) -> DataFrame:
    return merged.groupBy(binned(F.col("history_length"), HISTORY_BINS).alias("history_length_range")).agg(
        F.count("*").alias("event_count"), exact_avg(F.col("risk_score"), 2, 4).alias("avg_risk_score"),
        exact_avg(F.col("historical_confidence"), 4, 4).alias("avg_historical_confidence"),
    )


def calibration_curve(merged: DataFrame) -> DataFrame:
    """Verdict accuracy among labelled events per confidence bin."""
    labelled = F.col("is_attack").isNotNull()
    correct = (F.col("verdict") != "normal") == F.col("is_attack")
    return (
        merged.withColumn("confidence_range", binned(F.col("historical_confidence"), CONFIDENCE_BINS))
        .filter(F.col("confidence_range").isNotNull())
        .groupBy("confidence_range")
        .agg(
            F.count("*").alias("event_count"),
            exact_avg(F.col("historical_confidence"), 4, 4).alias("avg_confidence"),
            F.when(F.count_if(labelled) > 0, ratio(F.count_if(labelled & correct), F.count_if(labelled), 6)).alias(
                "empirical_accuracy"
            ),
        )
    )


def period_drift(engineered: DataFrame, period: str) -> DataFrame:
    """Weekly (from Monday) or monthly event counts, mean and 90th percentile of the drift feature.

    A week is labelled by the calendar year of its Monday and its ISO number.
    """
    start = F.date_trunc(period, "timestamp")
    number = F.weekofyear(start) if period == "week" else F.month(start)
    mark = "-W" if period == "week" else "-"
    label = F.concat(F.year(start).cast("string"), F.lit(mark), F.lpad(number.cast("string"), 2, "0"))
    return engineered.groupBy(label.alias("period_label")).agg(
        F.count("*").alias("event_count"), exact_avg(F.col("behaviour_drift_score"), 4, 4).alias("avg_drift_score"),
        round_dp(F.percentile("behaviour_drift_score", 0.9), 4).alias("p90_drift_score"),
    )


def profile_update_summary(store: Profiles) -> DataFrame:
    per_entity = store.core.groupBy(KEY).agg(
        F.count("*").alias("versions"), F.max_by("drift_score", "version").alias("latest")
    )
    return per_entity.agg(
        F.count("*").alias("total_entities"), F.count_if(F.col("versions") > 1).alias("entities_with_multiple_versions"),
        F.coalesce(exact_avg(F.col("latest"), 4, 6), F.lit(0.0)).alias("avg_latest_drift_score"),
        F.coalesce(F.max("latest"), F.lit(0.0)).alias("max_latest_drift_score"),
    )


def detection_stability(detection: DataFrame) -> DataFrame:
    """Spread of the risk score on an entity's normal events, over entities with at least five of them."""
    normal = detection.filter(F.col("verdict") == "normal")
    spread = (
        normal.groupBy(KEY)
        .agg(F.count("*").alias("n"), *moments("risk_score", 2, 8))
        .filter(F.col("n") >= MIN_STABILITY_EVENTS)
        .select(F.col("std").alias("spread"))
    )
    points = quantiles(spread, "spread", {"median": 0.5, "p90": 0.9})
    mean = spread.agg(F.count("*").alias("entities_evaluated"), exact_avg(F.col("spread"), 8, 4).alias("mean"))
    joined = mean.select(
        "entities_evaluated", F.coalesce("mean", F.lit(0.0)).alias("avg_risk_score_std"),
        points.select(F.coalesce(round_dp(F.col("median"), 4), F.lit(0.0))).scalar().alias("median_risk_score_std"),
        points.select(F.coalesce(round_dp(F.col("p90"), 4), F.lit(0.0))).scalar().alias("p90_risk_score_std"),
    )
    return joined


def entity_sample_to_budget(events: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """Whole entities, in an order fixed by the seed, until their events reach the budget."""
    sizes = events.groupBy(KEY).agg(F.count("*").alias("n")).withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), KEY)))
    placed = running_totals(sizes, [F.col("draw"), F.col(KEY)], {"reached": F.col("n")})
    chosen = placed.filter(F.col("reached") - F.col("n") < budget).select(KEY)
    return events.join(chosen, KEY, "left_semi")


def semi_entities(events: DataFrame, chosen: DataFrame) -> DataFrame:
    return events.join(chosen.select(KEY).distinct(), KEY, "left_semi")


# ---- stage ledger and export counts ----


def stage_ledger(runs: DataFrame) -> DataFrame:
    """Latest run of each stage from (stage, run_id, finished_at, errors, rows)."""
    return runs.groupBy("stage").agg(
        F.max_by("run_id", F.struct("finished_at", "run_id")).alias("last_run_id"),
        (F.max_by("errors", F.struct("finished_at", "run_id")) == 0).alias("last_run_passed"),
        F.max_by("rows", F.struct("finished_at", "run_id")).alias("events_processed"),
    ).withColumn("status", F.when(F.col("last_run_passed"), "operational").otherwise("degraded"))


def export_row_counts(sources: dict[str, DataFrame]) -> DataFrame:
    tables = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), "rows") for name, df in sources.items()]
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged


# ---- set operations on label tables ----


def union_injected(base: DataFrame, injected: DataFrame) -> DataFrame:
    """Normal and injected events in one table with aligned columns; only injected rows carry attack metadata."""
    attack = [c for c in schemas.ATTACK_COLUMNS if c != "injected"]
    plain = base.drop(*schemas.ATTACK_COLUMNS).withColumn("injected", F.lit(False))
    marked = injected.withColumn("injected", F.lit(True)).withColumn("label", F.lit("attack"))
    merged = plain.unionByName(marked.select(*[c for c in plain.columns if c != "injected"], "injected", *attack), allowMissingColumns=True)
    return merged.select(*schemas.LABELLED_EVENT_COLUMNS)


def union_ground_truth(base: DataFrame, injected: DataFrame) -> DataFrame:
    columns = schemas.GROUND_TRUTH_COLUMNS
    plain = base.select("event_id", KEY, F.lit(False).alias("is_attack"))
    marked = injected.withColumn("is_attack", F.lit(True)).select(*columns)
    return plain.unionByName(marked, allowMissingColumns=True).select(*columns)


def sort_chronological(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "event_id")
