"""Detection and classification quality against labels, with curves over totally ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.functions.numeric import ratio, round_dp
from accesslens.operators.profiles import KEY
from accesslens.operators.reports import (
    calibration_curve, cold_start_segments, confusion, detection_stability, period_drift, profile_update_summary,
    warmup_curve,
)
from accesslens.operators.scan import running_totals
from accesslens.session import written

# Curve size and reviewed share.
MAX_CURVE_POINTS = 200
TOP_PERCENTILE = 1.0


def filter_labelled(detection: DataFrame) -> DataFrame:
    return detection.filter(F.col("is_attack").isNotNull())


def binary_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates to 6 decimals; F1 is formed from the rounded precision and recall."""
    precision, recall = ratio(tp, tp + fp, 6), ratio(tp, tp + fn, 6)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(F.lit(2.0) * precision * recall, precision + recall, 6),
        "false_positive_rate": ratio(fp, fp + tn, 6),
        "false_negative_rate": ratio(fn, fn + tp, 6),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, 6),
    }


def _counts() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))


def binary_metrics(detection: DataFrame) -> DataFrame:
    return confusion(detection).select("*", *[v.alias(n) for n, v in binary_columns(*_counts()).items()])


def ranked_scores(detection: DataFrame) -> DataFrame:
    """Labelled rows by falling score, ties in (entity, time, event) order, with position, TP and FP so far."""
    rows = filter_labelled(detection).select(
        "event_id", KEY, "timestamp", "risk_score", F.col("is_attack").cast("long").alias("hit")
    )
    order = [F.col("risk_score").desc(), F.col(KEY), F.col("timestamp"), F.col("event_id")]
    placed = running_totals(
        rows, order, {"position": F.lit(1), "tp": F.col("hit"), "fp": F.lit(1) - F.col("hit")}
    )
    return written(placed.select("position", "risk_score", "hit", "tp", "fp"), "ranked")


def _total(ranked: DataFrame, column: str) -> Column:
    return ranked.select(F.max(column)).scalar()


def _some(total: Column, what: str) -> Column:
    """A divisor that must not be zero; a clear error otherwise."""
    return F.when(total > 0, total).otherwise(F.raise_error(F.lit(f"the curve is not defined without {what} among the labelled rows")))


def roc_curve(ranked: DataFrame) -> DataFrame:
    """(position, threshold, x, y) for every row and the origin at position 0; x and y are unrounded."""
    positives, negatives = _some(_total(ranked, "tp"), "attacks"), _some(_total(ranked, "fp"), "normal rows")
    rows = ranked.select(
        "position", F.col("risk_score").alias("threshold"),
        (F.col("fp") / negatives).alias("x"), (F.col("tp") / positives).alias("y"),
    )
    origin = ranked.agg((F.max("risk_score") + 1.0).alias("threshold")).select(
        F.lit(0).cast("long").alias("position"), "threshold", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")
    )
    return rows.unionByName(origin)


def roc_auc(ranked: DataFrame) -> DataFrame:
    """Trapezoid area over the per-row curve: each negative row adds a strip of its current TPR."""
    strips = F.sum(F.when(F.col("hit") == 0, F.col("tp")).otherwise(0).cast("decimal(38,0)"))
    row = ranked.agg(strips.alias("s"), F.max("tp").alias("p"), F.max("fp").alias("n"))
    return row.select(
        round_dp(F.col("s").cast("double") / (_some(F.col("p"), "attacks").cast("double") * _some(F.col("n"), "normal rows").cast("double")), 6).alias("roc_auc")
    )


def pr_curve(ranked: DataFrame) -> DataFrame:
    positives = _some(_total(ranked, "tp"), "attacks")
    return ranked.select(
        (F.col("position") - 1).alias("position"), F.col("risk_score").alias("threshold"),
        (F.col("tp") / positives).alias("x"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("y"),
    )


def pr_auc(ranked: DataFrame) -> DataFrame:
    """Average precision: precision at each positive row, averaged over the positives."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    exact = F.sum(F.when(F.col("hit") == 1, F.floor(precision * F.lit(1e12) + F.lit(0.5)).cast("decimal(38,0)")))
    row = ranked.agg(exact.alias("s"), F.max("tp").alias("p"))
    return row.select(round_dp(F.col("s").cast("double") / F.lit(1e12) / _some(F.col("p"), "attacks"), 6).alias("pr_auc"))


def curve_downsample(curve: DataFrame, points: int = MAX_CURVE_POINTS) -> DataFrame:
    """At most ``points`` evenly spaced rows by 0-based position, first and last included, values rounded."""
    last = curve.select(F.max("position")).scalar()
    steps = points - 1
    wanted = (
        curve.sparkSession.range(points)
        .select(F.floor((F.col("id") * 2 * last + steps) / F.lit(2 * steps)).cast("long").alias("position"))
        .distinct()
    )
    kept = curve.filter(last >= points).join(F.broadcast(wanted), "position", "left_semi")
    every = curve.filter(last < points)
    return kept.unionByName(every).select(
        "position", round_dp(F.col("threshold"), 4).alias("threshold"), round_dp(F.col("x"), 6).alias("x"),
        round_dp(F.col("y"), 6).alias("y"),
    )


def top_percentile_precision(ranked: DataFrame, percentile: float = TOP_PERCENTILE) -> DataFrame:
    """Precision within the riskiest ``percentile`` percent of the rows, at least one row."""
    if not 0.0 < percentile <= 100.0:
        raise ValueError("percentile must lie in (0, 100]")
    size = F.greatest(F.lit(1), F.bround(_total(ranked, "position") * F.lit(percentile) / F.lit(100.0), 0).cast("long"))
    top = ranked.select("position", "hit", size.alias("size")).filter(F.col("position") <= F.col("size"))
    return top.groupBy("size").agg(F.sum("hit").alias("hits")).select(
        F.lit(percentile).alias("percentile"), F.col("size").alias("reviewed"), ratio(F.col("hits"), F.col("size"), 6).alias("precision")
    )


def eval_detection(detection: DataFrame) -> DataFrame:
    """All binary metrics and areas in one row; raises when nothing is labelled."""
    if filter_labelled(detection).isEmpty():
        raise ValueError("no labelled rows to evaluate")
    ranked = ranked_scores(detection)
    top = top_percentile_precision(ranked)
    return binary_metrics(detection).select(
        "*",
        roc_auc(ranked).scalar().alias("roc_auc"),
        pr_auc(ranked).scalar().alias("pr_auc"),
        top.select("precision").scalar().alias("top_percentile_precision"),
        top.select("reviewed").scalar().alias("top_percentile_count"),
    )


# ---- multiclass ----


def _labelled_types(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("ground_truth_attack_type").isNotNull()).select(
        F.col("ground_truth_attack_type").alias("actual"), F.col("attack_type").alias("predicted")
    )


def labelled_rows(classified: DataFrame) -> Column:
    """How many classified rows carry a true type, as a scalar."""
    return classified.agg(F.count("ground_truth_attack_type")).scalar()


def union_class_labels(classified: DataFrame) -> DataFrame:
    """The sorted classes that occur as a label or as a prediction among labelled rows."""
    pairs = _labelled_types(classified)
    return (
        pairs.groupBy("actual", "predicted").count()
        .select(F.explode(F.array("actual", "predicted")).alias("class")).distinct().orderBy("class")
    )


def multiclass_confusion(classified: DataFrame) -> DataFrame:
    """Dense actual × predicted counts, zeros kept. The grid comes from the (few) class names."""
    counts = _labelled_types(classified).groupBy("actual", "predicted").agg(F.count("*").alias("events"))
    names = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("names"))
    grid = names.select(F.explode("names").alias("actual"), "names").select("actual", F.explode("names").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["events"])


def per_class_metrics(matrix: DataFrame) -> DataFrame:
    """One-vs-rest counts and rates per class, from the confusion rows."""
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.lit(True).alias("as_actual")),
        F.struct(F.col("predicted").alias("class"), F.lit(False).alias("as_actual")),
    )
    flat = matrix.select("actual", "predicted", "events", F.explode(sides).alias("s")).select("actual", "predicted", "events", "s.*")
    hit = (F.col("actual") == F.col("predicted")) & F.col("as_actual")
    n = F.col("events")
    miss = F.col("actual") != F.col("predicted")
    total = matrix.select(F.sum("events")).scalar()
    counts = flat.groupBy("class").agg(
        F.sum(F.when(hit, n).otherwise(0)).alias("true_positive"),
        F.sum(F.when(miss & ~F.col("as_actual"), n).otherwise(0)).alias("false_positive"),
        F.sum(F.when(miss & F.col("as_actual"), n).otherwise(0)).alias("false_negative"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    counts = counts.withColumn("true_negative", total - tp - fp - fn)
    rates = binary_columns(*_counts())
    return counts.select("class", (tp + fn).alias("support"), "true_positive", "false_positive", "true_negative",
                         "false_negative", *[rates[r].alias(r) for r in ("precision", "recall", "f1")])


def macro_weighted_f1(matrix: DataFrame) -> DataFrame:
    per = per_class_metrics(matrix)
    f1 = F.floor(F.col("f1") * F.lit(1e6) + F.lit(0.5)).cast("long")
    return per.agg(
        F.count("*").alias("classes"), F.sum(f1).alias("f"), F.sum(f1 * F.col("support")).alias("w"),
        F.sum("support").alias("labelled"), F.sum("true_positive").alias("correct"),
    ).select(
        "labelled",
        ratio(F.col("f"), F.col("classes") * F.lit(1e6), 6).alias("macro_f1"),
        ratio(F.col("w"), F.col("labelled") * F.lit(1e6), 6).alias("weighted_f1"),
        ratio(F.col("correct"), F.col("labelled"), 6).alias("accuracy"),
    )


def eval_classification(classified: DataFrame) -> DataFrame:
    """Per-class rows with the overall scores beside them; raises when nothing is labelled."""
    if _labelled_types(classified).isEmpty():
        raise ValueError("no labelled rows to evaluate")
    matrix = multiclass_confusion(classified)
    overall = macro_weighted_f1(matrix)
    return per_class_metrics(matrix).select(
        "class", "support", "precision", "recall", "f1",
        *[overall.select(c).scalar().alias(c) for c in ("macro_f1", "weighted_f1", "accuracy")],
    )


def _long(df: DataFrame, part: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.lit(part).alias("part"), F.col(key).alias("item"), F.explode(pairs).alias("m")).select("part", "item", "m.*")


def eval_cold_start(merged: DataFrame) -> DataFrame:
    """Segments, warm-up and calibration as (part, item, metric, value)."""
    return (
        _long(cold_start_segments(merged), "segment", "segment_name",
              ("event_count", "avg_risk_score", "avg_anomaly_score", "flagged_rate", "false_positive_rate"))
        .unionByName(_long(warmup_curve(merged), "warmup", "history_length_range",
                           ("event_count", "avg_risk_score", "avg_historical_confidence")))
        .unionByName(_long(calibration_curve(merged), "calibration", "confidence_range",
                           ("event_count", "avg_confidence", "empirical_accuracy")))
    )


def eval_concept_drift(engineered: DataFrame, detection: DataFrame, store) -> DataFrame:
    """Weekly and monthly drift, profile updates and stability as (part, item, metric, value)."""
    period = ("event_count", "avg_drift_score", "p90_drift_score")
    updates = profile_update_summary(store).withColumn("all", F.lit("all"))
    stability = detection_stability(detection).withColumn("all", F.lit("all"))
    return (
        _long(period_drift(engineered, "week"), "weekly", "period_label", period)
        .unionByName(_long(period_drift(engineered, "month"), "monthly", "period_label", period))
        .unionByName(_long(updates, "updates", "all", (
            "total_entities", "entities_with_multiple_versions", "avg_latest_drift_score", "max_latest_drift_score")))
        .unionByName(_long(stability, "stability", "all", (
            "entities_evaluated", "avg_risk_score_std", "median_risk_score_std", "p90_risk_score_std")))
    )
