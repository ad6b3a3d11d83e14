from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.operators import alerts as al
from accesslens.operators import classify as cl
from accesslens.operators import detect as de
from accesslens.operators import evaluate as ev
from accesslens.operators import explain as ex
from accesslens.operators import profiles as pr
from accesslens.operators import quality as qa
from accesslens.operators import reports as rp
from accesslens.operators.scan import SkewConfig
from accesslens.session import work_path
from accesslens.sources import dims

# ---- profiles ----


def test_entity_without_events_has_a_zero_profile(pipeline):
    empty = pipeline.latest().core.filter(F.col("sample_count") == 0).first()
    assert empty["is_new_entity"] and empty["warmup_strategy"] == "insufficient_data"
    assert empty["confidence_score"] == 0.0 and empty["avg_login_hour"] == 0.0 and empty["resource_sharing_score"] == 0.0


def test_versions_append_and_keep_their_creation(pipeline):
    store = pipeline.store()
    rows = store.core.filter(F.col("sample_count") > 0).groupBy("entity_id").agg(
        F.collect_list("version").alias("v"), F.countDistinct("created_at").alias("c"), F.countDistinct("updated_at").alias("u"))
    row = rows.first()
    assert sorted(row["v"]) == [1, 2] and row["c"] == 1 and row["u"] == 2
    first = store.core.filter(F.col("version") == 1)
    assert first.filter((F.col("drift_score") != 0) | (F.size("drifted_dimensions") > 0)).isEmpty()


def test_filter_normal_prefers_is_attack(spark):
    rows = spark.createDataFrame([(1, True, "normal"), (2, None, "attack"), (3, False, "attack")], "id int, is_attack boolean, label string")
    assert {r["id"] for r in pr.filter_normal(rows).collect()} == {2, 3}
    assert {r["id"] for r in pr.filter_normal(rows.drop("is_attack")).collect()} == {1}
    assert pr.filter_normal(rows.select("id")).count() == 3


def test_long_histories_give_the_same_profile(pipeline):
    engineered, entities = pipeline.engineered(), pipeline.entities()
    plain = pr.build_profiles(engineered, entities, datetime(2024, 2, 1))
    blocks = pr.build_profiles(engineered, entities, datetime(2024, 2, 1), skew=SkewConfig(hot_rows=20, block_rows=16))
    for name, part in plain.parts().items():
        other = blocks.parts()[name].select(*part.columns)
        if name == "core":
            part, other = part.drop("drifted_dimensions"), other.drop("drifted_dimensions")
        assert part.exceptAll(other).isEmpty() and other.exceptAll(part).isEmpty(), name


# ---- detection ----


@pytest.mark.parametrize("risk,level,state", [
    (9.99, "informational", "normal"), (10.0, "low", "normal"), (20.0, "low", "normal"), (25.0, "medium", "suspicious"),
    (45.0, "high", "anomalous"), (55.0, "critical", "anomalous"),
])
def test_severity_edges(spark, risk, level, state):
    row = spark.range(1).select(de.severity(F.lit(risk)).alias("s"), de.verdict(de.severity(F.lit(risk))).alias("v")).first()
    assert (row["s"], row["v"]) == (level, state)


def test_configs_are_checked():
    de.ThresholdConfig(5.0, 10.0, 10.0, 45.0, 55.0)  # equal neighbours are accepted
    for bad in (lambda: de.ThresholdConfig(5.0, 30.0, 25.0, 45.0, 55.0), lambda: de.ThresholdConfig(critical=101.0),
                lambda: de.RiskConfig(deviation=0.5), lambda: cl.ConfidenceConfig(match=0.6), lambda: cl.ConfidenceConfig(unknown_cap=1.5),
                lambda: ex.BandConfig(0.7, 0.6), lambda: de.scoring_strategy("none"), lambda: cl.classification_strategy("none")):
        with pytest.raises(ValueError):
            bad()


def test_unknown_profile_is_neutral(pipeline):
    none = pr.Profiles(*[part.limit(0) for part in pipeline.latest().parts().values()])
    row = de.detect(pipeline.engineered(), none).first()
    assert {row[c] for c in schemas.DEVIATION_COLUMNS} == {0.5}
    assert row["anomaly_score"] == 0.5 and row["entity_trust"] == 0.0 and row["profile_version"] is None and row["entity_type"] is None


def test_detection_ignores_labels(pipeline):
    with_label = de.detect(pipeline.engineered(), pipeline.latest()).drop("is_attack")
    without = de.detect(pipeline.engineered().drop("is_attack", "label"), pipeline.latest())
    assert with_label.exceptAll(without.select(*with_label.columns)).isEmpty()


# ---- classification ----


def scored(spark, scores, deviations=None, anomaly=0.5):
    values = {f"score_{n}": float(scores.get(n, 0.0)) for n in dims.KNOWN_ATTACKS}
    values |= {f"deviation_{d}": float((deviations or {}).get(d, 0.0)) for d in schemas.DIMENSIONS}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(anomaly).alias("anomaly_score"))
    return df.withColumn("attack_type", cl.select_attack_type()).withColumn("confidence", cl.classification_confidence()).first()


def test_ties_go_to_the_stronger_dimension_then_the_larger_name(spark):
    tie = {"brute_force": 0.6, "device_spoofing": 0.6}
    assert scored(spark, tie, {"authentication": 0.9, "device": 0.2})["attack_type"] == "brute_force"
    assert scored(spark, tie, {"authentication": 0.2, "device": 0.2})["attack_type"] == "device_spoofing"
    same = scored(spark, {"insider_drift": 0.8, "lateral_movement": 0.8}, {"resource": 0.4})
    assert same["attack_type"] == "lateral_movement" and same["confidence"] == 0.5


def test_nothing_above_the_floor_is_unknown(spark):
    row = scored(spark, {"brute_force": 0.2}, anomaly=0.75)
    assert row["attack_type"] == "unknown" and row["confidence"] == 0.15


def test_floor_is_inclusive(spark):
    assert scored(spark, {"brute_force": 0.4})["attack_type"] == "brute_force"


# ---- explanations ----


def shares(spark, **values):
    df = spark.range(1).select(*[F.lit(float(values.get(d, 0.0))).alias(f"deviation_{d}") for d in schemas.DIMENSIONS])
    return [(c["dimension"], c["contribution_percentage"]) for c in df.select(ex.feature_attribution().alias("c")).first()["c"]]


def test_equal_shares_when_nothing_deviates(spark):
    assert shares(spark) == [(d, 16.67) for d in schemas.DIMENSIONS]


def test_left_over_goes_to_the_first_largest(spark):
    got = shares(spark, device=0.3, resource=0.3, session=0.3)
    assert got[:3] == [("device", 33.34), ("resource", 33.33), ("session", 33.33)]
    assert round(sum(v for _, v in got), 2) == 100.0


def test_escalation_comes_first(spark):
    def acts(kind, level):
        df = spark.range(1).select(ex.recommend_actions(F.lit(kind), F.lit(level)).alias("a"))
        return [(a["priority"], a["action"]) for a in df.first()["a"]]

    assert acts("unknown", "critical")[0] == dims.ESCALATION[:2]
    assert len(acts("unknown", "medium")) == 2
    ranks = [schemas.PRIORITIES.index(p) for p, _ in acts("insider_drift", "high")]
    assert ranks == sorted(ranks) and len(ranks) == 4


@pytest.mark.parametrize("value,level", [(0.39, "low"), (0.4, "medium"), (0.65, "high")])
def test_confidence_bands(spark, value, level):
    assert spark.range(1).select(ex.confidence_level(F.lit(value)).alias("l")).first()["l"] == level


# ---- evaluation ----


@pytest.fixture(scope="module")
def detections(spark):
    rows = [(f"e{i:02d}", "x", datetime(2024, 1, 1), s, v, a) for i, (s, v, a) in enumerate([
        (90.0, "anomalous", True), (80.0, "anomalous", False), (70.0, "suspicious", True), (60.0, "normal", True), (60.0, "normal", False),
        (10.0, "normal", False), (5.0, "normal", None)])]
    return spark.createDataFrame(rows, "event_id string, entity_id string, timestamp timestamp, risk_score double, verdict string, is_attack boolean")


def test_binary_metrics(detections):
    row = ev.binary_metrics(detections).first()
    assert (row["true_positive"], row["false_positive"], row["true_negative"], row["false_negative"]) == (2, 1, 2, 1)
    assert row["precision"] == 0.666667 and row["f1"] == 0.666667 and row["false_positive_rate"] == 0.333333


def test_areas_follow_row_order_inside_ties(detections):
    ranked = ev.ranked_scores(detections)
    # positives at ranks 1, 3, 4 and negatives at 2, 5, 6
    assert ev.roc_auc(ranked).first()[0] == round((1 + 3 + 3) / 9, 6)
    assert ev.pr_auc(ranked).first()[0] == round((1 + 2 / 3 + 3 / 4) / 3, 6)
    assert ev.top_percentile_precision(ranked, 50.0).first()["precision"] == 0.666667
    assert ev.roc_curve(ranked).filter(F.col("position") == 0).first()["threshold"] == 91.0


def test_nothing_labelled_is_an_error(detections):
    with pytest.raises(ValueError):
        ev.eval_detection(detections.filter(F.col("is_attack").isNull()))


def test_long_curves_are_thinned(spark):
    curve = spark.range(1000).select(F.col("id").alias("position"), F.lit(1.0).alias("threshold"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    kept = sorted(r["position"] for r in ev.curve_downsample(curve).collect())
    assert len(kept) == 200 and kept[0] == 0 and kept[-1] == 999
    assert ev.curve_downsample(curve.limit(50)).count() == 50


def test_class_absent_from_predictions(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "b"), (None, "b")], "ground_truth_attack_type string, attack_type string")
    matrix = ev.multiclass_confusion(rows)
    assert matrix.count() == 4
    per = {r["class"]: r for r in ev.per_class_metrics(matrix).collect()}
    assert per["a"]["precision"] == 0.0 and per["a"]["support"] == 1 and per["b"]["precision"] == 0.5


# ---- reports, alerts, quality ----


def test_histogram_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.01,), (100.0,)], "risk_score double")
    counts = {r["bin"]: r["events"] for r in rp.risk_histogram(df).collect()}
    assert counts[1] == 2 and counts[2] == 1 and counts[10] == 1 and len(counts) == 10


def test_pages_are_clamped(pipeline):
    alerts = pipeline.alerts()
    n = alerts.count()
    last = al.paginate_alerts(alerts, 999).count()
    assert last == (n - 1) % al.PAGE_SIZE + 1
    assert al.paginate_alerts(alerts, 1).count() == min(n, al.PAGE_SIZE)


def test_alert_history_is_found_by_position(pipeline):
    engineered = pipeline.engineered()
    found = {r.event_id: r.history for r in al.alert_history_window(engineered, engineered.select("entity_id", "event_id")).collect()}
    by_entity = {}
    for r in engineered.orderBy("entity_id", "timestamp", "event_id").collect():
        by_entity.setdefault(r.entity_id, []).append(r)
    assert len(found) == sum(map(len, by_entity.values())) == 1000
    for rows in by_entity.values():
        for i, r in enumerate(rows):
            assert [tuple(h) for h in found[r.event_id]] == [tuple(q[c] for c in al.HISTORY_FIELDS.values()) for q in rows[max(0, i - 11) : i + 1]]


def test_alerts_move_no_events_by_event_alone(pipeline):
    p = pipeline
    plan = al.build_alerts(p.classified(), p.detection(), p.explained(), p.engineered(), p.entities(), p.latest())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" not in text and "Window" not in text


def test_blank_search_finds_all(pipeline):
    assert al.alert_search(pipeline.alerts(), "  ").count() == pipeline.alerts().count()


def test_clean_stages_pass(pipeline):
    found = qa.together(
        qa.dq_score_ranges(pipeline.detection()), qa.dq_no_nulls(pipeline.engineered()), qa.dq_distribution_sums(pipeline.latest()),
        qa.dq_chronology(pipeline.events(), date(2024, 1, 1), date(2024, 1, 30)), qa.dq_contribution_sum(pipeline.explained()),
    )
    assert qa.dq_report(found).first()["passed"]


def test_breaches_are_counted(spark):
    rows = spark.createDataFrame([("e1", "u1"), ("e1", "u1"), (None, "u2")], "event_id string, entity_id string")
    full = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in schemas.LABELLED_EVENT_COLUMNS if c not in rows.columns])
    assert sorted(r["message"] for r in qa.dq_dataset_integrity(full).collect()) == ["duplicate event_id", "null event_id"]
    assert qa.dq_dataset_integrity(rows).count() == len(schemas.LABELLED_EVENT_COLUMNS) - 2


def test_shared_folder_comes_from_the_session(spark):
    assert work_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
