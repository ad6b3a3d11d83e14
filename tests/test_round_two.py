import json

import pytest
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.functions.numeric import entropy_bits
from accesslens.operators import alerts as al
from accesslens.operators import evaluate as ev
from accesslens.operators import profiles as pr
from accesslens.operators import quality as qa
from accesslens.operators.features import engineer_features
from accesslens.operators.scan import SkewConfig
from accesslens.session import listing, release, shared_folder
from accesslens.sources import readers, sinks
from test_features import ENTITIES, event


def test_missing_values_count_alike_in_blocks_and_in_one_pass(spark):
    entities = spark.createDataFrame(ENTITIES, schemas.entity_schema())
    pick = lambda i, k, value: None if i % k == 0 else value
    rows = [
        event(
            i, minutes=3 * i, geo=pick(i, 5, "London, United Kingdom"), resource=pick(i, 7, f"r{i % 3}"), device=pick(i, 4, f"d{i % 2}"),
            os=pick(i, 3, "os"), mac=pick(i, 6, "mac"), seconds=pick(i, 9, 10 * (i % 11)), auth=pick(i, 8, "mfa"), result=pick(i, 10, "success"),
        )
        for i in range(60)
    ]
    columns = ["event_id", *schemas.FEATURE_NAMES, "previous_resource"]
    whole, blocks = (
        engineer_features(spark.createDataFrame(rows, schemas.event_schema()), entities, skew=skew).select(*columns)
        for skew in (SkewConfig(), SkewConfig(hot_rows=16, block_rows=16))
    )
    assert whole.count() == 60 and whole.exceptAll(blocks).isEmpty() and blocks.exceptAll(whole).isEmpty()


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    events = spark.createDataFrame([event(i, minutes=i) for i in range(5)], schemas.event_schema())
    shuffled = events.select(F.lit("x").alias("unknown"), *reversed(events.columns))
    back = readers.scan_events(spark, sinks.sink_csv(shuffled, str(tmp_path / "events")))
    assert back.columns == events.columns
    assert back.select("event_id", "entity_id", "resource_accessed", "login_result").exceptAll(events.select("event_id", "entity_id", "resource_accessed", "login_result")).isEmpty()
    without = readers.scan_events(spark, sinks.sink_csv(events.drop("device_os"), str(tmp_path / "no_os")))
    assert without.filter("device_os IS NOT NULL").isEmpty() and without.count() == 5


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_a_missing_column_is_an_error(spark, tmp_path, kind):
    events = spark.createDataFrame([event(0)], schemas.event_schema()).drop("login_result")
    path = getattr(sinks, f"sink_{kind}")(events, str(tmp_path / f"cut.{kind}"))
    with pytest.raises(ValueError, match="login_result"):
        readers.scan_events(spark, path)


def test_alert_files_are_arrays_or_lines(spark, tmp_path):
    documents = [{"eventId": "e1", "riskScore": 30.5}, {"eventId": "e2", "riskScore": 41.0}]
    (tmp_path / "array.json").write_text(" \n" + json.dumps(documents, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, documents)))
    schema = spark.createDataFrame([], "eventId string, riskScore double").schema
    for name in ("array", "lines"):
        back = readers.scan_alert_documents(spark, str(tmp_path / f"{name}.json"), schema)
        assert sorted(map(tuple, back.collect())) == [("e1", 30.5), ("e2", 41.0)]


def test_appending_a_build_twice_changes_nothing(pipeline, tmp_path):
    path, first = str(tmp_path / "store"), pr.scan_profiles_latest(pipeline.store())
    rows = lambda: {name: part.count() for name, part in pr.scan_store(pipeline.spark, path).parts().items()}
    pr.sink_profiles_append(first, path)
    once = rows()
    pr.sink_profiles_append(first, path)
    assert rows() == once == {name: part.count() for name, part in first.parts().items()}


def test_a_build_that_broke_off_is_completed(pipeline, tmp_path):
    path, latest = str(tmp_path / "store"), pipeline.latest()
    broken = latest.parts()["values"].limit(3)
    broken.write.partitionBy("version").parquet(f"{path}/builds/values/build={latest.build}")
    pr.sink_profiles_append(latest, path)
    assert pr.scan_store(pipeline.spark, path).values.count() == latest.values.count()


def test_every_flagged_event_is_an_alert_and_only_the_export_is_cut(pipeline):
    alerts = pipeline.alerts()
    assert alerts.count() == pipeline.classified().count()
    export = al.export_feed(alerts, 3).groupBy("attackType").count()
    assert export.agg(F.max("count")).first()[0] <= 3
    history = alerts.schema["history"].dataType.elementType.names
    assert history == list(al.HISTORY_FIELDS) and alerts.schema["profileBaseline"].dataType.names == list(al.BASELINE_FIELDS)


def test_square_sums_go_beyond_64_bits(spark):
    entities = spark.createDataFrame(ENTITIES, schemas.entity_schema())
    long = [3_000_000_000, 2_900_000_000, 3_000_000_000, 2_900_000_000]
    rows = [event(i, minutes=i, seconds=x) for i, x in enumerate(long)]
    events = spark.createDataFrame(rows, schemas.event_schema())
    for skew in (SkewConfig(), SkewConfig(hot_rows=16, block_rows=16)):
        last = engineer_features(events, entities, skew=skew).filter("event_id = 'e003'").first()
        assert last.rolling_std_session_duration == pytest.approx(57735026.92, abs=0.01)
    stats = pr.statistical(engineer_features(events, entities)).first()
    assert stats.session_duration_std == pytest.approx(57735026.9190, abs=0.001)


def test_curves_need_both_classes(spark):
    one = spark.createDataFrame([("e", "x", 1.0, True)], "event_id string, entity_id string, risk_score double, is_attack boolean").withColumn("timestamp", F.current_timestamp())
    with pytest.raises(Exception, match="without normal rows"):
        ev.roc_curve(ev.ranked_scores(one)).collect()


def test_entropy_counts_runs(spark):
    df = spark.createDataFrame([(["a", "b", "a", "a"],), ([],), (["x"],), (["a", "b", "c", "d"],)], "v array<string>")
    assert [round(r[0], 4) for r in df.select(entropy_bits(F.col("v"))).collect()] == [0.8113, 0.0, 0.0, 2.0]


def test_schema_check_looks_at_the_rows(pipeline):
    engineered = pipeline.engineered()
    assert qa.dq_schema_complete(engineered).isEmpty()
    blank = engineered.withColumn("login_hour", F.lit(None).cast("int")).drop("mac_novelty")
    assert {r.message for r in qa.dq_schema_complete(blank).collect()} == {"feature login_hour has no value", "missing feature mac_novelty"}


def test_version_gaps_are_legal(spark):
    rows = [("a", 1, 10), ("a", 5, 20), ("b", 1, 10), ("b", 2, 5), ("c", 1, 1), ("c", 1, 1)]
    core = spark.createDataFrame(rows, "entity_id string, version int, at int").withColumn("updated_at", F.timestamp_seconds("at"))
    assert sorted((r.subject, r.message) for r in qa.dq_version_monotonic(core).collect()) == [("b/2", "older than the version before"), ("c/1", "version stored twice")]


class Elsewhere:
    """A session as a cluster would have it, with no shared folder set."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere)
    Elsewhere.sparkContext.getCheckpointDir = staticmethod(lambda: "/shared/x")
    assert shared_folder(Elsewhere) == "/shared/x"


def test_listing_sees_changes(spark, tmp_path):
    before = listing(spark, str(tmp_path))
    (tmp_path / "events.parquet").write_text("x")
    assert before == "" and "events.parquet" in listing(spark, str(tmp_path)) and listing(spark, str(tmp_path / "none")) == ""
    assert callable(release)
