from accesslens import schemas
from accesslens.operators.features import engineer_features
from accesslens.session import work_path
from accesslens.streaming import stateful as st
from test_features import ENTITIES, event


def test_rows_count_in_event_time_and_a_restart_resumes(spark):
    entities = spark.createDataFrame(ENTITIES, schemas.entity_schema())
    source, base = work_path(spark, "source"), work_path(spark, "late")
    config = st.StreamConfig(late="1 hour", files=1)
    schema = schemas.event_schema()

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = st.stream_features(st.read_events(spark, source, schema, config), entities, config=config)
        st.run_available(stream, f"{base}/out", f"{base}/checkpoint")
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    first = [event(i, minutes=i) for i in range(5)]
    arrive(first)
    run()
    # Event 6 is five minutes late but inside the hour: it counts as history of event 5, not the other way round.
    on_time, accepted, late = [event(5, minutes=600)], [event(6, minutes=595)], [event(8, minutes=1)]
    arrive(on_time)
    arrive(accepted)
    run()
    arrive(late + [event(7, minutes=601)])
    run()
    st.closing_row(spark.read.schema(schema).parquet(source)).coalesce(1).write.mode("append").parquet(source)
    out = run()
    assert {r["event_id"] for r in out.select("event_id").collect()} == {f"e{i:03d}" for i in range(8)}
    assert [r["event_id"] for r in st.late_rows(spark.read.schema(schema).parquet(source), out).collect()] == ["e008"]
    # The state lived on over the restarts: the stream equals a batch over the rows that were accepted.
    batch = engineer_features(spark.createDataFrame(first + on_time + accepted + [event(7, minutes=601)], schema), entities)
    columns = ["event_id", *schemas.FEATURE_NAMES]
    assert batch.select(*columns).exceptAll(out.select(*columns)).isEmpty()


def test_result_does_not_depend_on_files_per_batch(spark):
    entities = spark.createDataFrame(ENTITIES, schemas.entity_schema())
    schema, rows = schemas.event_schema(), [event(i, minutes=(7 * i) % 40) for i in range(40)]
    source = work_path(spark, "shuffled")
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(source)
    st.closing_row(spark.createDataFrame(rows, schema)).coalesce(1).write.mode("append").parquet(source)
    columns = ["event_id", *schemas.FEATURE_NAMES]
    batch = engineer_features(spark.createDataFrame(rows, schema), entities).select(*columns)
    for files in (1, 1000):
        config = st.StreamConfig(late="1 hour", files=files)
        out = st.replay(st.stream_features(st.read_events(spark, source, schema, config), entities, config=config), f"files{files}").select(*columns)
        assert out.count() == len(rows) and batch.exceptAll(out).isEmpty()


def test_state_expires_only_when_asked(spark):
    entities = spark.createDataFrame(ENTITIES, schemas.entity_schema())
    schema, rows = schemas.event_schema(), [event(0, minutes=0), event(1, minutes=60 * 24 * 200)]
    for expiry, lengths in ((None, [0, 1]), (86_400_000, [0, 0])):
        source = work_path(spark, "quiet")
        for r in (*rows[:1], *[event(50, minutes=60 * 24 * 100, entity="USR-000002")], *rows[1:]):
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(source)
        st.closing_row(spark.createDataFrame(rows, schema)).coalesce(1).write.mode("append").parquet(source)
        config = st.StreamConfig(late="1 hour", files=1, expiry_ms=expiry)
        out = st.replay(st.stream_features(st.read_events(spark, source, schema, config), entities, config=config), "quiet")
        assert [r.history_length for r in out.filter("event_id <> 'e050'").orderBy("timestamp").collect()] == lengths
