"""Queries that replay the event table as a stream, in slices out of order, and read what the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.operators import detect as de
from accesslens.operators.quality import dq_determinism
from accesslens.plans.oracle_base import FEATURE_SQL
from accesslens.plans.pipeline import Pipeline
from accesslens.plans.registry import add, tagged
from accesslens.streaming import stateful as st

#: Quarters of the time span, in the order they arrive: three of them come late.
ARRIVAL = (1, 0, 3, 2)
# Rows may be as late as half of a month of events.
CONFIG = st.StreamConfig(files=64, late="20 days")


def sliced(p: Pipeline, name: str, df: DataFrame, arrival: tuple[int, ...] = ARRIVAL) -> str:
    """All rows of a table as files: quarters of its time span in the order ``arrival``, and the row that ends the stream."""

    def write(path: str) -> None:
        span = df.agg(F.min(F.unix_micros("timestamp")).alias("low"), F.max(F.unix_micros("timestamp")).alias("high")).first()
        if span.low is None:
            df.write.parquet(path)
            return
        width = (span.high - span.low) // len(arrival) + 1
        quarter = (F.unix_micros("timestamp") - span.low) / F.lit(width)
        for k in arrival:
            df.filter(F.floor(quarter) == k).repartitionByRange(F.col("timestamp")).write.mode("append").parquet(path)
        st.closing_row(df, "100 days").coalesce(1).write.mode("append").parquet(path)

    return p.once(name, write)


def detect_stream(p: Pipeline) -> DataFrame:
    # The columns the stream reads.
    engineered = p.engineered().select(*[c for c in de.EVENT_COLUMNS if c != "previous_resource"])
    path = sliced(p, "stream_engineered", engineered)
    return st.stream_detect(st.read_events(p.spark, path, engineered.schema, CONFIG), p.latest(), config=CONFIG)


def detected(p: Pipeline) -> DataFrame:
    return p.stage("stream_detected", lambda: st.replay(detect_stream(p), "stream_detect"))


COLUMNS = ("event_id", "anomaly_score", "risk_score", "severity", "verdict", *schemas.DEVIATION_COLUMNS)
add("stream_detect", lambda p: detected(p).select(*COLUMNS), "SELECT " + ", ".join(COLUMNS) + " FROM det", "det")
add(
    "stream_reset",
    lambda p: tagged(first=detected(p), second=st.replay(detect_stream(p), "stream_detect")).groupBy("source", "severity").agg(
        F.count("*").alias("events")),
    "SELECT source, severity, count(*) AS events FROM det CROSS JOIN (VALUES ('first'), ('second')) s(source) GROUP BY ALL", "det",
)
add(
    "stream_replay_equivalence",
    lambda p: dq_determinism(p.detection().select(*COLUMNS), detected(p)).agg(F.count("*").alias("differing_rows")).select(
        "differing_rows", detected(p).agg(F.count("*")).scalar().alias("streamed_rows")),
    "SELECT 0 AS differing_rows, count(*) AS streamed_rows FROM det", "det",
)


def features_stream(p: Pipeline) -> DataFrame:
    # Slicing reads its rows a dozen times; the events are a join.
    events = p.stage("stream_source", p.events)
    path = sliced(p, "stream_events", events)
    return st.stream_features(st.read_events(p.spark, path, events.schema, CONFIG), p.entities(), config=CONFIG)


add(
    "stream_features",
    lambda p: st.replay(features_stream(p), "stream_features").select("event_id", *schemas.FEATURE_NAMES),
    "SELECT event_id, " + ", ".join(FEATURE_SQL) + " FROM feat", "feat",
)
