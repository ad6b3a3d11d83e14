"""Durations beyond 32 and 64 bits, unknown ones and outliers: the same numbers in one pass, in blocks and in a stream."""

import random

import numpy as np
import pytest

from accesslens import schemas
from accesslens.operators import profiles as pr
from accesslens.operators.features import _levels, engineer_features
from accesslens.operators.scan import SkewConfig
from accesslens.session import work_path
from accesslens.streaming import stateful as st
from test_features import ENTITIES, event

NAMES = [n for n in schemas.FEATURE_NAMES if "duration" in n]


def streamed(spark, rows, entities, files=2):
    source, schema = work_path(spark, "durations"), schemas.event_schema()
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(source)
    st.closing_row(spark.createDataFrame(rows, schema)).coalesce(1).write.mode("append").parquet(source)
    config = st.StreamConfig(late="1 hour", files=files)
    return st.replay(st.stream_features(st.read_events(spark, source, schema, config), entities, config=config), "durations")


@pytest.mark.parametrize("seconds", [[10, None, 30, 20, 15], [10, 4_000_000_000, 30, 20, 15], [None, None, 7, 2**40, -5, 0, None, 2**40, -(2**45), 2**59, 3, 3]])
def test_unknown_and_huge_durations_agree_everywhere(spark, seconds):
    entities = spark.createDataFrame(ENTITIES, schemas.entity_schema())
    rows = [event(i, minutes=i, seconds=x, resource=[None, "a", "b", "a"][i % 4]) for i, x in enumerate(seconds * 4)]
    events = spark.createDataFrame(rows, schemas.event_schema())
    columns = ["event_id", "session_duration", *schemas.FEATURE_NAMES]
    whole = engineer_features(events, entities).select(*columns)
    blocks = engineer_features(events, entities, skew=SkewConfig(hot_rows=16, block_rows=16)).select(*columns)
    stream = streamed(spark, rows, entities).select(*columns)
    want = whole.collect()
    assert len(want) == len(rows) and all(np.isfinite(r[n]) for r in want for n in NAMES if r[n] is not None)
    for other in (blocks, stream):
        assert whole.exceptAll(other).isEmpty() and other.exceptAll(whole).isEmpty()


def test_an_unknown_duration_counts_nowhere(spark):
    entities = spark.createDataFrame(ENTITIES, schemas.entity_schema())
    rows = [event(i, minutes=i, seconds=x) for i, x in enumerate([10, None, 30, 20, 15])]
    engineered = engineer_features(spark.createDataFrame(rows, schemas.event_schema()), entities)
    found = {r.event_id: r for r in engineered.collect()}
    means = [found[f"e00{i}"].rolling_mean_session_duration for i in range(5)]
    places = [found[f"e00{i}"].historical_percentile_session_duration for i in range(5)]
    assert means == [0.0, 10.0, 10.0, 20.0, 20.0] and places == [50.0, None, 100.0, 50.0, 33.33]
    stats = pr.statistical(engineered).first()
    assert stats.sample_count == 5 and stats.avg_session_duration == 18.75 and stats.session_duration_std == pytest.approx(8.5391)


class Held:
    """State of a processor without a stream; counts what is written."""

    def __init__(self):
        self.maps, self.value, self.writes = {}, None, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.maps.get(key)

    def updateValue(self, key, value):
        self.maps[key] = value
        self.writes += 1


def test_digit_counts_match_sorting_and_write_in_proportion():
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(-20, 20), rng.randrange(10**5), -(2**63), 2**63 - 1]) for _ in range(3000)]
    held = Held()
    counts = st.DigitCounts(held, "x")
    got = [n for lo in range(0, 3000, 250) for n in counts.add(np.array(values[lo : lo + 250], np.int64)).tolist()]
    assert got == [sum(v <= x for v in values[: i // 250 * 250]) for i, x in enumerate(values)]

    many, held = np.random.default_rng(2).permutation(100_000), Held()
    counts = st.DigitCounts(held, "x")
    for lo in range(0, 90_000, 10_000):
        counts.add(many[lo : lo + 10_000])
    held.writes = 0
    last = counts.add(many[90_000:90_100])
    assert held.writes <= 5 * 100 and (last == [(many[:90_000] <= x).sum() for x in many[90_000:90_100]]).all()


def test_limbs_hold_squares_and_sums():
    x = np.array([0, 1, -1, 2**31, -(2**40) + 7, 2**63 - 1, -(2**63)], np.int64)
    limbs = st.square_limbs(x)
    assert [sum(int(limb[i]) << (30 * k) for k, limb in enumerate(limbs)) for i in range(len(x))] == [int(v) ** 2 for v in x]
    words = st._running([5, -3], [x & st.MASK, x >> st.LIMB])
    totals = [int(high) * 2**30 + int(low) for low, high in zip(*words, strict=True)]
    assert totals == [5 - 3 * 2**30 + sum(int(v) for v in x[:i]) for i in range(len(x) + 1)]


def test_passes_do_not_depend_on_an_outlier(spark):
    assert (_levels(1), _levels(16), _levels(17), _levels(2_000_000)) == (1, 1, 2, 6)
    entities = spark.createDataFrame(ENTITIES, schemas.entity_schema())

    def windows(last):
        rows = [event(i, minutes=i, seconds=x) for i, x in enumerate([5, 6, 7, last])]
        plan = engineer_features(spark.createDataFrame(rows, schemas.event_schema()), entities)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Window")

    assert windows(8) == windows(2**40)


def test_late_rows_are_counted_over_all_batches(spark):
    entities, schema = spark.createDataFrame(ENTITIES, schemas.entity_schema()), schemas.event_schema()
    source, base, config = work_path(spark, "counted"), work_path(spark, "counted_out"), st.StreamConfig(late="1 minute", files=1)
    for i, minutes in enumerate([0, 100, 1, 200, 2, 3, 300]):
        spark.createDataFrame([event(i, minutes=minutes)], schema).coalesce(1).write.mode("append").parquet(source)
    query = st.run_available(st.stream_features(st.read_events(spark, source, schema, config), entities, config=config), f"{base}/out", f"{base}/checkpoint")
    # A batch still takes what the watermark of the batch before it has not passed: event 2 is in time, 4 and 5 are not.
    assert st.late_count(query) == 2
