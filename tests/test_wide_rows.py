import re
from datetime import datetime

from accesslens.operators import features as fe
from accesslens.operators import profiles as pr


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_windows_carry_what_they_do_not_read_as_one_column(spark, pipeline):
    tree = plan(fe.engineer_features(pipeline.events(), pipeline.entities()))
    assert "Window" in tree
    lowest = tree[tree.rindex("Window ["):]
    packed = re.search(r"Project \[(.*)\]", lowest).group(1)
    assert "_rest" in packed
    outside = re.sub(r"(named_)?struct\(.*?\) AS _rest#\d+", "", packed)
    assert "command_sequence" not in outside and "risk_context" not in outside


def test_small_partitions_are_joined_without_sorting(spark, pipeline):
    left = spark.range(300_000).selectExpr("id % 1000 AS k", "id AS v")
    right = spark.range(300_000).selectExpr("id AS k", "concat('name', id) AS w")
    joined = left.join(right, "k", "left")
    assert len(joined.collect()) == 300_000
    tree = plan(joined, "executedPlan")
    assert "ShuffledHashJoin" in tree and "SortMergeJoin" not in tree.split("Initial Plan")[0]


def test_moments_are_not_summed_by_day(spark):
    rows = [
        ("a", datetime(2024, 1, 1, 9), 9, 10), ("a", datetime(2024, 1, 1, 11), 11, 30), ("a", datetime(2024, 1, 3, 10), 10, None),
        (None, datetime(2024, 1, 1, 9), 9, 5), (None, datetime(2024, 1, 2, 9), 9, 7), ("b", None, None, 1),
    ]
    df = spark.createDataFrame(rows, "entity_id string, timestamp timestamp, login_hour int, session_duration long").selectExpr(
        "*", "'failure' AS login_result", "0.0D AS working_hours_deviation")
    found = pr.statistical(df)
    assert not any("day" in line and "sum(" in line for line in plan(found).split("\n") if "Aggregate" in line)
    got = {r.entity_id: (r.sample_count, r.avg_login_hour, r.avg_session_duration, r.authentication_frequency_per_day) for r in found.collect()}
    assert got == {"a": (3, 10.0, 20.0, 1.5), None: (2, 9.0, 6.0, 1.0), "b": (1, None, 1.0, 1.0)}
