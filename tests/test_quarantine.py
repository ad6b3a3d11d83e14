"""Values that cannot be read, and comparison of runs by fingerprint."""

import pytest
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.operators import quality as qa
from accesslens.sources import readers, sinks
from test_features import event


def test_bad_values_are_reported_not_nulled(spark, tmp_path):
    events = spark.createDataFrame([event(i, minutes=i) for i in range(6)], schemas.event_schema())
    path = sinks.sink_csv(events.coalesce(1), str(tmp_path / "events.csv"))
    lines = [f.read_text() for f in (tmp_path / "events.csv").glob("part-*.csv")][0].splitlines()
    lines[2] = lines[2].replace(",60,", ",abc,")
    lines[3] = lines[3].replace(",60,", ",12.5,").replace("2024-01-01T09:02:00.000000", "no time")
    lines[4] = lines[4].replace(",60,", ",,")
    lines.append("only,three,values")
    broken = tmp_path / "broken.csv"
    broken.mkdir()
    (broken / "part.csv").write_text("\n".join(lines) + "\n")
    good, bad = readers.scan_events_quarantined(spark, str(broken))
    assert {r.event_id: r.session_duration for r in good.collect()} == {"e000": 60, "e003": None, "e004": 60, "e005": 60}
    found = {r["values"].event_id: r for r in bad.collect()}
    assert {k: r.bad_columns for k, r in found.items()} == {"e001": ["session_duration"], "e002": ["timestamp", "session_duration"], "only": found["only"].bad_columns}
    assert found["e001"].line == lines[2] and found["e001"]["values"].session_duration == "abc" and found["e001"].file.endswith("part.csv")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.scan_events(spark, str(broken)).collect()
    assert readers.scan_events(spark, path).count() == 6


def test_equal_runs_move_only_sums(spark):
    first = spark.range(20_000).select(F.concat(F.lit("e"), "id").alias("event_id"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") / 3).alias("y"))
    again = first.unionByName(first.limit(0)).repartition(13).select("y", "event_id", "x")
    assert qa.dq_determinism(first, again).isEmpty()
    plan = qa.dq_determinism(first, again)._jdf.queryExecution().optimizedPlan().toString()
    assert "Except" not in plan and "Aggregate" not in plan
    changed = again.withColumn("x", F.when(F.col("event_id") == "e77", 99).otherwise(F.col("x"))).filter("event_id <> 'e5'")
    found = qa.dq_determinism(first, changed.unionByName(again.filter("event_id = 'e9'")))
    assert sorted(r.subject for r in found.collect()) == ["e5", "e77", "e77", "e9"]
    swapped = first.withColumn("y", F.when(F.col("event_id") == "e1", None).otherwise(F.col("y")))
    assert qa.dq_determinism(first, swapped).count() == 2
