import math
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.operators.features import FeatureConfig, engineer_features
from accesslens.operators.scan import SkewConfig
from accesslens.sources import dims
from accesslens.sources.readers import require_columns

START = datetime(2024, 1, 1, 9, tzinfo=timezone.utc)
ENTITIES = [
    ("u1", "user", "One", "Engineering", "Employee", "standard", "London, United Kingdom", "United Kingdom", "Europe/London",
     8, 17, "0,1,2,3,4", "CRM", "mfa", 1, 1.0, False, "10.0.0.0/8", "business"),
    ("u2", "user", "Two", None, None, "standard", "Sydney, Australia", "Australia", "Australia/Sydney",
     8, 17, "0,1,2,3,4", "CRM", "mfa", 1, 1.0, False, "10.0.0.0/8", "business"),
]


def event(i, entity="u1", minutes=0, geo="London, United Kingdom", resource="CRM", auth="mfa", seconds=60, commands="a|b",
          device="d1", result="success", os=None, mac=None):
    return (f"e{i:03d}", START + timedelta(minutes=minutes), entity, "user", "10.0.0.1", geo, resource, auth, seconds, commands,
            device, result, "", "normal", os, mac)


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, schemas.entity_schema())


def run(spark, entities, rows, config=None, skew=None):
    df = engineer_features(spark.createDataFrame(rows, schemas.event_schema()), entities, config, skew)
    return {r["event_id"]: r for r in df.collect()}


def test_first_event(spark, entities):
    r = run(spark, entities, [event(1)])["e001"]
    assert r["history_length"] == 0 and r["new_entity_flag"] and r["confidence_score"] == 0.0
    assert r["time_since_previous_login_seconds"] == -1.0
    assert r["historical_percentile_session_duration"] == 50.0
    assert r["geo_novelty"] and r["resource_novelty"] and r["fingerprint_mismatch"] and not r["os_novelty"]
    assert not r["country_change"] and r["geo_velocity_kmh"] == 0.0 and r["device_familiarity_score"] == 0.0


def test_equal_timestamps_follow_event_id(spark, entities):
    got = run(spark, entities, [event(2), event(1), event(3, minutes=1)])
    assert [got[f"e00{i}"]["history_length"] for i in (1, 2, 3)] == [0, 1, 2]
    assert [got[f"e00{i}"]["burst_access_score"] for i in (1, 2, 3)] == [0.0, 1.0, 2.0]


def test_burst_edge_is_inclusive(spark, entities):
    got = run(spark, entities, [event(1), event(2, minutes=5), event(3, minutes=10.0001)])
    assert got["e002"]["burst_access_score"] == 1.0 and got["e003"]["burst_access_score"] == 0.0


def test_no_spread_means_no_zscore(spark, entities):
    got = run(spark, entities, [event(i, minutes=i) for i in range(3)] + [event(9, minutes=9, seconds=500)])
    assert got["e009"]["session_duration_zscore"] == 0.0 and got["e009"]["rolling_std_session_duration"] == 0.0


def test_blank_commands(spark, entities):
    r = run(spark, entities, [event(1, commands="")])["e001"]
    assert r["command_sequence_complexity"] == 0.0 and r["session_entropy"] == 0.0


def test_unknown_entity_uses_utc(spark, entities):
    r = run(spark, entities, [event(1, entity="ghost", minutes=-8 * 60)])["e001"]
    assert r["login_hour"] == 1 and r["working_hours_deviation"] == 0.0 and not r["privilege_change_indicator"]


def test_local_hours(spark, entities):
    r = run(spark, entities, [event(1, entity="u2")])["e001"]
    assert r["login_hour"] == 20 and r["working_hours_deviation"] == 3.0


def test_privilege_needs_a_department(spark, entities):
    got = run(spark, entities, [event(1, resource="SIEM Console"), event(2, entity="u2", resource="SIEM Console")])
    assert got["e001"]["privilege_change_indicator"] and not got["e002"]["privilege_change_indicator"]
    assert got["e001"]["sensitive_resource_access"]


def test_unmapped_city_has_no_speed(spark, entities):
    got = run(spark, entities, [event(1), event(2, minutes=10, geo="Atlantis, Sea"), event(3, minutes=60, geo="New York, USA"),
                                event(4, minutes=120, geo="London, United Kingdom")])
    assert got["e002"]["geo_velocity_kmh"] == 0.0 and got["e002"]["country_change"]
    assert got["e003"]["geo_velocity_kmh"] == 0.0
    assert got["e004"]["geo_velocity_kmh"] > 5000 and not got["e004"]["geo_novelty"]


def test_streak_is_broken_by_success(spark, entities):
    results = ["failure", "failure", "success", "failure", "failure"]
    got = run(spark, entities, [event(i, minutes=i, result=r) for i, r in enumerate(results)])
    assert [got[f"e00{i}"]["consecutive_failures"] for i in range(5)] == [0, 1, 2, 0, 1]


def test_missing_columns_are_named(spark, entities):
    with pytest.raises(ValueError, match="login_result"):
        require_columns(spark.createDataFrame([event(1)], schemas.event_schema()).drop("login_result"), schemas.REQUIRED_EVENT_COLUMNS)


# ---- every feature against its definition, evaluated over the list of earlier events ----


def half_up(v, dp):
    return math.floor(v * 10**dp + 0.5) / 10**dp


def by_definition(now, past, who):
    h = len(past)
    share = lambda n: half_up(n / h, 4) if h else 0.0
    zone = ZoneInfo(who["timezone"]) if who else timezone.utc
    local = now["timestamp"].replace(tzinfo=timezone.utc).astimezone(zone)
    xs, x = [p["session_duration"] for p in past], now["session_duration"]
    mean = sum(xs) / h if h else 0.0
    sd = math.sqrt(sum((v - mean) ** 2 for v in xs) / (h - 1)) if h > 1 else 0.0
    trail = [p["resource_accessed"] for p in past]
    recent, older = set(trail[-10:]), set(trail[:-10])
    failures = 0
    for p in reversed(past):
        if p["login_result"] == "success":
            break
        failures += 1
    window = now["timestamp"] - timedelta(minutes=5)
    out = {
        "history_length": h, "login_hour": local.hour, "day_of_week": local.weekday(), "consecutive_failures": failures,
        "success_ratio": share(sum(p["login_result"] == "success" for p in past)),
        "mfa_usage_frequency": share(sum(p["auth_method"] == "mfa" for p in past)),
        "device_familiarity_score": share(sum(p["device_fingerprint"] == now["device_fingerprint"] for p in past)),
        "resource_diversity": share(len(set(trail))),
        "city_change_frequency": share(sum(a["geo_location"] != b["geo_location"] for a, b in zip(past, past[1:]))),
        "resource_novelty": now["resource_accessed"] not in trail,
        "os_novelty": now["device_os"] is not None and now["device_os"] not in {p["device_os"] for p in past},
        "behaviour_drift_score": half_up(len(recent - older) / len(recent), 4) if recent else 0.0,
        "burst_access_score": float(sum(p["timestamp"] >= window for p in past)),
        "moving_avg_session_duration": half_up(sum(xs[-5:]) / len(xs[-5:]), 2) if xs else 0.0,
        "historical_percentile_session_duration": half_up(100.0 * sum(v <= x for v in xs) / h, 2) if h else 50.0,
        "rolling_mean_session_duration": half_up(mean, 2),
        "previous_resource": trail[-1] if trail else None,
    }
    loose = {"rolling_std_session_duration": (sd, 0.011), "session_duration_zscore": ((x - mean) / sd if sd else 0.0, 0.00011)}
    return out, loose


@pytest.mark.parametrize("skew", [None, SkewConfig(hot_rows=40, block_rows=16, salts=3)], ids=["whole", "blocks"])
def test_features_by_definition(spark, pipeline, skew):
    rows = [r.asDict() for r in engineer_features(pipeline.events(), pipeline.entities(), skew=skew).collect()]
    people = {r["entity_id"]: r for r in pipeline.entities().collect()}
    histories = {}
    assert len(rows) == 1000
    for row in sorted(rows, key=lambda r: (r["entity_id"], r["timestamp"], r["event_id"])):
        past = histories.setdefault(row["entity_id"], [])
        exact, loose = by_definition(row, past, people.get(row["entity_id"]))
        for name, want in exact.items():
            assert row[name] == want, (row["event_id"], name)
        for name, (want, tolerance) in loose.items():
            assert abs(row[name] - want) <= tolerance, (row["event_id"], name)
        past.append(row)


def test_blocked_run_equals_whole_run(spark, pipeline):
    whole = engineer_features(pipeline.events(), pipeline.entities(), FeatureConfig(burst_window_minutes=1440))
    blocks = engineer_features(
        pipeline.events(), pipeline.entities(), FeatureConfig(burst_window_minutes=1440), SkewConfig(hot_rows=40, block_rows=16, salts=3))
    blocks = blocks.select(*whole.columns)
    assert whole.exceptAll(blocks).isEmpty() and blocks.exceptAll(whole).isEmpty()


def test_registry_is_complete():
    assert len(schemas.FEATURE_NAMES) == 33 and len(set(schemas.FEATURE_NAMES)) == 33
    assert len(dims.ATTACKS) == 8


def test_one_exchange_serves_all_windows(spark, pipeline):
    df = engineer_features(pipeline.events(), pipeline.entities()).select("event_id", *schemas.FEATURE_NAMES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity_id") == 1
    assert "Window" in plan and F is not None
