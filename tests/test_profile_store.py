"""The profile store: a log of builds and a snapshot of the newest versions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from accesslens.operators import profiles as pr
from accesslens.session import remove


@pytest.fixture(scope="module")
def builds(pipeline):
    engineered, entities = pipeline.engineered(), pipeline.entities()
    some = entities.filter("entity_id < 'USR-000020' OR department IS NULL")
    first = pr.build_profiles(engineered, entities, datetime(2024, 1, 10))
    second = pr.build_profiles(engineered.join(some, "entity_id", "left_semi"), some, datetime(2024, 1, 20), first)
    return first, second, some.select("entity_id")


def test_latest_reads_the_snapshot_of_the_last_build_only(pipeline, builds, tmp_path):
    spark, path, (first, second, some) = pipeline.spark, str(tmp_path / "store"), builds
    pr.sink_profiles_append(first, path)
    pr.sink_profiles_append(second, path)
    latest = pr.scan_profiles_latest(pr.scan_store(spark, path))
    for part in (*latest.parts().values(), latest.departments):
        assert all(f"/latest/build={second.build}/" in f for f in part.inputFiles())
        assert "Join" not in part._jdf.queryExecution().optimizedPlan().toString()
    held, every = some.count(), first.core.count()
    assert 0 < held < every
    versions = {r.version: r["count"] for r in latest.core.groupBy("version").count().collect()}
    assert versions == {1: every - held, 2: held}
    # The same as the newest version among all stored ones.
    store = pr.scan_store(spark, path)
    found = pr.scan_profiles_latest(pr.Profiles(*store.parts().values()))
    for name, part in latest.parts().items():
        columns = [F.to_json(c).alias(c) if c == "drifted_dimensions" else c for c in sorted(part.columns)]
        a, b = part.select(*columns), found.parts()[name].select(*columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_an_append_reads_no_earlier_build(pipeline, builds, tmp_path):
    spark, path, (first, second, _) = pipeline.spark, str(tmp_path / "store"), builds
    pr.sink_profiles_append(first, path)
    for name in pr.STORE_DDL:
        remove(spark, f"{path}/builds/{name}/build={first.build}")
    pr.sink_profiles_append(second, path)
    assert pr.scan_snapshot(spark, path, second.build).core.count() == first.core.count()
    assert pr.commits(spark, path) == [first.build, second.build]


def test_a_build_without_commit_is_not_seen(pipeline, builds, tmp_path):
    spark, path, (first, second, _) = pipeline.spark, str(tmp_path / "store"), builds
    pr.sink_profiles_append(first, path)
    second.values.write.partitionBy("version").parquet(f"{path}/builds/values/build={second.build}")
    assert pr.scan_store(spark, path).values.filter("version = 2").isEmpty()
    with pytest.raises(FileNotFoundError):
        pr.scan_store(spark, str(tmp_path / "none"))


def test_every_profile_has_the_common_resources_of_its_department(pipeline, builds, tmp_path):
    spark, path, (first, second, _) = pipeline.spark, str(tmp_path / "store"), builds
    pr.sink_profiles_append(first, path)
    pr.sink_profiles_append(second, path)
    store = pr.scan_store(spark, path)
    for profiles in (store, pr.scan_profiles_latest(store)):
        rows = pr.department_common_resources(profiles)
        wanted = profiles.core.filter("department IS NOT NULL AND sample_count > 0").select("entity_id", "version")
        assert wanted.join(rows, ["entity_id", "version"], "left_anti").isEmpty()
    index = {(r.department, r["rank"]): r.resource for r in first.departments.collect()}
    ones = pr.department_common_resources(store).filter("version = 1").collect()
    assert ones and all(index[r.department, r["rank"]] == r.resource for r in ones)
