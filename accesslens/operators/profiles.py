"""Versioned behaviour profiles, kept as long tables keyed by entity and version."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accesslens.functions.numeric import cosine_gap, ratio, round_dp, sample_std, scaled
from accesslens.functions.text import blank_to_null, split_list
from accesslens.operators.scan import SkewConfig, hot_keys, ranked, with_context
from accesslens.session import listing, remove, written

KEY = "entity_id"
SHARE_DP = 4
# kind of value -> event column
VALUE_KINDS = {"resource": "resource_accessed", "device": "device_fingerprint", "location": "geo_location"}


@dataclass(frozen=True)
class ProfileConfig:
    confidence_saturation: int = 50
    insufficient_below: int = 5
    adaptation_window_days: int = 30  # recorded with the profile; it filters nothing
    drift_significance: float = 0.35
    top_sequences: int = 5
    top_department_resources: int = 10


@dataclass(frozen=True)
class Profiles:
    """One build or a selection from the store.

    core         one row per entity: statistics, relationship, drift and cold-start fields
    values       entity × (resource, device, location) value with its share
    transitions  entity × (command, resource) state pair with its probability
    sequences    the entity's most frequent resource trigrams
    departments  the common resources of each department at the time of a build
    build        name of the build, from its time
    snapshot     of a store: the newest version of each entity, kept apart
    """

    core: DataFrame
    values: DataFrame
    transitions: DataFrame
    sequences: DataFrame
    departments: DataFrame | None = None
    build: str | None = None
    snapshot: Profiles | None = None

    def parts(self) -> dict[str, DataFrame]:
        """What is kept by entity and version."""
        return {
            "core": self.core, "values": self.values, "transitions": self.transitions, "sequences": self.sequences,
        }


def filter_normal(events: DataFrame) -> DataFrame:
    """Drop attack rows by ``is_attack``, else by ``label``, else keep everything."""
    if "is_attack" in events.columns:
        return events.filter(~F.coalesce("is_attack", F.lit(False)))
    if "label" in events.columns:
        return events.filter(F.coalesce("label", F.lit("")) != "attack")
    return events


def value_frequency(normal: DataFrame) -> DataFrame:
    """How often, and with which share, an entity uses each resource, device and location."""
    pairs = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value")) for kind, column in VALUE_KINDS.items()]
    )
    uses = (
        normal.select(KEY, F.explode(pairs).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .groupBy(KEY, F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("uses"))
    )
    return with_share(uses, [KEY, "kind"], "share")


def with_share(uses: DataFrame, group: list[str], name: str) -> DataFrame:
    """``uses`` as a share of its group's total.

    The total is joined back instead of windowed, because one entity may have any
    number of distinct values: partial sums and a skew join have no hot task.
    """
    total = uses.groupBy(*group).agg(F.sum("uses").alias("_total"))
    return uses.join(total, group).withColumn(name, ratio(F.col("uses"), F.col("_total"), SHARE_DP)).drop("_total")


def statistical(normal: DataFrame) -> DataFrame:
    """Counts, moments and rates per entity; its days are counted apart, so that no sums are kept by day."""
    # Wide before they are multiplied: one bogus duration must not overflow. An unknown one counts nowhere.
    hour, x = F.col("login_hour").cast("long"), F.col("session_duration").cast("decimal(19,0)")
    moments = normal.groupBy(KEY).agg(
        F.count("*").alias("n"),
        F.sum(hour).alias("h"), F.sum((hour * hour).cast("decimal(38,0)")).alias("hh"),
        F.count(x).alias("known"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"),
        F.count_if(F.col("login_result") == "failure").alias("failures"),
        F.count_if(F.col("working_hours_deviation") == 0.0).alias("inside"),
    )
    daily = normal.select(F.col(KEY).alias("_of"), F.to_date("timestamp").alias("day")).distinct()
    days = daily.groupBy("_of").agg(F.count("day").alias("days"))
    sums = moments.join(days, F.col(KEY).eqNullSafe(F.col("_of")))
    n = F.col("n")
    return sums.select(
        KEY,
        n.alias("sample_count"),
        ratio(F.col("h"), n, 4).alias("avg_login_hour"),
        round_dp(sample_std(n, F.col("h"), F.col("hh")), 4).alias("login_hour_std"),
        ratio(F.col("x").cast("double"), F.col("known"), 4).alias("avg_session_duration"),
        round_dp(sample_std(F.col("known"), F.col("x"), F.col("xx")), 4).alias("session_duration_std"),
        ratio(n, F.greatest(F.col("days"), F.lit(1)), 4).alias("authentication_frequency_per_day"),
        ratio(F.col("failures"), n, 4).alias("failure_rate"),
        ratio(F.col("inside"), n, 4).alias("working_hour_ratio"),
    )


STATISTICS = (
    "avg_login_hour", "login_hour_std", "avg_session_duration", "session_duration_std",
    "authentication_frequency_per_day", "failure_rate", "working_hour_ratio",
)


def resource_steps(normal: DataFrame, skew: SkewConfig) -> DataFrame:
    """How often an entity goes from one resource to a second and a third (null at the end of its history)."""
    order = ["timestamp", "event_id"]
    rows = normal.select(KEY, "timestamp", "event_id", "resource_accessed")
    hot = hot_keys(rows, KEY, skew)
    if hot is None:
        part, rows = [KEY], rows.withColumn("_copy", F.lit(False))
    else:
        part = [KEY, "_block"]
        rows = with_context(ranked(rows, KEY, order, skew, hot), "_rn", skew, after=2).repartition(*part)
    at = Window.partitionBy(*part).orderBy(*order)
    following = rows.select(
        KEY,
        "_copy",
        F.col("resource_accessed").alias("first"),
        F.lead("resource_accessed", 1).over(at).alias("second"),
        F.lead("resource_accessed", 2).over(at).alias("third"),
    ).filter(~F.col("_copy"))
    return following.groupBy(KEY, "first", "second", "third").agg(F.count("*").alias("uses"))


def _probabilities(pairs: DataFrame, kind: str) -> DataFrame:
    uses = pairs.groupBy(KEY, "from_state", "to_state").agg(F.sum("n").alias("uses"))
    return with_share(uses, [KEY, "from_state"], "probability").select(
        KEY, F.lit(kind).alias("kind"), "from_state", "to_state", "uses", "probability"
    )


def command_transitions(normal: DataFrame) -> DataFrame:
    """First-order transitions inside each event's command list."""
    commands = split_list(F.col("command_sequence"))
    steps = F.transform(
        F.slice(commands, 2, F.greatest(F.size(commands), F.lit(1))),
        lambda to, i: F.struct(F.element_at(commands, i + 1).alias("from_state"), to.alias("to_state")),
    )
    return _probabilities(normal.select(KEY, F.explode(steps).alias("s"), F.lit(1).alias("n")).select(KEY, "s.*", "n"), "command")


def resource_transitions(steps: DataFrame) -> DataFrame:
    pairs = steps.filter(F.col("second").isNotNull()).select(
        KEY, F.col("first").alias("from_state"), F.col("second").alias("to_state"), F.col("uses").alias("n")
    )
    return _probabilities(pairs, "resource")


def common_sequences(steps: DataFrame, top: int) -> DataFrame:
    """The most frequent resource trigrams per entity, ties in text order."""
    best = Window.partitionBy(KEY).orderBy(F.desc("uses"), "first", "second", "third")
    complete = steps.filter(F.col("third").isNotNull())
    return complete.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def department_index(values: DataFrame, entities: DataFrame, top: int) -> DataFrame:
    """The most common resources per department, from per-entity counts."""
    departments = entities.select(KEY, blank_to_null(F.col("department")).alias("department")).filter(
        F.col("department").isNotNull()
    )
    uses = (
        values.filter(F.col("kind") == "resource")
        .join(departments, KEY)
        .groupBy("department", F.col("value").alias("resource"))
        .agg(F.sum("uses").alias("uses"))
    )
    best = Window.partitionBy("department").orderBy(F.desc("uses"), "resource")
    return uses.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def resource_sharing(values: DataFrame, entities: DataFrame, index: DataFrame) -> DataFrame:
    """Jaccard similarity of an entity's resources with its department's common ones."""
    own = values.filter(F.col("kind") == "resource").select(KEY, F.col("value").alias("resource"))
    departments = entities.select(KEY, blank_to_null(F.col("department")).alias("department"))
    peers = index.groupBy("department").agg(F.count("*").alias("peers"))
    common = index.select("department", "resource", F.lit(1).alias("hit"))
    counts = (
        own.join(departments, KEY)
        .join(common, ["department", "resource"], "left")
        .groupBy(KEY, "department")
        .agg(F.count("*").alias("own"), F.count("hit").alias("shared"))
        .join(peers, "department")
    )
    return counts.select(
        KEY,
        ratio(F.col("shared"), F.col("own") + F.col("peers") - F.col("shared"), 4).alias("resource_sharing_score"),
    )


def set_difference_resources(events: DataFrame, since: Column) -> DataFrame:
    """Recent resources minus baseline: what an entity used at or after ``since`` and never before, one row each."""
    first = events.groupBy(KEY, F.col("resource_accessed").alias("resource")).agg(F.min("timestamp").alias("first"))
    return first.filter(F.col("first") >= since).select(KEY, "resource")


def frequency_distances(before: DataFrame, now: DataFrame) -> DataFrame:
    """Cosine distance per entity between two value tables, one column per kind."""
    old = before.select(KEY, "kind", "value", scaled(F.col("share"), SHARE_DP).alias("a"))
    new = now.select(KEY, "kind", "value", scaled(F.col("share"), SHARE_DP).alias("b"))
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    sums = (
        old.join(new, [KEY, "kind", "value"], "full")
        .groupBy(KEY, "kind")
        .agg(F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    )
    gap = cosine_gap(F.col("ab").cast("double"), F.sqrt(F.col("aa").cast("double")), F.sqrt(F.col("bb").cast("double")))
    return sums.groupBy(KEY).agg(
        *[F.coalesce(F.max(F.when(F.col("kind") == kind, gap)), F.lit(0.0)).alias(f"gap_{kind}") for kind in VALUE_KINDS]
    )


def drift_columns(config: ProfileConfig) -> dict[str, Column]:
    """Drift of the current statistics against the stored ones (prefixed ``was_``); 0 on a first version."""
    c = F.col
    gaps = {
        "resource_frequency": c("gap_resource"),
        "device_frequency": c("gap_device"),
        "geo_frequency": c("gap_location"),
        "login_hour": F.least(F.lit(1.0), F.abs(c("was_avg_login_hour") - c("avg_login_hour")) / F.lit(12.0)),
        "failure_rate": F.least(F.lit(1.0), F.abs(c("was_failure_rate") - c("failure_rate"))),
    }
    compared = F.coalesce(c("was_sample_count") > 0, F.lit(False))
    total = sum(gaps.values(), F.lit(0.0))
    score = F.when(compared, round_dp(total / F.lit(5.0), 4)).otherwise(0.0)
    names = F.filter(
        F.array(*[F.when(compared & (gaps[n] >= config.drift_significance), F.lit(n)) for n in sorted(gaps)]),
        lambda n: n.isNotNull(),
    )
    return {
        "drift_score": score,
        "drifted_dimensions": names,
        "is_significant_drift": score >= config.drift_significance,
        "historical_sample_count": F.when(compared, c("was_sample_count")).otherwise(F.lit(0).cast("long")),
    }


def cold_start_columns(n: Column, config: ProfileConfig) -> dict[str, Column]:
    return {
        "is_new_entity": n <= 0,
        "confidence_score": F.when(n <= 0, 0.0).otherwise(
            round_dp(F.least(F.lit(1.0), n / F.lit(float(config.confidence_saturation))), 4)
        ),
        "warmup_strategy": F.when(n < config.insufficient_below, "insufficient_data")
        .when(n < config.confidence_saturation, "warming_up")
        .otherwise("established"),
    }


def build_profiles(
    events: DataFrame,
    entities: DataFrame,
    now: datetime,
    previous: Profiles | None = None,
    config: ProfileConfig | None = None,
    skew: SkewConfig | None = None,
) -> Profiles:
    """Profiles of every known entity, with or without events, from its normal events.

    The value table and the resource steps, which several parts need, are written once.
    """
    config, skew = config or ProfileConfig(), skew or SkewConfig()
    normal = filter_normal(events)
    values = written(value_frequency(normal), "values")
    steps = written(resource_steps(normal, skew), "steps")
    index = department_index(values, entities, config.top_department_resources)
    sharing = resource_sharing(values, entities, index)

    core = (
        entities.select(KEY, "entity_type", blank_to_null(F.col("department")).alias("department"))
        .join(statistical(normal), KEY, "left")
        .join(sharing, KEY, "left")
        .fillna(0.0, [*STATISTICS, "resource_sharing_score"])
        .fillna(0, ["sample_count"])
    )
    if previous is None:
        core = core.select(
            "*",
            F.lit(None).cast("int").alias("was_version"),
            F.lit(None).cast("timestamp").alias("was_created_at"),
            *[F.lit(None).cast(t).alias(f"was_{c}") for c, t in
              (("sample_count", "long"), ("avg_login_hour", "double"), ("failure_rate", "double"))],
            *[F.lit(0.0).alias(f"gap_{kind}") for kind in VALUE_KINDS],
        )
    else:
        was = previous.core.select(
            KEY,
            *[F.col(c).alias(f"was_{c}") for c in ("version", "created_at", "sample_count", "avg_login_hour", "failure_rate")],
        )
        core = core.join(was, KEY, "left").join(frequency_distances(previous.values, values), KEY, "left").fillna(
            0.0, [f"gap_{kind}" for kind in VALUE_KINDS]
        )
    stamp = F.lit(now).cast("timestamp")
    core = core.select(
        KEY,
        "entity_type",
        (F.coalesce("was_version", F.lit(0)) + 1).cast("int").alias("version"),
        F.coalesce("was_created_at", stamp).alias("created_at"),
        stamp.alias("updated_at"),
        "sample_count",
        *STATISTICS,
        "department",
        "resource_sharing_score",
        *[value.alias(name) for name, value in drift_columns(config).items()],
        F.col("sample_count").alias("current_sample_count"),
        F.lit(config.adaptation_window_days).alias("adaptation_window_days"),
        F.col("sample_count").alias("history_length"),
        *[value.alias(name) for name, value in cold_start_columns(F.col("sample_count"), config).items()],
    )
    versions = entities.select(KEY, F.lit(1).alias("version"))
    if previous is not None:
        was = previous.core.select(KEY, F.col("version").alias("was_version"))
        versions = versions.join(was, KEY, "left").select(KEY, (F.coalesce("was_version", F.lit(0)) + 1).alias("version"))
    transitions = command_transitions(normal).unionByName(resource_transitions(steps))
    return Profiles(
        core,
        values.join(versions, KEY),
        transitions.join(versions, KEY),
        common_sequences(steps, config.top_sequences).join(versions, KEY),
        index.select("department", "resource", "uses", "rank", stamp.alias("updated_at")),
        str(round(now.timestamp() * 1_000_000)),
    )


# ---- the store: a log of builds, and a snapshot of the newest versions ----
#
#   builds/<part>/build=<name>/version=<n>/   what a build holds; never changed afterwards
#   latest/build=<name>/<part>/               the newest version of every entity after that build
#   commits/<name>/                           one row (number, build), written last: the build counts from then on

STORE_DDL = {
    "core": "entity_id string, entity_type string, created_at timestamp, updated_at timestamp, sample_count bigint, "
    + ", ".join(f"{c} double" for c in STATISTICS)
    + ", department string, resource_sharing_score double, drift_score double, drifted_dimensions array<string>, "
    "is_significant_drift boolean, historical_sample_count bigint, current_sample_count bigint, "
    "adaptation_window_days int, history_length bigint, is_new_entity boolean, confidence_score double, "
    "warmup_strategy string, version int",
    "values": "entity_id string, kind string, value string, uses bigint, share double, version int",
    "transitions": "entity_id string, kind string, from_state string, to_state string, uses bigint, "
    "probability double, version int",
    "sequences": "entity_id string, first string, second string, third string, uses bigint, rank int, version int",
    "departments": "department string, resource string, uses bigint, rank int, updated_at timestamp",
}


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the builds a store holds, oldest first; one row each."""
    if not listing(spark, f"{path}/commits"):
        return []
    rows = spark.read.schema("number int, build string").option("recursiveFileLookup", True).parquet(f"{path}/commits")
    return [r.build for r in sorted(rows.collect(), key=lambda r: r.number)]


def sink_profiles_append(profiles: Profiles, path: str, build: str | None = None, keep: int = 2) -> str:
    """Append a build; earlier versions stay as they are, and no row of an earlier build is read for it.

    A build has a name (its time, unless given). One that is committed is not written again; one that broke off
    is overwritten. The newest versions are the build's own and, of entities it does not hold, those of the
    snapshot before; of older snapshots the last ``keep`` stay, for readers that still use them. One writer at a time.
    """
    spark = profiles.core.sparkSession
    build = build or profiles.build or str(profiles.core.agg(F.max(F.unix_micros("updated_at"))).first()[0] or 0)
    done = commits(spark, path)
    if build in done:
        return path
    departments = profiles.departments
    if departments is None:
        departments = spark.createDataFrame([], STORE_DDL["departments"])
    for name, part in (profiles.parts() | {"departments": departments}).items():
        writer = part.write.mode("overwrite")
        (writer if name == "departments" else writer.partitionBy("version")).parquet(f"{path}/builds/{name}/build={build}")
    own = {name: spark.read.schema(ddl).parquet(f"{path}/builds/{name}/build={build}") for name, ddl in STORE_DDL.items()}
    before = scan_snapshot(spark, path, done[-1]) if done else None
    for name, rows in own.items():
        if before is not None:
            rows = _carried_over(before, name, own["core"].select(KEY)).unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{path}/latest/build={build}/{name}")
    spark.createDataFrame([(len(done) + 1, build)], "number int, build string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{build}")
    for old in done[: max(0, len(done) + 1 - keep)]:
        remove(spark, f"{path}/latest/build={old}")
    return path


def _carried_over(before: Profiles, name: str, mine: DataFrame) -> DataFrame:
    """Rows of a snapshot that belong to entities a new build does not hold."""
    if name != "departments":
        return before.parts()[name].join(mine, KEY, "left_anti")
    used = before.core.join(mine, KEY, "left_anti").select("updated_at").distinct()
    return before.departments.join(used, "updated_at", "left_semi")


def scan_snapshot(spark: SparkSession, path: str, build: str) -> Profiles:
    """The newest version of each entity after a build."""
    parts = {name: spark.read.schema(ddl).parquet(f"{path}/latest/build={build}/{name}") for name, ddl in STORE_DDL.items()}
    return Profiles(**parts, build=build)


def scan_store(spark: SparkSession, path: str) -> Profiles:
    """Every stored version."""
    done = commits(spark, path)
    if not done:
        raise FileNotFoundError(f"no profile build in {path}")

    def of(name: str) -> DataFrame:
        rows = spark.read.schema(f"{STORE_DDL[name]}, build string").parquet(f"{path}/builds/{name}")
        return rows.filter(F.col("build").isin(done)).drop("build")

    return Profiles(**{name: of(name) for name in STORE_DDL}, snapshot=scan_snapshot(spark, path, done[-1]))


def scan_profiles_latest(store: Profiles) -> Profiles:
    """The newest version of each entity: a store keeps it apart, of other rows it is found."""
    if store.snapshot is not None:
        return store.snapshot
    newest = store.core.groupBy(KEY).agg(F.max("version").alias("version"))
    return Profiles(*[part.join(newest, [KEY, "version"]) for part in store.parts().values()], store.departments)


def department_common_resources(profiles: Profiles) -> DataFrame:
    """For every profile, the resources common in its department when it was built: one row each, by rank."""
    at = profiles.core.select(KEY, "version", "department", "updated_at")
    return at.join(profiles.departments, ["department", "updated_at"]).select(KEY, "version", "department", "resource", "uses", "rank")


def relationship(profiles: Profiles) -> DataFrame:
    """Per entity: its department with the resources common there, how much it shares of them, and how many values it uses itself."""
    used = profiles.values.groupBy(KEY).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in VALUE_KINDS])
    common = department_common_resources(profiles).groupBy(KEY, "version").agg(F.array_sort(F.collect_list(F.struct("rank", "resource"))).alias("common"))
    named = F.coalesce(F.transform("common", lambda r: r["resource"]), F.array().cast("array<string>"))
    core = profiles.core.select(KEY, "version", F.coalesce("department", F.lit("-")).alias("department"), "resource_sharing_score")
    return core.join(used, KEY).join(common, [KEY, "version"], "left").select(
        KEY, "department", "resource_sharing_score", *[f"{k}s" for k in VALUE_KINDS], named.alias("department_common_resources"))


def scan_profile_history(store: Profiles) -> DataFrame:
    """Per entity, its versions in order with their drift and sample counts."""
    entry = F.struct("version", "drift_score", "sample_count")
    return store.core.groupBy(KEY).agg(F.array_sort(F.collect_list(entry)).alias("history"))


def previous_version(store: Profiles) -> DataFrame:
    """The newest and the next older version of each entity that has two."""
    newest = store.core.groupBy(KEY).agg(F.max("version").alias("version"))
    older = store.core.select(KEY, F.col("version").alias("_old")).join(newest, KEY).filter(F.col("_old") < F.col("version"))
    return older.groupBy(KEY, "version").agg(F.max("_old").alias("previous_version"))


def list_profiled_entities(store: Profiles) -> DataFrame:
    return store.core.select(KEY).distinct().orderBy(KEY)


def profile_drift_trend(store: Profiles) -> DataFrame:
    """Drift and sample counts by version, and whether drift rose from the first to the last."""
    history = scan_profile_history(store)
    trend = F.transform("history", lambda v: v["drift_score"])
    return history.select(  # the trend itself is the feature, one number per build
        KEY,
        F.size("history").alias("profile_version_count"),
        trend.alias("drift_score_trend"),
        F.transform("history", lambda v: v["sample_count"]).alias("sample_count_trend"),
        ((F.size("history") >= 2) & (F.element_at(trend, -1) > F.element_at(trend, 1))).alias("drift_rising"),
    )


def profile_summary(core: DataFrame) -> DataFrame:
    """The flat 15-column profile table."""
    return core.select(
        KEY, "entity_type", "version", "sample_count", "avg_login_hour", "avg_session_duration", "failure_rate",
        "working_hour_ratio", "department", "resource_sharing_score", "drift_score", "is_significant_drift",
        "history_length", "confidence_score", "warmup_strategy",
    )


def behaviour_summary(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Entity attributes with event counts, modes (ties to the smallest value), rates and span."""
    hour = F.hour("timestamp")
    cells = events.groupBy(KEY, "resource_accessed", "device_fingerprint", hour.alias("hour")).agg(
        F.count("*").alias("n"),
        F.count_if(F.weekday("timestamp") >= 5).alias("weekend"),
        F.count_if(F.col("login_result") == "failure").alias("failures"),
        F.sum(F.col("session_duration").cast("decimal(19,0)")).alias("seconds"),
        F.count("session_duration").alias("known"),
        F.min("timestamp").alias("first_event_at"),
        F.max("timestamp").alias("last_event_at"),
    )
    cells = written(cells, "cells")  # the one pass over the events; all below reads the cells

    def mode(column: str, name: str) -> DataFrame:
        counts = cells.groupBy(KEY, column).agg(F.sum("n").alias("n"))
        return counts.groupBy(KEY).agg(
            F.min_by(column, F.struct((-F.col("n")).alias("n"), F.col(column))).alias(name),
            F.count("*").alias(f"distinct_{column}"),
        )

    summary = cells.groupBy(KEY).agg(
        F.sum("n").alias("total_events"), F.sum("weekend").alias("weekend"), F.sum("failures").alias("failures"),
        F.sum("seconds").alias("seconds"), F.sum("known").alias("known"), F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
    )
    span = cells.agg(
        F.greatest(
            F.floor((F.unix_micros(F.max("last_event_at")) - F.unix_micros(F.min("first_event_at"))) / F.lit(86_400_000_000)),
            F.lit(1),
        ).alias("days")
    ).scalar()
    devices = cells.select(KEY, "device_fingerprint").distinct().groupBy(KEY).agg(F.count("*").alias("devices"))
    joined = (
        summary.join(mode("resource_accessed", "top_resource"), KEY).join(mode("hour", "most_common_hour"), KEY).join(devices, KEY)
    )
    n = F.col("total_events")
    return entities.select(KEY, "entity_type", "department", "role", "privilege_level", "is_remote").join(
        joined.select(
            KEY, n, F.col("distinct_resource_accessed").alias("unique_resources_used"), "top_resource",
            F.col("devices").alias("unique_devices_used"), "most_common_hour",
            ratio(F.col("weekend"), n, 6).alias("weekend_event_ratio"),
            ratio(F.col("failures"), n, 6).alias("login_failure_rate"),
            ratio(F.col("seconds").cast("double"), F.col("known"), 6).alias("avg_session_duration_seconds"),
            "first_event_at", "last_event_at",
            ratio(n, span, 6).alias("avg_events_per_day"),
        ),
        KEY,
        "left",
    )


def entity_known_values(events: DataFrame) -> DataFrame:
    """The devices and addresses seen per entity, one row each."""
    pairs = F.array(
        F.struct(F.lit("device").alias("kind"), F.col("device_fingerprint").alias("value")),
        F.struct(F.lit("source_ip").alias("kind"), F.col("source_ip").alias("value")),
    )
    return (
        events.select(KEY, "timestamp", F.explode(pairs).alias("p"))
        .groupBy(KEY, F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("events"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    )


def entity_observed_profile(entities: DataFrame, events: DataFrame) -> DataFrame:
    """How many devices and addresses every known entity showed, with its event count and first and last sight."""
    known = entity_known_values(events)
    device = F.col("kind") == "device"
    observed = known.groupBy(KEY).agg(
        F.count_if(device).alias("known_devices"), F.count_if(~device).alias("known_source_ips"),
        F.sum(F.when(device, F.col("events"))).alias("event_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return entities.select(KEY, "entity_type").join(observed, KEY, "left").fillna(
        0, ["known_devices", "known_source_ips", "event_count"]
    )
