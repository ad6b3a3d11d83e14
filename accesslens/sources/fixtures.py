"""Access events, entities and labels derived from the given ``events`` and ``customer`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.functions.text import parse_country, risk_context, within_working_hours
from accesslens.sources import dims

# The mapping's resource list, in order.
RESOURCES = (
    "Git Repository", "CI/CD Pipeline", "Kubernetes Cluster", "Internal Wiki", "HRMS", "Employee Records",
    "Payroll System", "ERP System", "Financial Reporting", "Tax System", "Active Directory", "VPN Gateway",
    "Ticketing System", "SCADA Historian", "Inventory System", "SIEM Console", "Firewall Console", "CRM",
    "Quote System", "Sales Analytics",
)
AUTH_METHODS = ("password", "mfa", "sso", "api_key", "certificate")
SEGMENT_DEPARTMENT = {
    "AUTOMOBILE": "Engineering", "BUILDING": "Operations", "FURNITURE": "Sales", "HOUSEHOLD": "Finance",
    "MACHINERY": "IT",
}
OFFICE_NAMES = tuple(dims.OFFICES)


def _padded(value: Column, width: int) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def entity_key(user_id: Column) -> Column:
    return F.concat(F.lit("USR-"), _padded(user_id, 6))


def _entity_type(key: Column) -> Column:
    return (
        F.when(key % 20 == 0, "service_account")
        .when(key % 20 == 1, "edge_device")
        .when(key % 20 == 2, "iot_device")
        .otherwise("user")
    )


def size(spark: SparkSession, sf_dir: str) -> int:
    """Events and entities together, counted from the files' footers."""
    return sum(spark.read.parquet(f"{sf_dir}/{name}.parquet").count() for name in ("events", "customer"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, in the entity schema."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    home = dims.pick(OFFICE_NAMES, nation % 6)
    department = (
        F.when(key % 13 == 0, F.lit(None).cast("string"))
        .when(key % 11 == 0, "Security")
        .when(key % 7 == 0, "HR")
        .otherwise(dims.lookup(SEGMENT_DEPARTMENT, F.col("c_mktsegment")))
    )
    is_user = key % 20 > 2
    role = F.when(key % 20 == 0, "Service Account").when(~is_user, F.lit(None).cast("string")).when(
        key % 9 == 0, "Manager"
    ).otherwise("Employee")
    normal = F.concat_ws("|", *[dims.pick(RESOURCES, (key + i) % 20) for i in range(3)])
    columns = {
        "entity_id": entity_key(key),
        "entity_type": _entity_type(key),
        "display_name": F.col("c_name"),
        "department": department,
        "role": role,
        "privilege_level": F.when((key % 9 == 0) | (key % 20 == 0), "elevated").otherwise("standard"),
        "home_location": home,
        "home_country": parse_country(home),
        "timezone": dims.lookup({name: office[2] for name, office in dims.OFFICES.items()}, home),
        "working_hours_start": (7 + key % 3).cast("int"),
        "working_hours_end": (17 + key % 3).cast("int"),
        "active_days": F.when(is_user, "0,1,2,3,4").otherwise("0,1,2,3,4,5,6"),
        "normal_resources": normal,
        "authentication_methods": F.lit("|".join(AUTH_METHODS)),
        "trusted_device_count": F.lit(3),
        "normal_login_frequency": F.lit(2.0),
        "is_remote": key % 4 == 3,
        "network_cidr": F.concat(F.lit("10."), nation.cast("string"), F.lit(".0.0/16")),
        "schedule_type": F.when(is_user, "business").otherwise("continuous"),
    }
    source = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return source.select(*[value.alias(name) for name, value in columns.items()])


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, in the labelled event schema (attack columns null on normal rows)."""
    k, user, event = F.col("k"), F.col("user_id"), F.col("event_id")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation")
    )
    joined = raw.join(people, "user_id", "left")
    home_index = (F.col("nation") % 6).cast("long")
    office_index = F.when(k % 25 == 24, (F.col("nation") + 1 + event % 5) % 6).otherwise(home_index)
    command = lambda expr: F.concat(F.lit("cmd"), expr.cast("string"))
    failed = F.col("event_type") == "error"
    attack = (
        F.when(k % 25 == 24, "impossible_travel")
        .when((k >= 92) & failed, "brute_force")
        .when((k >= 92) & (F.col("event_type") == "signup"), "device_spoofing")
    )
    days = F.when(user % 20 > 2, F.array(*map(F.lit, range(5)))).otherwise(F.array(*map(F.lit, range(7))))
    zone = dims.pick(tuple(office[2] for office in dims.OFFICES.values()), home_index)
    local = F.from_utc_timestamp("ts", zone)
    in_hours = within_working_hours(F.weekday(local), F.hour(local), days, 7 + user % 3, 17 + user % 3)
    padded_event = F.concat(F.lit("evt-"), _padded(event, 9))
    columns = {
        "event_id": padded_event,
        "timestamp": F.col("ts"),
        "entity_id": entity_key(user),
        "entity_type": _entity_type(user),
        "source_ip": F.when(
            k % 25 == 24, F.concat_ws(".", F.lit("172.16"), (event % 250).cast("string"), (k % 3 + 1).cast("string"))
        ).otherwise(
            F.concat_ws(
                ".", F.lit("10"), F.col("nation").cast("string"), (user % 250).cast("string"), (k % 3 + 1).cast("string")
            )
        ),
        "geo_location": dims.pick(OFFICE_NAMES, office_index),
        "resource_accessed": dims.pick(RESOURCES, F.when(k < 70, (user + k % 3) % 20).otherwise(k % 20)),
        "auth_method": dims.pick(AUTH_METHODS, k % 5),
        "session_duration": F.floor(F.col("value") * 10 + F.lit(0.5)).cast("long"),
        "command_sequence": F.when(k % 10 == 0, "")
        .when(k % 10 < 4, command(k % 4))
        .otherwise(F.concat_ws("|", command(k % 4), command(k % 3), command(event % 2))),
        "device_fingerprint": F.when(k >= 92, F.concat(F.lit("unk-"), (event % 40).cast("string"))).otherwise(
            F.concat(F.lit("dev-"), user.cast("string"), F.lit("-"), (k % 3).cast("string"))
        ),
        "login_result": F.when(failed, "failure").otherwise("success"),
        "risk_context": risk_context(in_hours, k % 25 == 24, k < 92, k < 70),
        "label": F.when(attack.isNotNull(), "attack").otherwise("normal"),
        "device_os": F.when(k % 6 == 0, F.concat(F.lit("os-"), (k % 5).cast("string"))),
        "device_mac": F.when(k % 8 == 0, F.concat(F.lit("mac-"), (k % 7).cast("string"))),
    }
    rows = joined.select(
        *[value.alias(name) for name, value in columns.items()],
        attack.alias("attack_type"),
        k.alias("_k"),
    )
    kind = F.col("attack_type")
    registry = {name: {t: fields[i] for t, fields in dims.ATTACKS.items()} for i, name in ((1, "tactic"), (2, "technique"), (3, "severity"))}
    is_attack = kind.isNotNull()
    return rows.select(
        *schemas.REQUIRED_EVENT_COLUMNS,
        *schemas.OPTIONAL_EVENT_COLUMNS,
        F.when(is_attack, F.concat(F.lit("atk-"), F.substr("event_id", F.lit(5)))).alias("attack_id"),
        "attack_type",
        dims.lookup(registry["severity"], kind).alias("severity"),
        dims.lookup(registry["tactic"], kind).alias("mitre_tactic"),
        dims.lookup(registry["technique"], kind).alias("mitre_technique"),
        F.when(is_attack, (F.lit(50) + (F.col("_k") % 5) * 10) / F.lit(100.0)).alias("confidence"),
        is_attack.alias("injected"),
        F.when(is_attack, F.concat(F.lit("mapped "), kind)).alias("description"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unlabelled access-event table."""
    return labelled_events(spark, sf_dir).select(*schemas.REQUIRED_EVENT_COLUMNS, *schemas.OPTIONAL_EVENT_COLUMNS)


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_events(spark, sf_dir)
    return rows.select(
        "event_id", "entity_id", F.col("attack_type").isNotNull().alias("is_attack"),
        *schemas.GROUND_TRUTH_COLUMNS[3:],
    )


def triage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analyst status for some events, derived from the event number."""
    number = F.col("event_id")
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return source.filter(number % 4 != 0).select(
        F.concat(F.lit("evt-"), _padded(number, 9)).alias("event_id"),
        dims.pick(schemas.TRIAGE_STATES[1:] + ("open",), number % 4).alias("status"),
    )


