"""Small fixed reference tables and the expressions that look values up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Office -> (latitude, longitude, IANA zone).
OFFICES = {
    "New York, USA": (40.7128, -74.0060, "America/New_York"),
    "London, United Kingdom": (51.5074, -0.1278, "Europe/London"),
    "Bangalore, India": (12.9716, 77.5946, "Asia/Kolkata"),
    "Singapore, Singapore": (1.3521, 103.8198, "Asia/Singapore"),
    "Berlin, Germany": (52.5200, 13.4050, "Europe/Berlin"),
    "Sydney, Australia": (-33.8688, 151.2093, "Australia/Sydney"),
}

# Department -> (primary resources, secondary resources).
DEPARTMENT_RESOURCES = {
    "Engineering": (
        ("Git Repository", "CI/CD Pipeline", "Kubernetes Cluster"),
        ("Internal Wiki", "Issue Tracker", "Artifact Registry"),
    ),
    "HR": (
        ("HRMS", "Employee Records"),
        ("Payroll System", "Benefits Portal", "Recruitment Platform"),
    ),
    "Finance": (
        ("ERP System", "Financial Reporting"),
        ("Accounts Payable", "Tax System", "Budget Planning"),
    ),
    "IT": (
        ("Active Directory", "Server Management Console", "VPN Gateway"),
        ("Ticketing System", "Network Infrastructure", "Backup System"),
    ),
    "Operations": (
        ("SCADA Historian", "Building Automation Controller"),
        ("Facility Management System", "Inventory System", "Logistics Platform"),
    ),
    "Security": (
        ("SIEM Console", "Identity & Access Management"),
        ("Firewall Console", "Vulnerability Scanner", "Threat Intelligence Platform"),
    ),
    "Sales": (
        ("CRM", "Quote System"),
        ("Sales Analytics", "Contract Management"),
    ),
}

# Department sensitivity tier, and the departments whose primary resources are sensitive.
DEPARTMENT_TIER = {"HR": 1, "Sales": 1, "Operations": 1, "Engineering": 2, "Finance": 2, "IT": 3, "Security": 3}
SENSITIVE_DEPARTMENTS = ("Security", "Finance", "IT")

RESOURCE_DEPARTMENT = {
    resource: department
    for department, (primary, secondary) in DEPARTMENT_RESOURCES.items()
    for resource in primary + secondary
}
SENSITIVE_RESOURCES = tuple(r for d in SENSITIVE_DEPARTMENTS for r in DEPARTMENT_RESOURCES[d][0])

# Attack type -> (display name, tactic, technique, typical severity). The description is our wording.
ATTACKS = {
    "brute_force": (
        "Brute Force", "Credential Access", "T1110 Brute Force", "high",
        "Many failed logins in a short time against one account, from a device the account is known to use.",
    ),
    "impossible_travel": (
        "Impossible Travel", "Initial Access", "T1078 Valid Accounts", "critical",
        "Two sessions so far apart in space and so close in time that one person cannot have made both.",
    ),
    "credential_stuffing": (
        "Credential Stuffing", "Credential Access", "T1110.004 Credential Stuffing", "high",
        "Failed logins from unfamiliar devices, as when leaked passwords are tried by a script.",
    ),
    "lateral_movement": (
        "Lateral Movement", "Lateral Movement", "T1021 Remote Services", "high",
        "A first step onto a sensitive resource that neither the entity nor its peers normally reach.",
    ),
    "device_spoofing": (
        "Device Spoofing", "Defense Evasion", "T1036 Masquerading", "medium",
        "An accepted login whose device identity does not fit the devices seen before.",
    ),
    "low_and_slow_exfiltration": (
        "Low-and-Slow Exfiltration", "Exfiltration", "T1030 Data Transfer Size Limits", "medium",
        "Long quiet sessions over many sensitive resources that stay below rate limits.",
    ),
    "insider_drift": (
        "Insider Drift", "Privilege Escalation", "T1078 Valid Accounts", "medium",
        "An established entity whose reach widens step by step rather than all at once.",
    ),
    "unknown": (
        "Unknown", "Unknown", "Unknown", "low",
        "Flagged, but no known pattern fits well enough to name one.",
    ),
}
KNOWN_ATTACKS = tuple(name for name in ATTACKS if name != "unknown")

# Attack type -> the deviation dimension that breaks ties for it.
PRIMARY_DIMENSION = {
    "brute_force": "authentication",
    "impossible_travel": "geographic",
    "credential_stuffing": "authentication",
    "lateral_movement": "resource",
    "device_spoofing": "device",
    "low_and_slow_exfiltration": "session",
    "insider_drift": "resource",
}

# Attack type -> actions as (priority, action). The rationale is our wording.
ACTIONS = {
    "brute_force": (
        ("immediate", "Lock or temporarily disable the targeted account", "The failure streak shows guessing under way."),
        ("high", "Reset credentials for the affected account", "A targeted password should not stay in use."),
        ("standard", "Review authentication logs for the source network", "The source may have tried other accounts."),
    ),
    "impossible_travel": (
        ("immediate", "Verify the entity's actual location with the account owner", "The implied speed cannot be real."),
        ("immediate", "Force re-authentication with multi-factor verification", "Only the owner should keep the session."),
        ("high", "Reset credentials if travel cannot be confirmed", "Unexplained travel is handled as a takeover."),
    ),
    "credential_stuffing": (
        ("immediate", "Reset credentials for the affected account", "The password may be on a leaked list."),
        ("high", "Enforce multi-factor authentication for this account if not already required",
         "A password alone must not be enough."),
        ("standard", "Check whether the same source device or network targeted other accounts",
         "Such scripts rarely try one account only."),
    ),
    "lateral_movement": (
        ("immediate", "Investigate the account's access to the newly reached resource", "The step is far from past use."),
        ("high", "Review privileged sessions for this entity", "A pivot often goes with raised rights."),
        ("high", "Isolate the endpoint if compromise is confirmed", "Stops further steps during the inquiry."),
    ),
    "device_spoofing": (
        ("immediate", "Isolate the endpoint presenting the mismatched device identity", "The device may be an impostor."),
        ("high", "Verify the device with the account owner", "It may simply be new."),
        ("high", "Reset credentials if the device cannot be confirmed as legitimate", "Assume the worst until shown otherwise."),
    ),
    "low_and_slow_exfiltration": (
        ("immediate", "Review the entity's resource access history for signs of data exposure",
         "Broad quiet access is how this leak looks."),
        ("high", "Review privileged sessions for this entity", "Wider access may mean raised rights."),
        ("high", "Escalate to SOC for data-loss-prevention review", "Rate limits will not show it; specialists can."),
    ),
    "insider_drift": (
        ("immediate", "Review privileged sessions for this entity", "Reach and rights have grown together."),
        ("high", "Discuss the account's recent behavioural change with the entity's manager or department",
         "A new role would explain it."),
        ("standard", "Re-baseline the entity's behaviour profile once reviewed", "The profile should match agreed behaviour."),
    ),
    "unknown": (
        ("standard", "Investigate the account activity manually", "No pattern fits, so a person must judge."),
        ("standard", "Monitor the entity for recurrence", "A repeat would point to a pattern."),
    ),
}
ESCALATION = ("immediate", "Escalate to SOC immediately", "High and critical findings need the response team.")
ESCALATED_SEVERITIES = ("high", "critical")


def lookup(table: dict, key: Column) -> Column:
    """Value for ``key`` in a small fixed table, null when absent."""
    entries = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*entries), key)


def pick(items: tuple, index: Column) -> Column:
    """Item at a 0-based position of a short fixed list."""
    return F.try_element_at(F.array(*map(F.lit, items)), (index + 1).cast("int"))


def office_latitude(location: Column) -> Column:
    return lookup({name: office[0] for name, office in OFFICES.items()}, location)


def office_longitude(location: Column) -> Column:
    return lookup({name: office[1] for name, office in OFFICES.items()}, location)


def resource_department(resource: Column) -> Column:
    return lookup(RESOURCE_DEPARTMENT, resource)


def department_tier(department: Column) -> Column:
    return F.coalesce(lookup(DEPARTMENT_TIER, department), F.lit(1))


def is_sensitive(resource: Column) -> Column:
    return F.coalesce(resource.isin(*SENSITIVE_RESOURCES), F.lit(False))


def attack_registry(spark: SparkSession) -> DataFrame:
    rows = [(name, *fields) for name, fields in ATTACKS.items()]
    return spark.createDataFrame(
        rows,
        "attack_type string, display_name string, mitre_tactic string, mitre_technique string, "
        "typical_severity string, description string",
    )


def domain(spark: SparkSession, column: str, values: tuple) -> DataFrame:
    """One row per value of a fixed domain, with its position."""
    kind = "string" if isinstance(values[0], str) else "int"
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} {kind}, position int")
