"""Text column expressions: lists, blanks, tags, fixed-point formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_JOINER = " | "
DASH = "—"


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def split_list(value: Column, separator: str = "|") -> Column:
    """Delimited text to an array of strings; null or blank gives an empty array."""
    pattern = "[" + separator + "]"
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(value, pattern)
    )


def split_ints(value: Column, separator: str = ",") -> Column:
    return F.transform(split_list(value, separator), lambda item: F.trim(item).cast("int"))


def parse_country(location: Column) -> Column:
    return F.element_at(F.split(location, ", "), -1)


def mixed_bool(value: Column) -> Column:
    """'True'/'False' text in any case to boolean, anything else to null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def fixed(value: Column, dp: int) -> Column:
    """Fixed-point text with ``dp`` decimals, half-up, independent of the engine's formatter."""
    unit = 10**dp
    units = F.floor(F.abs(value) * F.lit(float(unit)) + F.lit(0.5)).cast("long")
    sign = F.when((value < 0) & (units > 0), F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(units / F.lit(unit)).cast("long").cast("string")
    if dp == 0:
        return F.concat(sign, units.cast("string"))
    cents = F.lpad((units % F.lit(unit)).cast("string"), dp, "0")
    return F.concat(sign, whole, F.lit("."), cents)


def percent(share: Column, dp: int) -> Column:
    return F.concat(fixed(share * F.lit(100.0), dp), F.lit("%"))


def risk_context(in_hours: Column, remote: Column, known_device: Column, expected_resource: Column) -> Column:
    """Four context tags, pipe joined."""
    # Tag names.
    return F.concat_ws(
        "|",
        F.when(in_hours, "in_hours").otherwise("off_hours"),
        F.when(remote, "remote_location").otherwise("home_location"),
        F.when(known_device, "known_device").otherwise("unrecognized_device"),
        F.when(expected_resource, "expected_resource").otherwise("unlisted_resource"),
    )


def within_working_hours(local_day: Column, local_hour: Column, days: Column, start: Column, end: Column) -> Column:
    return F.array_contains(days, local_day) & (local_hour >= start) & (local_hour < end)


def render_actions(actions: Column) -> Column:
    """Array of (priority, action, rationale) to '[priority] action — rationale' text."""
    return F.array_join(
        F.transform(
            actions,
            lambda a: F.concat(
                F.lit("["), a["priority"], F.lit("] "), a["action"], F.lit(f" {DASH} "), a["rationale"]
            ),
        ),
        LIST_JOINER,
    )


def parse_actions(text: Column) -> Column:
    """Read text made by ``render_actions``; an entry without a priority counts as standard."""

    def entry(item: Column) -> Column:
        close = F.instr(item, "]")
        has_priority = close > 0
        rest = F.when(has_priority, F.trim(F.substr(item, close + 1))).otherwise(item)
        cut = F.instr(rest, f" {DASH} ")
        split = has_priority & (cut > 0)
        return F.struct(
            F.when(has_priority, F.replace(F.substr(item, F.lit(1), close - 1), F.lit("["), F.lit("")))
            .otherwise("standard")
            .alias("priority"),
            F.trim(F.when(split, F.substr(rest, F.lit(1), cut - 1)).otherwise(rest)).alias("action"),
            F.trim(F.when(split, F.substr(rest, cut + 3)).otherwise("")).alias("rationale"),
        )

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r" \| "), lambda item: item != "")
    return F.transform(parts, entry)
