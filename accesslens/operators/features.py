"""Engineered features: every value of an event depends on that entity's earlier events only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.functions.numeric import (
    entropy_bits, haversine_km, ratio, round_dp, sample_std, sample_variance_numerator,
)
from accesslens.functions.text import blank_to_null, parse_country, split_list
from accesslens.operators.scan import SkewConfig, add_salt, hot_keys, running_totals, skew_join, slot, split_hot, with_context
from accesslens.session import TASK_ROWS, written
from accesslens.sources import dims
from accesslens.sources.readers import add_optional_columns, require_columns

KEY = "entity_id"
ORDER = ["_us", "event_id"]
#: Order in a block: the place in the entity's history, which also tells rows apart that come twice.
PLACED = ["_rn"]
#: Durations before they are summed or squared; the square has 38 digits.
WIDE = "decimal(19,0)"
DIGIT_BITS = 4
DIGITS = 1 << DIGIT_BITS
# value column -> name of its prior-occurrence count
TRACKED = {
    "device_fingerprint": "_n_device",
    "resource_accessed": "_n_resource",
    "geo_location": "_n_geo",
    "device_os": "_n_os",
    "device_mac": "_n_mac",
}
STATIC = ("timezone", "working_hours_start", "working_hours_end", "department")


@dataclass(frozen=True)
class FeatureConfig:
    moving_average_window: int = 5
    drift_window: int = 10
    burst_window_minutes: float = 5.0
    confidence_saturation: int = 30

    @property
    def lookback(self) -> int:
        return max(self.moving_average_window, self.drift_window, 1)

    @property
    def burst_us(self) -> int:
        return int(self.burst_window_minutes * 60_000_000)


def sort_causal(df: DataFrame) -> DataFrame:
    """Rows of an entity together and in time order, ties by event id; no global sort."""
    return df.repartition(KEY).sortWithinPartitions(KEY, "timestamp", "event_id")


def join_entity_static(events: DataFrame, entities: DataFrame, config: SkewConfig, hot: DataFrame | None) -> DataFrame:
    """Attributes the features need; an unknown entity gets nulls."""
    static = entities.select(
        KEY, "timezone", "working_hours_start", "working_hours_end",
        blank_to_null(F.col("department")).alias("department"), F.lit(True).alias("_known"),
    )
    return skew_join(add_salt(events, KEY, "event_id", config, hot), static, [KEY], KEY, config, hot).drop("_slot")


def prepared(events: DataFrame) -> DataFrame:
    keep = [c for c in events.columns if c not in schemas.OPTIONAL_EVENT_COLUMNS]
    return events.select(
        *keep,
        *[blank_to_null(F.col(c)).alias(c) for c in schemas.OPTIONAL_EVENT_COLUMNS],
        F.unix_micros("timestamp").alias("_us"),
        parse_country(F.col("geo_location")).alias("_country"),
        F.col("session_duration").cast("long").alias("_x"),
        (F.col("login_result") == "success").alias("_ok"),
    )


def _rows(part: list[str], start: int, end: int, order: list[str] = ORDER):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(start, end)


def _prior(part: list[str], order: list[str] = ORDER):
    return _rows(part, Window.unboundedPreceding, -1, order)


def _sum0(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _value_counts(df: DataFrame, part: list[str], order: list[str] = ORDER) -> DataFrame:
    """Earlier rows in the partition with the same value, for each tracked value."""
    return df.select(
        "*",
        *[
            (F.row_number().over(Window.partitionBy(*part, value).orderBy(*order)) - 1).cast("long").alias(name)
            for value, name in TRACKED.items()
        ],
    )


def _digit(level: int) -> tuple[Column, Column]:
    """(value without its lowest ``level``+1 digits, digit ``level``) in base ``DIGITS``."""
    shift = DIGIT_BITS * level
    return F.shiftright("_v", shift + DIGIT_BITS), F.shiftright("_v", shift).bitwiseAND(F.lit(DIGITS - 1)).cast("int")


def _below(sums: list[str], digit: str, inclusive: bool) -> Column:
    """Pick, from counts of digits < 1, < 2, ... < DIGITS, the one for this row's digit."""
    return F.expr(f"element_at(array(0L, {', '.join(sums)}), {digit} + {2 if inclusive else 1})")


def _levels(values: int) -> int:
    """Digits of the ranks of so many values."""
    return max(1, -(-max(values - 1, 1).bit_length() // DIGIT_BITS))


def _prior_not_above(df: DataFrame, part: list[str], levels: int, order: list[str] = ORDER) -> DataFrame:
    """``_le``: earlier rows in the partition whose duration is at most this row's.

    Durations are replaced by their dense rank in the partition, so the number of
    passes depends on how many there are, not on how large one is. One pass per
    digit of the rank: earlier rows that agree on all higher digits and have a
    smaller digit here (or an equal one, at the lowest digit). The state is one
    counter per digit, so a long history needs neither an array nor a self-join.
    """
    found: Column = F.lit(0).cast("long")
    place = F.dense_rank().over(Window.partitionBy(*part).orderBy("_x")) - 1
    df = df.withColumn("_v", F.when(F.col("_x").isNotNull(), place.cast("long")))
    for level in range(levels):
        prefix, digit = _digit(level)
        df = df.withColumns({f"_p{level}": prefix, f"_d{level}": digit})
    for level in range(levels):
        keys = ", ".join(part if level == levels - 1 else [*part, f"_p{level}"])
        prior = f"(PARTITION BY {keys} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        sums = [f"count_if(_d{level} < {bound}) OVER {prior}" for bound in range(1, DIGITS + (level == 0))]
        df = df.withColumn(f"_c{level}", _below(sums, f"_d{level}", level == 0))
        found = found + F.col(f"_c{level}")
    drop = [f"_{letter}{level}" for level in range(levels) for letter in "pdc"]
    return df.withColumn("_le", found).drop("_v", *drop)


def _lookback(df: DataFrame, part: list[str], config: FeatureConfig, order: list[str] = ORDER) -> DataFrame:
    """Values taken from a bounded number of preceding rows."""
    at = Window.partitionBy(*part).orderBy(*order)

    def back(value: Column | str, rows: int) -> list[Column]:
        # Offsets are kept per row; a sliding frame would be summed anew for every row.
        return [F.lag(value, i).over(at) for i in range(1, rows + 1)]

    recent = F.array_compact(F.array(*back(F.col("_x").cast(WIDE), config.moving_average_window)))
    fresh = F.array_compact(F.array(*back((F.col("_n_resource") == 0).cast("long"), config.drift_window)))
    used = F.array_compact(F.array(*back("resource_accessed", config.drift_window)))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    return df.select(
        "*",
        F.lag("_us").over(at).alias("_prev_us"),
        F.lag("geo_location").over(at).alias("_prev_geo"),
        F.lag("_country").over(at).alias("_prev_country"),
        F.lag("resource_accessed").over(at).alias("previous_resource"),
        F.aggregate(recent, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)")).alias("_ma_sum"),
        F.size(recent).cast("long").alias("_ma_n"),
        # A resource is outside the older baseline exactly when its first use lies in the window.
        total(fresh).alias("_drift_new"),
        F.size(F.array_distinct(used)).alias("_drift_all"),
    )


def _additive() -> dict[str, Column]:
    """Quantities whose prior totals the features need."""
    return {
        "_s_ok": F.col("_ok").cast("long"),
        "_s_mfa": (F.col("auth_method") == "mfa").cast("long"),
        "_s_city": F.coalesce(F.col("geo_location") != F.col("_prev_geo"), F.lit(False)).cast("long"),
        "_s_res": (F.col("_n_resource") == 0).cast("long"),
        # An unknown duration counts nowhere: neither in sums nor in the number they are divided by.
        "_n_x": F.col("_x").isNotNull().cast("long"),
        "_s_x": F.col("_x").cast(WIDE),
        "_s_xx": F.col("_x").cast(WIDE) * F.col("_x").cast(WIDE),
    }


def _totals(df: DataFrame, part: list[str], order: list[str] = ORDER) -> DataFrame:
    window = _prior(part, order)
    return df.select(
        "*",
        *[_sum0(value, window).alias(name) for name, value in _additive().items()],
        F.coalesce(F.max(F.when(F.col("_ok"), F.col("_rn"))).over(window), F.lit(0)).alias("_last_ok"),
    )


def _older(df: DataFrame, part: list[str], config: FeatureConfig) -> DataFrame:
    """``_older``: events before the burst window."""
    before = Window.partitionBy(*part).orderBy("_us").rangeBetween(Window.unboundedPreceding, -(config.burst_us + 1))
    return df.select("*", F.count("*").over(before).alias("_older"))


def by_entity(df: DataFrame, rows: int) -> DataFrame:
    """Rows of an entity together: in the session's number of partitions, which Spark merges, or in more where ``rows`` need them."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, KEY) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(KEY)


#: What the windows read; all other columns travel through them as one.
WINDOWED = (KEY, "event_id", "_us", "_x", "_ok", "auth_method", "_country", *TRACKED)


def _single_pass(
    df: DataFrame, entities: DataFrame, config: FeatureConfig, skew: SkewConfig, longest: int, total: int
) -> DataFrame:
    """All raw quantities for entities that fit one task.

    The rows move once: hashing by entity serves the join and every window below,
    because each of them clusters by the entity and possibly more. Each window and
    sort copies its rows, so columns none of them reads are copied as one value.
    """
    part = [KEY]
    df = join_entity_static(by_entity(df, total), entities, skew, None)
    rest = [c for c in df.columns if c not in WINDOWED]
    df = df.select(*WINDOWED, F.struct(*rest).alias("_rest"))
    df = _prior_not_above(_value_counts(df, part), part, _levels(longest))
    at = Window.partitionBy(*part).orderBy(*ORDER)
    df = df.withColumn("_rn", F.row_number().over(at).cast("long"))
    df = _older(_totals(_lookback(df, part, config), part), part, config)
    return df.select(*[c for c in df.columns if c != "_rest"], "_rest.*")


def _carry(blocks: DataFrame, keys: list[str], names: list[str], agg=F.sum) -> DataFrame:
    """Totals of all earlier blocks, per key and block."""
    window = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        *keys, "_block", *[F.coalesce(agg(n).over(window), F.lit(0)).alias(f"_b{n}") for n in names]
    )


def _by_block(df: DataFrame) -> DataFrame:
    """Rows of a block together, by one column: windows and joins that cluster by it and possibly more leave them there."""
    return df.select("*", slot(KEY, "_block").alias("_slot")).repartition("_slot")


def _join_blocks(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on (keys, block); ``df`` lies by block, not by entity, and stays where it is."""
    at = F.col("_slot") if "_slot" in other.columns else slot(KEY, "_block").alias("_slot")
    right = other.select(at, *[c for c in other.columns if c not in (KEY, "_block", "_slot")])
    return df.join(right, ["_slot", *[k for k in keys if k != KEY]], "left")


def _add_carry(df: DataFrame, carry: DataFrame, keys: list[str], names: list[str], combine=None) -> DataFrame:
    combine = combine or (lambda own, earlier: own + earlier)
    joined = _join_blocks(df, carry, keys)
    return joined.withColumns({n: combine(F.col(n), F.coalesce(F.col(f"_b{n}"), F.lit(0))) for n in names}).drop(
        *[f"_b{n}" for n in names]
    )


def _blocked_value_counts(rows: DataFrame) -> DataFrame:
    """Value counts inside the block plus those of earlier blocks; ``rows`` is a written table."""
    df = _value_counts(_by_block(rows), ["_slot"], PLACED)
    for value, name in TRACKED.items():
        # A missing value counts as a value, as it does inside a block.
        own = F.coalesce(F.col(value), F.lit("\0")).alias("_own")
        per_block = rows.groupBy(KEY, own, "_block").agg(F.count("*").alias(name))
        df = _add_carry(df.select("*", own), _carry(per_block, [KEY, "_own"], [name]), [KEY, "_own"], [name]).drop("_own")
    return df


def _blocked_not_above(df: DataFrame, rows: DataFrame, longest: int, skew: SkewConfig) -> DataFrame:
    """``_le`` for blocked entities: inside the block by ranks in the block, plus earlier blocks by digit counts.

    The second part works on (entity, block, duration) counts, with the duration
    replaced by its rank among the entity's, which is a running count over its
    distinct durations. A window there spans the blocks of one entity and prefix
    of the rank, never its rows.
    """
    df = _prior_not_above(df, ["_slot"], _levels(min(longest, skew.block_rows)), PLACED)
    counts = written(rows.filter(F.col("_x").isNotNull()).groupBy(KEY, "_block", "_x").agg(F.count("*").alias("_cell")), "cells")
    place = running_totals(counts.select(KEY, "_x").distinct(), [F.col("_x")], {"_v": F.lit(1)}, (KEY,))
    at = slot(KEY, "_x").alias("_slot")
    placed = counts.select("*", at).join(place.select(at, (F.col("_v") - 1).alias("_v")), "_slot")
    cells = written(placed.select(KEY, "_block", "_x", "_v", "_cell"), "cells")
    levels = _levels(longest)
    found = _by_block(cells.select(KEY, "_block", "_x", "_v", F.lit(0).cast("long").alias("_earlier")))
    for level in range(levels):
        prefix, digit = _digit(level)
        placed = cells.select(KEY, "_block", prefix.alias("_p"), digit.alias("_d"), "_cell")
        names = [f"_t{bound}" for bound in range(1, DIGITS + 1)]
        per_block = placed.groupBy(KEY, "_p", "_block").agg(
            *[F.sum(F.when(F.col("_d") < b, F.col("_cell")).otherwise(0)).alias(f"_t{b}") for b in range(1, DIGITS + 1)]
        )
        carry = _carry(per_block, [KEY, "_p"], names)
        found = (
            _join_blocks(found.withColumns({"_p": prefix, "_d": digit}), carry, [KEY, "_p"])
            .withColumn(
                "_earlier", F.col("_earlier") + _below([f"_b{n}" for n in names], "_d", level == 0)
            )
            .select(KEY, "_block", "_x", "_v", "_earlier", "_slot")
        )
    joined = _join_blocks(df, found.drop("_v"), [KEY, "_x"])
    return joined.withColumn("_le", F.col("_le") + F.coalesce("_earlier", F.lit(0))).drop("_earlier")


def _blocked_older(df: DataFrame, rows: DataFrame, config: FeatureConfig) -> DataFrame:
    """Count events before each event's burst window by ranking probes among the events; ``rows`` is a written table of them."""
    events = rows.select(KEY, F.col("_us").alias("_t"), "event_id", F.lit(1).alias("_kind"))
    probes = rows.select(KEY, (F.col("_us") - F.lit(config.burst_us)).alias("_t"), "event_id", F.lit(0).alias("_kind"))
    # At equal times a probe sorts before the events, so it counts strictly older ones.
    counted = running_totals(
        events.unionByName(probes), [F.col("_t"), F.col("_kind"), F.col("event_id")], {"_older": F.col("_kind")}, (KEY,)
    )
    return df.join(counted.filter(F.col("_kind") == 0).select("event_id", "_older"), "event_id")


def _blocked_pass(df: DataFrame, config: FeatureConfig, skew: SkewConfig, longest: int) -> DataFrame:
    """The same quantities for hot entities, in blocks of consecutive events with carried totals."""
    rows = running_totals(df, [F.col(c) for c in ORDER], {"_rn": F.lit(1)}, (KEY,))
    rows = written(with_context(rows, "_rn", skew).drop("_copy"), "blocks")
    df = written(_blocked_not_above(_blocked_value_counts(rows), rows, longest, skew).drop("_slot"), "blocks")
    spread = with_context(df.drop("_block"), "_rn", skew, before=config.lookback).repartition(KEY, "_block")
    df = written(_lookback(spread, [KEY, "_block"], config, PLACED).filter(~F.col("_copy")).drop("_copy"), "blocks")
    local = _totals(_by_block(df), ["_slot"], PLACED)
    names = list(_additive())
    per_block = df.groupBy(KEY, "_block").agg(
        *[F.sum(value).alias(name) for name, value in _additive().items()],
        F.max(F.when(F.col("_ok"), F.col("_rn"))).alias("_last_ok"),
    )
    df = _add_carry(local, _carry(per_block, [KEY], names), [KEY], names)
    df = _add_carry(df, _carry(per_block, [KEY], ["_last_ok"], F.max), [KEY], ["_last_ok"], F.greatest)
    return _blocked_older(df.drop("_block", "_slot"), rows, config)


def feature_columns(config: FeatureConfig) -> dict[str, Column]:
    c = F.col
    h, known = c("_rn") - 1, c("_n_x")
    zone = F.coalesce(c("timezone"), F.lit("UTC"))
    local = F.from_utc_timestamp("timestamp", zone)
    hour, start, end = F.hour(local), c("working_hours_start"), c("working_hours_end")
    off_hours = F.least(F.pmod(start - hour, F.lit(24)), F.pmod(hour - end, F.lit(24)))
    std = sample_std(known, c("_s_x"), c("_s_xx"))
    spread = (known >= 2) & (sample_variance_numerator(known, c("_s_x"), c("_s_xx")) > 0)
    total = c("_s_x").cast("double")
    mean = total / F.when(known > 0, known)
    zscore = F.when(spread, round_dp((c("_x") - mean) / F.when(spread, std), 4))
    elapsed = (c("_us") - c("_prev_us")) / F.lit(1e6)
    hours = elapsed / F.lit(3600.0)
    distance = haversine_km(
        dims.office_latitude(c("_prev_geo")), dims.office_longitude(c("_prev_geo")),
        dims.office_latitude(c("geo_location")), dims.office_longitude(c("geo_location")),
    )
    moved = (c("_prev_geo") != c("geo_location")) & (hours > 0)
    commands = split_list(c("command_sequence"))
    size = F.size(commands)
    owner = dims.resource_department(c("resource_accessed"))
    above = (
        c("department").isNotNull() & owner.isNotNull() & (owner != c("department"))
        & (dims.department_tier(owner) > dims.department_tier(c("department")))
    )

    def unseen(value: str) -> Column:
        return c(value).isNotNull() & (c(TRACKED[value]) == 0)

    return {
        "login_hour": hour,
        "day_of_week": F.weekday(local),
        "is_weekend": F.weekday(local) >= 5,
        "working_hours_deviation": F.when(
            c("_known") & ~((hour >= start) & (hour < end)), off_hours.cast("double")
        ).otherwise(0.0),
        "time_since_previous_login_seconds": F.coalesce(round_dp(elapsed, 2), F.lit(-1.0)),
        "session_duration_zscore": F.coalesce(zscore, F.lit(0.0)),
        "geo_novelty": unseen("geo_location"),
        "geo_velocity_kmh": F.coalesce(F.when(moved, round_dp(distance / F.when(hours > 0, hours), 2)), F.lit(0.0)),
        "country_change": F.coalesce(c("_prev_country") != c("_country"), F.lit(False)),
        "city_change_frequency": ratio(c("_s_city"), h, 4),
        "device_familiarity_score": ratio(c("_n_device"), h, 4),
        "fingerprint_mismatch": unseen("device_fingerprint"),
        "os_novelty": unseen("device_os"),
        "mac_novelty": unseen("device_mac"),
        "success_ratio": ratio(c("_s_ok"), h, 4),
        "failure_ratio": ratio(h - c("_s_ok"), h, 4),
        "consecutive_failures": (h - c("_last_ok")).cast("int"),
        "mfa_usage_frequency": ratio(c("_s_mfa"), h, 4),
        "resource_novelty": unseen("resource_accessed"),
        "resource_diversity": ratio(c("_s_res"), h, 4),
        "command_sequence_complexity": ratio(F.size(F.array_distinct(commands)), size, 4),
        "session_entropy": round_dp(entropy_bits(commands), 4),
        "burst_access_score": (h - c("_older")).cast("double"),
        "behaviour_drift_score": ratio(c("_drift_new"), c("_drift_all"), 4),
        "privilege_change_indicator": F.coalesce(above, F.lit(False)),
        "sensitive_resource_access": dims.is_sensitive(c("resource_accessed")),
        "rolling_mean_session_duration": ratio(total, known, 2),
        "rolling_std_session_duration": round_dp(std, 2),
        "moving_avg_session_duration": ratio(c("_ma_sum").cast("double"), c("_ma_n"), 2),
        "historical_percentile_session_duration": F.when(known == 0, F.lit(50.0)).when(
            c("_x").isNotNull(), round_dp(F.lit(100.0) * c("_le") / F.when(known > 0, known), 2)  # an unknown duration has no place
        ),
        "history_length": h.cast("int"),
        "new_entity_flag": h == 0,
        "confidence_score": round_dp(F.least(F.lit(1.0), h / F.lit(float(config.confidence_saturation))), 4),
    }


def engineer_features(
    events: DataFrame, entities: DataFrame, config: FeatureConfig | None = None, skew: SkewConfig | None = None
) -> DataFrame:
    """Events with the registered features and ``previous_resource``.

    Ordinary entities are handled by windows over one exchange on the entity.
    Entities longer than ``skew.hot_rows`` go through blocks of consecutive
    events, with the totals of earlier blocks carried in; results are the same.
    """
    config, skew = config or FeatureConfig(), skew or SkewConfig()
    events = add_optional_columns(require_columns(events, schemas.REQUIRED_EVENT_COLUMNS, "events"))
    counted = events.groupBy(KEY).agg(F.count("*").alias("_rows")).agg(F.max("_rows").alias("longest"), F.sum("_rows").alias("total")).first()
    longest, total = counted.longest or 0, counted.total or 0
    hot = hot_keys(events, KEY, skew) if longest > skew.hot_rows else None
    rows = prepared(events)
    if hot is None:
        raw = _single_pass(rows, entities, config, skew, longest, total)
    else:
        cold_rows, hot_rows = split_hot(rows, KEY, hot)
        hot_rows = join_entity_static(hot_rows, entities, skew, hot)
        raw = _single_pass(cold_rows, entities, config, skew, min(longest, skew.hot_rows), total).unionByName(
            _blocked_pass(hot_rows, config, skew, longest)
        )
    return raw.select(
        *events.columns,
        *[value.alias(name) for name, value in feature_columns(config).items()],
        "previous_resource",
    )


def join_ground_truth(engineered: DataFrame, truth: DataFrame) -> DataFrame:
    """Attach ``is_attack`` after the features exist; an event without a label counts as normal."""
    # Entity and event together: rows that lie by entity stay where they are, and the result still does.
    return engineered.join(truth.select(KEY, "event_id", "is_attack"), [KEY, "event_id"], "left").select(
        *[c for c in engineered.columns if c != "is_attack"], F.coalesce("is_attack", F.lit(False)).alias("is_attack")
    )


def join_features_to_events(events: DataFrame, features: DataFrame) -> DataFrame:
    """Features by event id, for feature tables kept apart from their events."""
    return events.join(features.select("event_id", *schemas.FEATURE_NAMES), "event_id", "left")



def first_seen_values(events: DataFrame, value: str, skew: SkewConfig | None = None) -> DataFrame:
    """``first_seen``: whether an event is the first of its entity with this value.

    The first event per (entity, value) comes from a partial aggregate, so a hot
    pair never meets in one task; hot entities are salted for the join.
    """
    skew = skew or SkewConfig()
    hot = hot_keys(events, KEY, skew)
    first = events.groupBy(KEY, value).agg(F.min_by("event_id", F.struct("timestamp", "event_id")).alias("_first"))
    joined = skew_join(add_salt(events, KEY, "event_id", skew, hot), first, [KEY, value], KEY, skew, hot)
    return joined.withColumn("first_seen", F.col("event_id") == F.col("_first")).drop("_first", "_slot")
