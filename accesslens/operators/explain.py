"""Contributions, sentences, confidence bands and recommended actions for classified events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens import schemas
from accesslens.functions.numeric import round_dp
from accesslens.functions.text import LIST_JOINER, fixed, percent, render_actions
from accesslens.operators.classify import KEYS, chosen_score, runner_up_score
from accesslens.operators.profiles import KEY, VALUE_KINDS, Profiles, profile_drift_trend
from accesslens.operators.scan import SkewConfig, add_salt, hot_by_history, skew_join
from accesslens.schemas import DIMENSIONS
from accesslens.sources import dims

TOP_CONTRIBUTORS = 3


@dataclass(frozen=True)
class BandConfig:
    low: float = 0.40
    high: float = 0.65

    def __post_init__(self) -> None:
        if not 0.0 <= self.low < self.high <= 1.0:
            raise ValueError("need 0 <= low < high <= 1")


RISK_COLUMNS = ("risk_indicator_component",)


def join_explain_inputs(classified: DataFrame, detection: DataFrame, engineered: DataFrame) -> DataFrame:
    """Classification with the deviations of its detection row and the features of its event."""
    own = set(classified.columns) | set(KEYS)
    deviations = detection.select(*KEYS, *schemas.DEVIATION_COLUMNS, *RISK_COLUMNS)
    features = engineered.select(*KEYS, *[c for c in schemas.EXPLAIN_FEATURE_COLUMNS if c not in own])
    return classified.join(deviations, list(KEYS), "left").join(features, list(KEYS), "left")


def explain_evidence(
    classified: DataFrame, detection: DataFrame, engineered: DataFrame, store: Profiles, latest: Profiles,
    skew: SkewConfig | None = None,
) -> DataFrame:
    """The joined inputs with profile facts, the shares of the event's own values and the version history."""
    skew = skew or SkewConfig()
    hot = hot_by_history(engineered, KEY, skew)
    df = add_salt(join_explain_inputs(classified, detection, engineered), KEY, "event_id", skew, hot)
    profile = latest.core.select(
        KEY, F.col("version").alias("profile_version"), "avg_login_hour", "login_hour_std", "avg_session_duration",
        "session_duration_std", "failure_rate", "resource_sharing_score", "drift_score", "drifted_dimensions",
        "warmup_strategy",
    )
    df = skew_join(df, profile, [KEY], KEY, skew, hot)
    df = skew_join(df, profile_drift_trend(store), [KEY], KEY, skew, hot)
    for kind, column in VALUE_KINDS.items():
        shares = latest.values.filter(F.col("kind") == kind).select(
            KEY, F.col("value").alias(column), F.col("share").alias(f"f_{kind}")
        )
        df = skew_join(df, shares, [KEY, column], KEY, skew, hot)
    known = F.col("profile_version").isNotNull()
    return df.withColumns(
        {f"f_{kind}": F.when(known, F.coalesce(f"f_{kind}", F.lit(0.0))) for kind in VALUE_KINDS}
    ).drop("_slot")


# ---- attribution ----


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _habit(subject: Column, share: Column, new: Column, note: Column) -> Column:
    base = (
        F.when(share.isNull(), _join(subject, " has no profile to compare with."))
        .when(share <= 0, _join(subject, " is not in the entity's profile."))
        .otherwise(_join(subject, " makes up ", percent(share, 1), " of the entity's profile."))
    )
    return _join(base, F.when(F.coalesce(new, F.lit(False)), note).otherwise(""))


def attribution_text() -> dict[str, Column]:
    """One sentence per dimension."""
    c = F.col
    profiled = c("profile_version").isNotNull()
    seconds = c("session_duration").cast("double")
    return {
        "temporal": F.when(
            profiled,
            _join(
                "Login hour ", c("login_hour").cast("string"), ", usually ", fixed(c("avg_login_hour"), 1), " ± ",
                fixed(c("login_hour_std"), 1), "; ", fixed(c("working_hours_deviation"), 1), " h outside working hours.",
            ),
        ).otherwise(_join("Login hour ", c("login_hour").cast("string"), "; no baseline yet.")),
        "device": _habit(
            _join("Device '", c("device_fingerprint"), "'"), c("f_device"), c("fingerprint_mismatch"),
            F.lit(" First use of this device."),
        ),
        "resource": _habit(
            _join(
                "Resource '", c("resource_accessed"), "'",
                F.when(c("sensitive_resource_access"), " (sensitive)").otherwise(""),
            ),
            c("f_resource"), c("resource_novelty"), F.lit(" First use of this resource."),
        ),
        "geographic": _habit(
            _join("Location '", c("geo_location"), "'"), c("f_location"), c("geo_novelty"),
            _join(" First visit; implied speed ", fixed(c("geo_velocity_kmh"), 0), " km/h."),
        ),
        "authentication": F.when(
            c("login_result") == "failure",
            _join("Login failed; the entity fails ", percent(F.coalesce(c("failure_rate"), F.lit(0.0)), 1), " of the time."),
        ).otherwise("Login succeeded."),
        "session": F.when(
            profiled,
            _join(
                "Session of ", fixed(seconds, 0), " s, usually ", fixed(c("avg_session_duration"), 0), " ± ",
                fixed(c("session_duration_std"), 0), " s.",
            ),
        ).otherwise(_join("Session of ", fixed(seconds, 0), " s; no baseline yet.")),
    }


def feature_attribution(texts: dict[str, Column] | None = None) -> Column:
    """The six deviations as shares of their sum, largest first.

    Shares are integers in hundredths of a percent. What rounding leaves over
    goes to the first largest; six zero deviations share equally (16.67 each).
    """
    texts = texts or {name: F.lit("") for name in DIMENSIONS}
    raw = [F.coalesce(f"deviation_{name}", F.lit(0.0)) for name in DIMENSIONS]
    total = sum(raw[1:], raw[0])
    positive = F.when(total > 0, total)
    cents = F.array(*[F.floor(r / positive * F.lit(100.0) * F.lit(100.0) + F.lit(0.5)).cast("long") for r in raw])
    left_over = F.lit(10_000) - F.aggregate(cents, F.lit(0).cast("long"), lambda a, v: a + v)
    largest = F.array_position(cents, F.array_max(cents))
    settled = F.when(
        total > 0, F.transform(cents, lambda v, i: v + F.when(i + 1 == largest, left_over).otherwise(0))
    ).otherwise(F.array(*[F.lit(1667).cast("long")] * len(DIMENSIONS)))

    def placed(shares: Column) -> Column:
        entries = [
            F.struct(
                (-F.get(shares, i)).alias("k"), F.lit(i).alias("i"), F.lit(name).alias("dimension"), r.alias("raw_deviation"),
                ((F.get(shares, i)) / F.lit(100.0)).alias("contribution_percentage"), texts[name].alias("explanation"),
            )
            for i, (name, r) in enumerate(zip(DIMENSIONS, raw))
        ]
        return F.array_sort(F.array(*entries))

    # Through a lambda the shares are made once; each sentence is made once, inside its entry.
    keyed = F.get(F.transform(F.array(settled), placed), 0)
    return F.transform(
        keyed, lambda e: F.struct(*[e[n].alias(n) for n in ("dimension", "raw_deviation", "contribution_percentage", "explanation")])
    )


def topk_contributors(contributions: Column) -> Column:
    return F.transform(
        F.slice(contributions, 1, TOP_CONTRIBUTORS),
        lambda e: _join(e["dimension"], " (", fixed(e["contribution_percentage"], 1), "%): ", e["explanation"]),
    )


# ---- reasons ----


def reason_deviation() -> Column:
    c = F.col
    return _join(
        "Anomaly ", fixed(c("detection_anomaly_score"), 2), " of 1 and risk ", fixed(c("detection_risk_score"), 1),
        " of 100: verdict ", c("detection_verdict"), ", severity ", c("detection_severity"), ".",
    )


def reason_history() -> Column:
    c = F.col
    trend = F.array_join(F.transform("drift_score_trend", lambda v: fixed(v, 2)), ", ")
    direction = F.when(c("drift_rising"), "rising").otherwise("stable or falling")
    versions = F.when(
        c("profile_version_count") >= 2,
        _join(" Drift over ", c("profile_version_count").cast("string"), " versions is ", direction, " (", trend, ")."),
    ).otherwise("")
    return F.when(c("profile_version").isNull(), "The entity has no profile; a neutral baseline was used.").otherwise(
        _join(
            "Profile version ", c("profile_version").cast("string"), " (", c("warmup_strategy"), "), drift ",
            fixed(c("drift_score"), 2), ".", versions,
        )
    )


def reason_impact(contributions: Column) -> Column:
    return _join("Main dimensions: ", F.array_join(topk_contributors(contributions), LIST_JOINER))


def reason_indicators() -> Column:
    matched = F.when(F.size("evidence") > 0, F.array_join("evidence", ", ")).otherwise("none strong enough")
    return _join(
        fixed(F.col("risk_indicator_component") * F.lit(100.0), 0), "% of the general warning signs are present. Evidence: ",
        matched, ".",
    )


def confidence_level(value: Column, config: BandConfig | None = None) -> Column:
    config = config or BandConfig()
    return F.when(value >= config.high, "high").when(value >= config.low, "medium").otherwise("low")


def confidence_parts() -> dict[str, Column]:
    """What the confidence was made of: match, margin over the runner-up, detection strength."""
    top = chosen_score()
    return {
        "match_strength": round_dp(top, 4),
        "margin": round_dp(F.greatest(F.lit(0.0), top - runner_up_score()), 4),
        "detection_strength": round_dp(F.col("detection_anomaly_score"), 4),
    }


def confidence_text() -> Column:
    c = F.col
    advice = (
        F.when(c("confidence_level") == "high", "Reliable.")
        .when(c("confidence_level") == "medium", "Corroborate before acting.")
        .otherwise("A lead only.")
    )
    return _join(
        "Confidence ", c("confidence_level"), " (", percent(c("confidence"), 0), "): match ",
        percent(c("match_strength"), 0), " for ", c("display_name"), ", margin ", percent(c("margin"), 0),
        ", detection ", percent(c("detection_strength"), 0), ". ", advice,
    )


def recommend_actions(attack_type: Column, level: Column) -> Column:
    """Actions of the type, with escalation first for high and critical, in stable priority order."""

    def literal(action: tuple[str, str, str]) -> Column:
        priority, text, why = action
        return F.struct(
            F.lit(schemas.PRIORITIES.index(priority)).alias("rank"), F.lit(priority).alias("priority"),
            F.lit(text).alias("action"), F.lit(why).alias("rationale"),
        )

    catalogue = F.create_map(
        *[part for name, acts in dims.ACTIONS.items() for part in (F.lit(name), F.array(*map(literal, acts)))]
    )
    own = F.try_element_at(catalogue, attack_type)
    escalated = F.lower(level).isin(*dims.ESCALATED_SEVERITIES)
    every = F.when(escalated, F.concat(F.array(literal(dims.ESCALATION)), own)).otherwise(own)
    ordered = F.array_sort(F.transform(every, lambda a, i: F.struct(a["rank"].alias("rank"), i.alias("i"), a.alias("a"))))
    return F.transform(
        ordered,
        lambda e: F.struct(
            e["a"]["priority"].alias("priority"), e["a"]["action"].alias("action"), e["a"]["rationale"].alias("rationale")
        ),
    )


def explain(evidence: DataFrame, bands: BandConfig | None = None) -> DataFrame:
    """All explanation fields for each classified event in an ``explain_evidence`` table."""
    df = evidence.withColumn("contributions", feature_attribution(attribution_text()))
    df = df.withColumns(confidence_parts() | {"confidence_level": confidence_level(F.col("confidence"), bands)})
    df = df.withColumns(
        {
            "behaviour_deviation": reason_deviation(),
            "historical_comparison": reason_history(),
            "feature_impact": reason_impact(F.col("contributions")),
            "attack_indicators": reason_indicators(),
            "confidence_narrative": confidence_text(),
            "actions": recommend_actions(F.col("attack_type"), F.col("detection_severity")),
        }
    )
    return df.select(
        "event_id", "entity_id", "entity_type", "timestamp", F.col("detection_risk_score").alias("risk_score"),
        "attack_type", "display_name", "confidence", "confidence_level", F.col("detection_severity").alias("severity"),
        "mitre_tactic", "mitre_technique", "contributions", "behaviour_deviation", "historical_comparison",
        "feature_impact", "attack_indicators", "match_strength", "margin", "detection_strength",
        "confidence_narrative", "actions", "evidence",
    )


def explanation_rows(explained: DataFrame) -> DataFrame:
    """Flat explanation table: six contribution slots, reasons, actions without their rationale."""
    slots = []
    for i in range(1, len(DIMENSIONS) + 1):
        slot = F.element_at("contributions", i)
        slots += [
            slot["dimension"].alias(f"top{i}_dimension"),
            slot["contribution_percentage"].alias(f"top{i}_contribution_pct"),
            slot["explanation"].alias(f"top{i}_explanation"),
        ]
    brief = F.transform("actions", lambda a: _join("[", a["priority"], "] ", a["action"]))
    return explained.select(
        "event_id", "entity_id", "risk_score", "attack_type", "confidence", "confidence_level", "severity", *slots,
        "behaviour_deviation", "historical_comparison", "feature_impact", "attack_indicators", "match_strength",
        "margin", "detection_strength", "confidence_narrative",
        F.array_join(brief, LIST_JOINER).alias("recommended_actions"),
    )


def analyst_summary(explained: DataFrame) -> DataFrame:
    """The wide record an analyst needs for triage."""
    return explained.select(
        "event_id", "entity_id", "entity_type", "timestamp", "risk_score", "attack_type", "display_name", "confidence",
        "confidence_level", "severity", "mitre_tactic", "mitre_technique",
        F.array_join(topk_contributors(F.col("contributions")), LIST_JOINER).alias("top_indicators"),
        F.concat_ws(
            " ", "behaviour_deviation", "historical_comparison", "feature_impact", "attack_indicators"
        ).alias("evidence_summary"),
        render_actions(F.col("actions")).alias("recommended_actions"),
        F.col("confidence_narrative").alias("confidence_explanation"),
    )


