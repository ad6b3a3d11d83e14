"""Numeric column expressions: tie-safe rounding, clamps and normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def round_dp(value: Column, dp: int) -> Column:
    """Half-up rounding to ``dp`` decimals by one scaling and one division."""
    scale = float(10**dp)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def scaled(value: Column, dp: int) -> Column:
    """A value that has ``dp`` decimals as an exact integer, so that sums do not depend on order."""
    return F.floor(value * F.lit(float(10**dp)) + F.lit(0.5)).cast("long")


def exact_avg(value: Column, dp_in: int, dp_out: int) -> Column:
    """Average (an aggregate) of a column with ``dp_in`` decimals, rounded to ``dp_out``."""
    return round_dp(F.sum(scaled(value, dp_in)) / (F.count(value) * F.lit(float(10**dp_in))), dp_out)


def ratio(numerator: Column, denominator: Column, dp: int) -> Column:
    """Rounded quotient, 0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        round_dp(numerator / F.when(denominator == 0, F.lit(None)).otherwise(denominator), dp)
    )


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def norm_zscore(value: Column, mean: Column, std: Column, cap: float = 3.0) -> Column:
    """Distance from the mean in deviations, as a share of ``cap``; 0 without spread."""
    spread = F.when(std > 0, std)
    return F.when(std > 0, clamp(F.abs(value - mean) / spread / F.lit(cap))).otherwise(0.0)


def norm_circular(value: Column, reference: Column, period: float, cap_fraction: float = 0.5) -> Column:
    """Distance on a circle of the given period as a share of the largest useful distance."""
    if period <= 0 or cap_fraction <= 0:
        return F.lit(0.0)
    straight = F.abs(value - reference)
    wrapped = F.least(straight, F.lit(period) - straight)
    return clamp(wrapped / F.lit(period * cap_fraction))


def norm_frequency(share: Column) -> Column:
    return clamp(F.lit(1.0) - share)


def risk_scale(value: Column) -> Column:
    return round_dp(F.lit(100.0) * clamp(value), 2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_phi = (phi2 - phi1) / 2
    half_lambda = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.sin(half_phi) * F.sin(half_phi) + F.cos(phi1) * F.cos(phi2) * F.sin(half_lambda) * F.sin(half_lambda)
    return F.lit(EARTH_RADIUS_KM * 2) * F.asin(F.sqrt(chord))


def sample_variance_numerator(n: Column, total: Column, total_sq: Column) -> Column:
    """n·Σx² − (Σx)² as an exact integer (decimal(38,0), safe beyond 64 bits)."""
    short, wide = "decimal(18,0)", "decimal(38,0)"
    return n.cast(short) * total_sq.cast(wide) - total.cast(wide) * total.cast(wide)


def sample_std(n: Column, total: Column, total_sq: Column) -> Column:
    """Sample deviation from integer moments; 0 below two values."""
    pairs = F.when(n >= 2, n.cast("double") * (n - 1).cast("double"))
    numerator = sample_variance_numerator(n, total, total_sq).cast("double")
    return F.coalesce(F.sqrt(F.greatest(numerator, F.lit(0.0)) / pairs), F.lit(0.0))


def entropy_bits(items: Column) -> Column:
    """Shannon entropy, in bits, of the distribution of an array's values; 0 when empty."""

    def of(sorted_items: Column) -> Column:
        def part(run: Column) -> Column:
            share = run / F.size(sorted_items)
            return F.when(run > 0, -share * F.log2(share)).otherwise(0.0)

        def step(acc: Column, v: Column) -> Column:  # equal values stand together
            same = acc["last"] == v
            return F.struct(
                v.alias("last"),
                F.when(same, acc["run"] + 1).otherwise(1).cast("long").alias("run"),
                F.when(same, acc["bits"]).otherwise(acc["bits"] + part(acc["run"])).alias("bits"),
            )

        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("bits"))
        return F.aggregate(sorted_items, start, step, lambda acc: acc["bits"] + part(acc["run"]))

    # Through a lambda the array is made once, not at every use.
    return F.get(F.transform(F.array(F.array_sort(items)), of), 0)


def cosine_distance(left: Column, right: Column, dp: int = 4) -> Column:
    """1 − cosine of two sparse maps: 0 if both are empty, 1 if only one is."""
    products = F.map_zip_with(
        left, right, lambda _k, a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0))
    )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def norm(m: Column) -> Column:
        return F.sqrt(total(F.transform(F.map_values(m), lambda v: v * v)))

    return cosine_gap(total(F.map_values(products)), norm(left), norm(right), dp)


def cosine_gap(dot: Column, norm_left: Column, norm_right: Column, dp: int = 4) -> Column:
    """The same distance from a dot product and two norms."""
    return (
        F.when((norm_left == 0) & (norm_right == 0), F.lit(0.0))
        .when((norm_left == 0) | (norm_right == 0), F.lit(1.0))
        .otherwise(
            round_dp(
                F.greatest(
                    F.lit(0.0),
                    F.lit(1.0) - dot / F.when((norm_left != 0) & (norm_right != 0), norm_left * norm_right),
                ),
                dp,
            )
        )
    )
