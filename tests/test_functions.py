import math

from pyspark.sql import functions as F

from accesslens.functions import numeric as nu
from accesslens.functions import text as tx


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_round_half_up(spark):
    assert value(spark, nu.round_dp(F.lit(2.5), 0)) == 3.0
    assert value(spark, nu.round_dp(F.lit(-2.5), 0)) == -2.0
    assert value(spark, nu.round_dp(F.lit(0.33335), 4)) == 0.3334


def test_normalisers(spark):
    assert value(spark, nu.norm_zscore(F.lit(9.0), F.lit(1.0), F.lit(0.0))) == 0.0
    assert value(spark, nu.norm_zscore(F.lit(9.0), F.lit(1.0), F.lit(2.0))) == 1.0
    assert value(spark, nu.norm_zscore(F.lit(4.0), F.lit(1.0), F.lit(2.0))) == 0.5
    assert value(spark, nu.norm_circular(F.lit(23.0), F.lit(1.0), 24.0)) == 2 / 12
    assert value(spark, nu.norm_circular(F.lit(23.0), F.lit(1.0), 0.0)) == 0.0
    assert value(spark, nu.norm_frequency(F.lit(1.4))) == 0.0
    assert value(spark, nu.risk_scale(F.lit(1.7))) == 100.0


def test_haversine_london_new_york(spark):
    km = value(spark, nu.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(40.7128), F.lit(-74.0060)))
    assert 5560 < km < 5580


def test_entropy(spark):
    assert value(spark, nu.entropy_bits(tx.split_list(F.lit("")))) == 0.0
    assert value(spark, nu.entropy_bits(tx.split_list(F.lit("a|a|a")))) == 0.0
    assert math.isclose(value(spark, nu.entropy_bits(tx.split_list(F.lit("a|b|a|b")))), 1.0)


def test_cosine_distance(spark):
    def m(*pairs):
        return F.create_map(*[F.lit(p) for p in pairs]) if pairs else F.create_map().cast("map<string,double>")

    assert value(spark, nu.cosine_distance(m("a", 1.0), m("a", 2.0))) == 0.0
    assert value(spark, nu.cosine_distance(m("a", 1.0), m("b", 2.0))) == 1.0
    assert value(spark, nu.cosine_distance(m("a", 1.0), m())) == 1.0
    assert value(spark, nu.cosine_distance(m(), m())) == 0.0


def test_sample_std_beyond_64_bits(spark):
    n, x = 5_000_000, 100_000
    std = value(spark, nu.sample_std(F.lit(n).cast("long"), F.lit(n * x).cast("long"), F.lit(n * x * x).cast("long")))
    assert std == 0.0


def test_lists_and_blanks(spark):
    assert value(spark, tx.split_list(F.lit("a|b"))) == ["a", "b"]
    assert value(spark, tx.split_list(F.lit(None).cast("string"))) == []
    assert value(spark, tx.split_ints(F.lit("0, 2,4"))) == [0, 2, 4]
    assert value(spark, tx.blank_to_null(F.lit(""))) is None
    assert value(spark, tx.parse_country(F.lit("City, Part, Land"))) == "Land"
    assert value(spark, tx.parse_country(F.lit("Nowhere"))) == "Nowhere"


def test_mixed_bool(spark):
    got = [value(spark, tx.mixed_bool(F.lit(v))) for v in ("True", "FALSE", "maybe", True)]
    assert got == [True, False, None, True]


def test_fixed_text(spark):
    assert value(spark, tx.fixed(F.lit(0.125), 2)) == "0.13"
    assert value(spark, tx.fixed(F.lit(-3.04), 1)) == "-3.0"
    assert value(spark, tx.fixed(F.lit(12.0), 0)) == "12"
    assert value(spark, tx.percent(F.lit(0.256), 1)) == "25.6%"


def test_actions_survive_text(spark):
    text = "[high] Do it — Because. | plain words | [standard] No reason"
    rows = value(spark, tx.parse_actions(F.lit(text)))
    assert [tuple(r) for r in rows] == [
        ("high", "Do it", "Because."), ("standard", "plain words", ""), ("standard", "No reason", ""),
    ]
    assert value(spark, tx.parse_actions(F.lit(None).cast("string"))) == []
