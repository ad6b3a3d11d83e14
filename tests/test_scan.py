import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens.operators.scan import (
    SkewConfig, add_salt, hot_keys, quantiles, ranked, running_totals, skew_join, with_context,
)

SMALL = SkewConfig(hot_rows=100, block_rows=16, salts=4)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; every order value is a tie with nine others."""
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"),
        (F.col("id") / 10).cast("long").alias("t"), (F.col("id") * 7 % 11).alias("x"),
    )


def test_running_totals_per_group(spark, skewed):
    got = running_totals(skewed, [F.col("t"), F.col("id")], {"total": F.col("x"), "n": F.lit(1)}, ("key",)).toPandas()
    want = skewed.toPandas().sort_values(["t", "id"])
    want["total"], want["n"] = want.groupby("key")["x"].cumsum(), want.groupby("key").cumcount() + 1
    merged = got.merge(want, on="id", suffixes=("", "_want"))
    assert len(merged) == 3000
    assert (merged["total"] == merged["total_want"]).all() and (merged["n"] == merged["n_want"]).all()


def test_running_totals_global_descending(spark, skewed):
    got = running_totals(skewed, [F.col("x").desc(), F.col("id")], {"n": F.lit(1)}).toPandas()
    want = skewed.toPandas().sort_values(["x", "id"], ascending=[False, True])["id"].tolist()
    assert got.sort_values("n")["id"].tolist() == want


def test_hot_keys(skewed):
    assert [r["key"] for r in hot_keys(skewed, "key", SMALL).collect()] == ["hot"]
    assert hot_keys(skewed, "key", SkewConfig()) is None


def test_ranked_same_with_and_without_blocks(skewed):
    plain = ranked(skewed, "key", ["t", "id"], SMALL, None)
    split = ranked(skewed, "key", ["t", "id"], SMALL, hot_keys(skewed, "key", SMALL))
    assert plain.exceptAll(split.select(*plain.columns)).isEmpty() and plain.count() == split.count()


def test_context_copies_edges_only(skewed):
    rows = ranked(skewed.filter(F.col("key") == "hot"), "key", ["t", "id"], SMALL, None)
    placed = with_context(rows, "_rn", SMALL, before=3, after=2).toPandas()
    assert (~placed["_copy"]).sum() == 1000
    sizes = placed[~placed["_copy"]].groupby("_block").size()
    assert sizes.max() == 16
    middle = placed[placed["_block"] == 5].sort_values("_rn")["_rn"].tolist()
    assert middle == list(range(5 * 16 + 1 - 3, 6 * 16 + 1 + 2))


def test_salted_join_equals_plain_join(spark, skewed):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("zzz", 3)], "key string, v int")
    hot = hot_keys(skewed, "key", SMALL)
    salted = skew_join(add_salt(skewed, "key", "id", SMALL, hot), right, ["key"], "key", SMALL, hot).drop("_slot")
    plain = skewed.join(right, "key", "left")
    assert salted.count() == 3000
    assert plain.exceptAll(salted.select(*plain.columns)).isEmpty()


def test_salt_spreads_the_hot_key(skewed):
    hot = hot_keys(skewed, "key", SMALL)
    spread = add_salt(skewed, "key", "id", SMALL, hot).filter(F.col("key") == "hot").groupBy("_slot").count()
    assert spread.count() == 4


def test_quantiles_match_interpolation(spark):
    values = [float(v) for v in np.random.default_rng(7).normal(size=501)] + [1.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.9}).first()
    assert np.allclose([row["a"], row["m"], row["z"]], np.quantile(values, [0.1, 0.5, 0.9]))


def test_config_is_checked():
    with pytest.raises(ValueError):
        SkewConfig(hot_rows=10, block_rows=20)


def test_salted_rows_do_not_stay_placed_by_key(spark, skewed):
    hot = hot_keys(skewed, "key", SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        right = skewed.groupBy("key").agg(F.max("x").alias("m"))
        joined = skew_join(add_salt(skewed.repartition("key"), "key", "id", SMALL, hot), right, ["key"], "key", SMALL, hot)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The side that holds the hot rows is hashed by slot right below the join, not by key.
    assert re.search(r"Exchange hashpartitioning\(_slot#\d+", plan)


def test_hot_rows_are_spread_over_tasks(spark, skewed):
    hot = hot_keys(skewed, "key", SMALL)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = add_salt(skewed, "key", "id", SMALL, hot).withColumn("p", F.spark_partition_id())
        assert placed.filter(F.col("key") == "hot").select("p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
