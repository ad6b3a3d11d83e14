from accesslens.operators.features import TASK_ROWS, by_entity


def test_partitions_grow_with_the_events(spark):
    df = spark.range(100).selectExpr("concat('a', id) AS entity_id")
    assert by_entity(df, 1000 * TASK_ROWS).rdd.getNumPartitions() == 1000
    assert "REPARTITION_BY_COL" in by_entity(df, TASK_ROWS)._jdf.queryExecution().toString()


def test_every_shuffle_begins_with_more_partitions_for_more_rows(spark):
    from accesslens.session import configure

    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(100).selectExpr("id % 7 AS k", "id AS v")
    try:
        configure(spark, 1000 * TASK_ROWS)
        joined = rows.hint("merge").join(rows.selectExpr("k", "v AS w"), "k").groupBy("w").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and plan.count(", 1000)") == plan.count("hashpartitioning(")
    finally:
        configure(spark)
    plan = rows.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert f", {few})" in plan


def test_a_pipeline_counts_its_input(spark, tmp_path):
    from accesslens.plans.pipeline import Pipeline

    spark.range(3 * TASK_ROWS).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(20 * TASK_ROWS).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    try:
        for _ in range(2):  # made, then found again after another dataset
            assert Pipeline.of(spark, str(tmp_path)).rows == 23 * TASK_ROWS
            assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "23"
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    finally:
        from accesslens.session import configure

        configure(spark)
