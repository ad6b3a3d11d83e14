from accesslens.session import work_path


def test_a_table_that_grows_is_not_broadcast(spark, pipeline):
    # 600 KB of file are 80,000 rows here: below the former threshold, tens of MB on the driver.
    path = work_path(spark, "many")
    spark.range(80_000).selectExpr("concat('USR-', id) AS entity_id", "uuid() AS name").write.parquet(path)
    many = spark.read.parquet(path)
    plan = spark.range(1_000_000).selectExpr("concat('USR-', id % 90000) AS entity_id").join(many, "entity_id", "left")
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().toString()
