from pyspark.sql import functions as F

from tonarm.operators import jobs


def test_values_of_one_batch_at_a_time(spark):
    """Rows stay Arrow's, no frame holds all that come at once; a model sees batches in order, the last one shorter."""

    def make():
        return lambda values: [f"{len(values)} {values[0][0]}" for _ in values]

    df = spark.range(10, numPartitions=1).select(F.col("id").alias("k"), F.repeat(F.col("id").cast("string"), 1000).alias("v"))
    made = jobs.run_model(df, "k", "v", make, "string", 4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert [(r["k"], r["result"]) for r in made.collect()] == [(i, f"{4 if i < 8 else 2} {i // 4 * 4}") for i in range(10)]


def test_keys_results_and_nulls(spark):
    """Values are Python's own, a null fails alone, results may be null or lists with nulls."""

    def make():
        return lambda values: [[v / 2, None] if v % 2 else None for v in values]

    df = spark.createDataFrame([("a", 3), (None, 4), ("c", None), ("d", 2**60 + 1)], "k string, v long").coalesce(1)
    rows = jobs.run_model(df, "k", "v", make, "array<double>", 3).collect()
    assert [(r["k"], r["status"]) for r in rows] == [("a", "ok"), (None, "ok"), ("c", "failed"), ("d", "ok")]
    assert rows[0]["result"] == [1.5, None] and rows[1]["result"] is None and rows[2]["error"].startswith("TypeError") and rows[3]["result"][0] == (2**60 + 1) / 2
    assert jobs.run_model(df.limit(0), "k", "v", make, "array<double>", 3).count() == 0
