"""Mean times are the SQL's where prices end in a half, and exact where a double is not."""

import duckdb

from pathweave import registry
from pathweave.operators.evaluation import summarise_scenarios


def test_halves_round_as_in_sql(spark, tmp_path):
    rows = [(k, "O", 2 * k + 0.5, "1-URGENT" if k % 2 else "5-LOW") for k in range(1, 40)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()["category_summary"])
    got = registry.queries()["category_summary"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_mean_of_large_times_is_exact(spark):
    big = (1 << 53) + 1
    runs = spark.createDataFrame([("a", "x", False, big), ("b", "x", False, big - 1)], "scenario_id string, category string, error boolean, elapsed_ms long")
    results = spark.createDataFrame([("a", "intent", "PASS")], "scenario_id string, dimension string, status string")
    assert summarise_scenarios(runs, results, "category").first()["avg_ms"] == big - 1
    runs = spark.createDataFrame([("a", "x", False, big)], runs.schema)
    assert summarise_scenarios(runs, results, "category").first()["avg_ms"] == big
