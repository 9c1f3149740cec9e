"""Queries on small tables made to show what the given ones don't: each is held against its SQL."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import profile as P
from millrace.plans import registry
from millrace.plans.registry import ORACLE_SQL, QUERIES
from millrace.sources import files as S
from millrace.streaming import runs as T


def of_sql(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found = con.sql(ORACLE_SQL[name])
    return sorted(tuple(str(r[found.columns.index(c)]) for c in sorted(found.columns)) for r in found.fetchall())


def of_query(spark, folder, name):
    df = QUERIES[name](spark, str(folder))
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_ages_within_the_second_of_a_bound(spark, tmp_path):
    at = [datetime(2024, 1, 31, 0, 0, 0, 500_000), datetime(2024, 1, 25, 0, 0, 0, 1), datetime(2024, 1, 25), datetime(2024, 1, 2, 0, 0, 0, 999_999), datetime(2024, 1, 1, 23, 59, 59, 999_999), datetime(2024, 1, 31, 0, 0, 1), datetime(1969, 12, 31, 23, 59, 59, 500_000), datetime(2024, 2, 3, 0, 0, 0, 5)]
    spark.createDataFrame([(t,) for t in at], "ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    assert of_query(spark, tmp_path, "age_buckets") == of_sql(tmp_path, "age_buckets", "events")


def test_samples_of_rows_that_the_order_leaves_equal(spark):
    rows = [(0, 3, 45.0, "R"), (0, 5, 5.0, "R"), (0, 5, 2.0, "A"), (0, 4, 45.0, "N")] + [(k, 1, 1.0, "z") for k in range(1, 2000)]
    wide = "k long, n int, value double, s string"
    for dealt in (rows, rows[::-1]):
        df = spark.createDataFrame(dealt, wide).withColumn("rare", F.when(F.col("k") > 1500, F.col("k")))
        got = {}
        for r in sorted(P.column_samples(df, ["value", "s", "rare"], ["k", "n"], 3).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.column_name, []).append(r.value)
        assert got == {"value": ["45.0", "45.0", "2.0"], "s": ["R", "N", "A"], "rare": ["1501", "1502", "1503"]}


def test_files_of_more_orders_than_one_file_holds(spark, tmp_path, monkeypatch):
    orders = spark.range(3000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("o_orderdate"), F.when(F.col("id") % 3 > 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"))
    orders.coalesce(2).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(S, "LARGEST", 100_000)  # a priority's JSON is larger
    monkeypatch.setattr(registry, "FILE_ROWS", 300, raising=False)
    for name in ("probed_file_checks", "schema_probe"):
        assert of_query(spark, tmp_path, name) == of_sql(tmp_path, name, "orders")


def test_deliveries_are_written_by_all_tasks(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "512m")  # a task for each of the three files
    made = []
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(registry, "scratch", lambda spark, label: made.append(str(tmp_path / label)) or made[-1])
            assert of_query(spark, tmp_path, "profile_incremental") == of_sql(tmp_path, "profile_incremental", "lineitem")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(list((tmp_path / "growing").rglob("*.parquet"))) == 15


def test_a_run_is_one_row_of_the_state(spark, tmp_path):
    schema = "run string, stage string, ts timestamp, status string, n long"
    rows = [("open", f"s{k % 20}", datetime(2024, 1, 1, 0, k), f"v{k}", k) for k in range(40)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    held = T.stream_run_states(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "run", "stage", "ts", "status", "n", ("end",), str(tmp_path / "out"), str(tmp_path / "cp"), "1 hour", 3_600_000)
    assert held[-1] == 1
    assert {r.stage: r.value for r in T.newest_of(spark, str(tmp_path / "out"), "run").collect()} == {f"s{k % 20}": f"v{k}" for k in range(20, 40)}
