"""Queries on rows made for them: the rows of their SQL."""

import duckdb
from pyspark.sql import functions as F

from tidewater import functions as fn
from tidewater.queries import ORACLES, QUERIES


def same(spark, folder, name, table, df):
    df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and want
    return got


def test_list_transform_in_single_precision_and_with_nulls(spark, tmp_path):
    """0.105 is 10.5 a hundred times in single precision, and below it in double; nulls are skipped, and nothing sums to null."""
    rows = [(1, [0.10499999672174454, 0.25]), (2, [-0.10499999672174454]), (3, [None, 0.5, None]), (4, [None]), (5, []), (6, None)]
    got = same(spark, tmp_path, "p14_list_transform", "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert dict(got) == {1: 36, 2: -11, 3: 50, 4: None, 5: None, 6: None}


def test_arithmetic_rounds_as_doubles(spark, tmp_path):
    """The sixth digit of a root of 40,000,000,597 hangs on how the double is scaled."""
    rows = [(k, c) for k in (1, 2, 3) for c in (40_000_000_597, 40_000_000_253, 0, 7, None)]
    same(spark, tmp_path, "f1_arithmetic", "orders", spark.createDataFrame(rows, "o_orderkey long, o_custkey long"))


def test_round_double(spark):
    values = [-0.2, 0.0, 1.7e308, 1.005, 2.675, -2.675, 0.49999999999999994, 0.5, -2.5, 200000.0014925, 1234.5, -1250.0, 9007199254740993.0, 1e300, float("inf"), float("nan"), None]
    x = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").coalesce(1)
    for digits in (-400, -308, -2, 0, 2, 6, 12, 400):
        got = x.select("i", fn.round_double(F.col("x"), digits).alias("r")).orderBy("i").collect()
        want = [duckdb.execute("SELECT round(?::DOUBLE, ?::INTEGER)", [v, digits]).fetchone()[0] for v in values]
        assert [str(r.r) for r in got] == [str(w) for w in want], digits
