import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def seed(spark):
    """Small tables whose answers can be checked by eye: a null name and a null date, a tenant without a customer and a customer
    without an order, pivot cells without rows."""
    day = lambda d: datetime.datetime(2023, 6, d)
    kind = "id int, name string, amt int, tenant int, score double, ts timestamp_ntz"
    rows = [(11, "kelp", 70, 5, 0.5, day(4)), (12, None, 20, 5, 2.25, day(9)), (13, "dulse", 320, 6, None, None), (14, "nori", 115, 8, 4.0, day(2)), (15, "wakame", 260, 6, 3.75, day(20)), (16, "sargassum", 20, 8, -1.5, day(9))]
    return {
        "orders": spark.createDataFrame(rows, kind),
        "archive": spark.createDataFrame([(90, "carrageen", 15, 5, 9.0, day(1)), (11, "kelp", 70, 5, 0.5, day(4))], kind),
        "customers": spark.createDataFrame([(5, "harbour"), (6, "lagoon"), (7, "estuary")], "tenant int, cname string"),
        "sales": spark.createDataFrame([("north", "spring", 4), ("north", "summer", 9), ("north", "summer", 2), ("south", "spring", 3), ("south", "autumn", 8), ("south", None, 1)], "region string, quarter string, amount int"),
    }


@pytest.fixture
def near(spark):
    spark.createDataFrame([(11, 1), (13, 2), (14, 3), (77, 4)], "id int, x int").createOrReplaceTempView("loc")
    spark.createDataFrame([(1, 60), (2, 70)], "x int, y int").createOrReplaceTempView("lookup")
    spark.createDataFrame([(11, "p"), (11, "q"), (None, "r")], "id int, tag string").createOrReplaceTempView("twice")
