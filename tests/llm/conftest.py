import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    from tidewater.llm.session import ready

    ready(session)
    return session


@pytest.fixture
def documents(spark):
    def make(rows, **more):
        """rows: (doc_id, text, lang, source); more: columns of one value."""
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(*r, *(None,) * (4 - len(r))) for r in rows], "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        for c, v in more.items():
            df = df.withColumn(c, F.lit(v))
        return df

    return make


#: Nulls, empty and very long texts, repeats and ties.
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "word " * 60_000, "en", "a"), (4, "one two", "en", "b"), (4, "one two", "en", "b"), (None, "x y z", None, "b"), (6, "é\U0001f600 \t\n", "fr", None)]


@pytest.fixture
def odd(documents):
    return documents(ODD, size=1, shard=2, part="p", base="b", slot=3, target=0.5, copies=9, start=0, words="w", n_hit=4)
