import pytest
from pyspark.sql import functions as F

from tidewater import functions as fn
from tidewater.operators import joins, relations
from tidewater.streaming import frames
from tidewater.types import to_name, to_spark


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 4, "b"), (1, 4, "c"), (2, 10, "d"), (None, 1, "e")], "u int, at int, x string")
    go = lambda how, strict=False: pairs(joins.asof_join(left, right, "t", "at", {"k": "u"}, ["x"], how, strict))
    assert go("inner") == [(1, 1, "a"), (1, 5, "c")]
    assert go("inner", True) == [(1, 5, "c")]
    assert go("left") == sorted([(1, 1, "a"), (1, 5, "c"), (2, 9, None), (None, 9, None)], key=str)


def test_asof_with_a_hot_key_is_split(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN 1 WHEN id % 5 = 0 THEN NULL ELSE id % 7 END AS k", "id * 37 % 1009 AS t", "id")
    right = spark.range(400).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE id % 9 END AS u", "id * 53 % 1013 AS at", "id AS x")
    for how, strict in (("inner", False), ("left", True)):
        one, other = (joins.asof_join(left, right, "t", "at", {"k": "u"}, ["x"], how, strict, split) for split in (False, True))
        assert pairs(one) == pairs(other)
    assert joins.asof_join(left.limit(0), right, "t", "at", {"k": "u"}, ["x"], split=True).collect() == []


def test_marks_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    for values, want in (([], [False] * 3), ([1, None], [True, None, None]), ([1, 2], [True, True, None])):
        right = spark.createDataFrame([(x,) for x in values], "s int")
        assert [r.mark for r in joins.mark_join(left, right, "v", "s").orderBy(F.col("v").asc_nulls_last()).collect()] == want


@pytest.mark.parametrize("values", [[], [2], [1, 2, 3], [None], [2, None], [2, 2]])
@pytest.mark.parametrize("quantifier", ["ANY", "ALL"])
@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_quantified(spark, op, quantifier, values):
    tests = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}

    def want(x):
        each = [None if x is None or y is None else tests[op](x, y) for y in values]
        if quantifier == "ANY":
            return True if True in each else None if None in each else False
        return False if False in each else None if None in each else True

    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")
    right = spark.createDataFrame([(x,) for x in values], "s int")
    assert {r.v: r.mark for r in joins.quantified(left, right, "v", op, quantifier, "s").collect()} == {x: want(x) for x in (1, 2, 3, None)}


def test_positional_and_frames(spark):
    a, b = spark.range(5).withColumnRenamed("id", "a"), spark.range(3).withColumnRenamed("id", "b")
    assert pairs(joins.positional_join(a, b, [F.col("a")], [F.col("b").desc()])) == sorted([(0, 2), (1, 1), (2, 0), (3, None), (4, None)], key=str)
    got = list(frames(spark.range(100).repartition(7), [F.col("id").desc()], size=30))
    assert [f.position for f in got] == [0, 30, 60, 90] and [r.id for f in got for r in f.rows] == list(range(99, -1, -1))
    assert list(frames(spark.range(0))) == []


def test_numbers_are_gapless(spark):
    """Also of many rows, with columns that are used later and columns that are not."""
    n = 2_000_000
    df = spark.range(0, n, 1, 6).selectExpr("id", "repeat(hex(id * 7919), 2) AS payload", "id % 1000 AS other")
    both = joins.positional_join(df, df.selectExpr("id AS b", "payload AS q"), [F.xxhash64("id"), F.col("id")], [F.xxhash64("b"), F.col("b")])
    r = both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("payload") == F.col("q")).cast("int")).alias("same")).first()
    assert (r.n, r.same) == (n, n)
    r = joins.numbered(df, [F.col("payload"), F.col("id")], "at").agg(F.count_distinct("at").alias("n"), F.max("at").alias("top"), F.max(F.length("payload"))).first()
    assert (r.n, r.top) == (n, n - 1)


def test_pivot_and_ordered_list(spark, seed):
    counts = relations.pivot(seed["sales"], ["region"], "quarter", ["spring", "summer", "autumn"], {"n": (F.count("amount"), 0)})
    assert pairs(counts) == [("north", 1, 2, 0), ("south", 1, 0, 1)]
    sums = relations.pivot(seed["sales"], ["region"], "quarter", ["summer"], {"s": (F.sum("amount"), None)})
    assert pairs(sums) == [("north", 11), ("south", None)]
    assert seed["orders"].agg(relations.ordered_list(F.col("name"), F.col("id"), descending=True).alias("l")).first().l == ["sargassum", "wakame", "nori", "dulse", None, "kelp"]


def test_band_join(spark):
    left = spark.createDataFrame([(1.0,), (7.5,), (-3.0,)], "x double")
    right = spark.createDataFrame([(0.0, 8.0), (5.0, 6.0), (9.0, 1.0)], "lo double, hi double")
    assert pairs(joins.band_join(left, right, "x", "lo", "hi", 2.0)) == [(1.0, 0.0, 8.0), (7.5, 0.0, 8.0)]


def test_functions(spark):
    row = spark.range(1).select(
        fn.call("divide", F.lit(1), F.lit(0)).alias("inf"), fn.call("divide", F.lit(-1), F.lit(0)).alias("neg"), fn.call("concat", F.lit("a"), F.lit(None), F.lit("b")).alias("c"),
        fn.call("list_extract", F.array(F.lit(1)), F.lit(5)).alias("none"), fn.call("is_finite", F.lit(None).cast("double")).alias("f"), fn.call("divide_int", F.lit(-7), F.lit(2)).alias("d"), fn.call("reverse", F.lit("abc")).alias("r"),
    ).first()
    assert (row.inf, row.neg, row.c, row.none, row.f, row.d, row.r) == (float("inf"), float("-inf"), "ab", None, None, -3, "cba")


def test_types():
    for name in ("INTEGER", "DECIMAL(10,2)", "VARCHAR[]", "STRUCT(a INTEGER, b DOUBLE[])", "MAP(VARCHAR, BIGINT)", "TIMESTAMP", "HUGEINT"):
        assert to_name(to_spark(name)) == name
    with pytest.raises(ValueError):
        to_spark("ENUM")


def test_limit_percent_and_samples(spark):
    df = spark.range(50)
    assert relations.limit_percent(df, [F.col("id")], 10).count() == 5
    assert relations.sample_rows(df, 7, 1).count() == 7
