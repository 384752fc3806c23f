"""A query for each operator, with DuckDB's SQL for the same rows.

Most are one SQL text that both engines run; where Spark's SQL has no such operator, or another answer, the query uses
tidewater.operators, and the SQL beside it says what it has to give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater import functions as fn
from tidewater.engine import Engine
from tidewater.errors import Conflict, NotAllowed, Refused
from tidewater.operators import joins, relations
from tidewater.sources import MemorySource, ParquetDirSource, Verb, VersionedSource
from tidewater.sources.files import scratch
from tidewater.writes import When

Query = Callable[[SparkSession, str], DataFrame]

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Spark's text of queries that are one text.
TEXTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def both(name: str, sql: str, spark_sql: str | None = None) -> None:
    """One text for both engines, or Spark's own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, spark_sql or sql)
        return spark.sql(spark_sql or sql)

    QUERIES[name], ORACLES[name], TEXTS[name] = run, sql, spark_sql or sql


def frame(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """A query of DataFrames: f(t, spark), t('orders') being a table."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t), spark)
        if sql:
            ORACLES[name] = sql
        return f

    return register


# Scans and rows
both("s1_floor_scan", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
both("s2_pushed_filter_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
both("s3_zero_column_read", "SELECT count(*) AS n FROM lineitem")
both("s4_values", "SELECT n_name, v.tag FROM nation JOIN (VALUES (1, 'one'), (2, 'two'), (NULL, 'none')) AS v(k, tag) ON n_nationkey = v.k")
both("s5_empty_result", "SELECT o_orderkey, o_custkey FROM orders WHERE 1 = 0")
both("s6_seam_read", "SELECT c_custkey, c_name, near.tag FROM customer JOIN (VALUES (10, 'a'), (20, 'b'), (20, 'c'), (99999999, 'd')) AS near(id, tag) ON c_custkey = near.id")
both("s7_filtered_aggregate", "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")

# Projection, filters, predicates, expressions
both("p1_projection", "SELECT o_orderkey * 2 AS twice, o_custkey + 1 AS next_cust, o_orderstatus FROM orders")
both("p2_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05 AND l_returnflag = 'R'")
both("p3_comparison", "SELECT o_orderkey, o_totalprice = 1000.0 AS eq, o_totalprice <> 1000.0 AS ne, o_custkey < 500 AS lt, o_custkey > 500 AS gt, o_custkey <= 500 AS le, o_custkey >= 500 AS ge FROM orders")
both("p4_distinct_from", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY' AS d, nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM CAST(NULL AS VARCHAR) AS s FROM customer",
     "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY' AS d, nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM CAST(NULL AS STRING) AS s FROM customer")
both("p5_between", "SELECT l_orderkey, l_linenumber, l_quantity NOT BETWEEN 5 AND 40 AS outside FROM lineitem WHERE l_quantity BETWEEN 3 AND 45")
both("p6_boolean", "SELECT c_custkey, (c_acctbal > 0 AND c_nationkey > 5) OR NOT (c_mktsegment = 'BUILDING') AS b FROM customer")
both("p7_is_null", "SELECT c_custkey, nullif(c_nationkey, 3) IS NULL AS a, nullif(c_nationkey, 3) IS NOT NULL AS b FROM customer")
both("p8_coalesce", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), nullif(c_custkey, 5), -1) AS v FROM customer",
     "SELECT c_custkey, coalesce(CAST(nullif(c_nationkey, 3) AS BIGINT), nullif(c_custkey, 5), -1) AS v FROM customer")
both("p9_in_list", "SELECT c_custkey, c_nationkey NOT IN (1, 2) AS n, nullif(c_nationkey, 4) IN (4, NULL) AS u FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
both("p10_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS size, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS is_open FROM orders")
both("p11_cast", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS d, CAST(o_orderkey AS VARCHAR) AS s, TRY_CAST(o_orderpriority AS INTEGER) AS t FROM orders",
     "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS d, CAST(o_orderkey AS STRING) AS s, TRY_CAST(o_orderpriority AS INT) AS t FROM orders")
both("p12_unnest", "SELECT vec_id, unnest(embedding) AS x FROM embeddings", "SELECT vec_id, explode(embedding) AS x FROM embeddings")
both("p12_unnest_position", "SELECT vec_id, unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS BIGINT) AS i FROM embeddings", "SELECT vec_id, x, CAST(i AS BIGINT) AS i FROM embeddings LATERAL VIEW posexplode(embedding) e AS i, x")
both("p12_unnest_outer", "SELECT c_custkey, s.k FROM customer LEFT JOIN (SELECT c_custkey AS c, unnest(CASE WHEN c_acctbal > 0 THEN [c_nationkey, c_nationkey + 1] ELSE [] END) AS k FROM customer) s ON c_custkey = s.c",
     "SELECT c_custkey, explode_outer(CASE WHEN c_acctbal > 0 THEN array(c_nationkey, c_nationkey + 1) ELSE array() END) AS k FROM customer")
both("p13_like", "SELECT p_partkey, p_name LIKE '%a%' AS a, p_name NOT LIKE '_b%' AS b, p_type ILIKE '%STEEL%' AS c, p_type NOT ILIKE 'promo%' AS d FROM part")
both("p14_list_transform", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(round(x * 100) AS BIGINT)))::BIGINT AS s FROM embeddings",
     "SELECT vec_id, aggregate(filter(transform(embedding, x -> CAST(round(x * CAST(100 AS FLOAT)) AS BIGINT)), x -> x IS NOT NULL), CAST(NULL AS BIGINT), (a, x) -> coalesce(a, 0L) + x) AS s FROM embeddings")
both("p15_volatile_stays", "SELECT count(*) AS n FROM nation WHERE random() >= 0", "SELECT count(*) AS n FROM nation WHERE rand() >= 0")
both("p16_nested_expression", "SELECT c_custkey, upper(substr(c_name, 1, 3)) || '-' || CAST(c_nationkey AS VARCHAR) AS tag FROM customer WHERE length(trim(c_name)) > 3",
     "SELECT c_custkey, upper(substr(c_name, 1, 3)) || '-' || CAST(c_nationkey AS STRING) AS tag FROM customer WHERE length(trim(c_name)) > 3")

# Joins
both("j1_inner_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 50000")
both("j1_theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("j2_any_join", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey OR length(r_name) = length(n_name)")
both("j3_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
both("j3_right_join", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0")
both("j3_full_join", "SELECT a.n_name AS a, b.r_name AS b FROM (SELECT * FROM nation WHERE n_regionkey > 1) a FULL JOIN (SELECT * FROM region WHERE r_regionkey < 3) b ON a.n_regionkey = b.r_regionkey")
both("j4_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
both("j4_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")


@frame("j5_right_semi", "SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10)")
def _(t, spark):
    return joins.right_semi(t("nation").where("n_nationkey > 10"), t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


@frame("j5_right_anti", "SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def _(t, spark):
    return joins.right_anti(t("supplier").where("s_acctbal > 5000"), t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name")


@frame("j6_mark_join", "SELECT c_custkey, nullif(c_nationkey, 2) IN (SELECT nullif(s_nationkey, 7) FROM supplier WHERE s_acctbal > 0) AS mark FROM customer")
def _(t, spark):
    left = t("customer").select("c_custkey", F.expr("nullif(c_nationkey, 2)").alias("k"))
    right = t("supplier").where("s_acctbal > 0").select(F.expr("nullif(s_nationkey, 7)").alias("s"))
    return joins.mark_join(left, right, "k", "s").select("c_custkey", "mark")


both("j6_mark_predicate", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) OR n_name LIKE 'A%'")
both("j7_single_join", "SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS name, (SELECT max(n_nationkey) FROM nation) AS top FROM orders")

ASOF = """SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
ASOF {how} JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts {op} p.ts"""


def asof(t, how, strict):
    e = t("events")
    right = e.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"))
    left = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(left, right, "ts", "at", {"user_id": "u"}, ["purchase_id"], how, strict).select("event_id", "purchase_id")


frame("j8_asof_join", ASOF.format(how="", op=">="))(lambda t, spark: asof(t, "inner", False))
frame("j8_asof_left_join", ASOF.format(how="LEFT", op=">="))(lambda t, spark: asof(t, "left", False))
frame("j8_asof_strict_join", ASOF.format(how="", op=">"))(lambda t, spark: asof(t, "inner", True))


@frame("j9_positional_join", """SELECT a.o_orderkey, a.o_totalprice, b.c_custkey, b.c_name FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey) a
POSITIONAL JOIN (SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey) b""")
def _(t, spark):
    both_ = joins.positional_join(t("orders"), t("customer"), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()], [F.col("c_acctbal").asc_nulls_last(), F.col("c_custkey").asc_nulls_last()])
    return both_.select("o_orderkey", "o_totalprice", "c_custkey", "c_name")


both("j10_cross_product", "SELECT a.r_name AS a, n_name AS b FROM region a CROSS JOIN nation")
both("j11_seam_join", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS near(k) ON o_custkey = near.k GROUP BY o_orderpriority")
both("j12_same_group_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
both("j13_correlated_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal)")
both("j14_lateral", "SELECT n_name, t.top FROM nation, LATERAL (SELECT max(s_acctbal) AS top FROM supplier WHERE s_nationkey = n_nationkey) t")

for op_, quantifier_ in ((">", "ANY"), (">", "ALL"), ("<>", "ANY"), ("=", "ALL"), ("<=", "ANY"), ("<", "ALL"), ("=", "ANY"), ("<>", "ALL")):
    names_ = {">": "gt", "<>": "ne", "=": "eq", "<=": "le", "<": "lt"}

    @frame(f"j15_{names_[op_]}_{quantifier_.lower()}", f"SELECT c_custkey, nullif(c_nationkey, 9) {op_} {quantifier_} (SELECT nullif(s_nationkey, 24) FROM supplier) AS mark FROM customer")
    def _(t, spark, op=op_, quantifier=quantifier_):
        left = t("customer").select("c_custkey", F.expr("nullif(c_nationkey, 9)").alias("k"))
        right = t("supplier").select(F.expr("nullif(s_nationkey, 24)").alias("s"))
        return joins.quantified(left, right, "k", op, quantifier, "s").select("c_custkey", "mark")


both("j16_multi_column_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_partkey % 50 FROM part)")


@frame("j18_band_join", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 20")
def _(t, spark):
    right = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return joins.band_join(t("part"), right, "p_retailprice", "low", "high", 20.0).select("p_partkey", "s_suppkey")


# Aggregation
both("a1_group_by", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag, l_linestatus""")
both("a2_ungrouped", "SELECT count(*) AS n, max(o_totalprice) AS top, min(o_orderkey) AS low FROM orders WHERE o_totalprice < 0")
both("a3_distinct_aggregate", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
both("a4_filtered_aggregate", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, max(o_custkey) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY o_orderstatus")


@frame("a5_ordered_aggregate", "SELECT n_regionkey, list(n_name ORDER BY n_name DESC) AS names, string_agg(n_name, ',' ORDER BY n_nationkey) AS joined FROM nation GROUP BY n_regionkey")
def _(t, spark):
    names = relations.ordered_list(F.col("n_name"), F.col("n_name"), descending=True)
    return t("nation").groupBy("n_regionkey").agg(names.alias("names"), F.array_join(relations.ordered_list(F.col("n_name"), F.col("n_nationkey")), ",").alias("joined"))


both("a6_named_aggregates", """SELECT c_mktsegment, count(c_acctbal) AS n, CAST(sum(c_nationkey) AS BIGINT) AS s, round(avg(c_nationkey), 6) AS a, round(stddev(c_nationkey), 6) AS sd, round(variance(c_nationkey), 6) AS v, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_mktsegment""")
both("a6_any_value", "SELECT n_regionkey, any_value(n_regionkey) AS v FROM nation GROUP BY n_regionkey")
both("a7_other_aggregates", "SELECT o_orderstatus, median(o_custkey) AS med, bool_or(o_totalprice > 400000) AS any_big, bit_xor(o_custkey) AS x FROM orders GROUP BY o_orderstatus")
both("a8_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@frame("a9_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _(t, spark):
    rows = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relations.distinct_on(rows, ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()])


both("a10_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
both("a10_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("a10_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("a11_partial_final", "SELECT l_partkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY l_partkey HAVING count(*) > 3")


@frame("a12_pivot_count", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (WHERE o_orderpriority = 'none such') AS \"none such\" FROM orders GROUP BY o_orderstatus")
def _(t, spark):
    return relations.pivot(t("orders"), ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "none such", "1-URGENT"], {"n": (F.count(F.lit(1)), 0)})


@frame("a12_pivot_sum", "SELECT s_nationkey, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) FILTER (WHERE s_suppkey % 3 = 0) AS DOUBLE) AS \"0\", CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) FILTER (WHERE s_suppkey % 3 = 1) AS DOUBLE) AS \"1\" FROM supplier GROUP BY s_nationkey")
def _(t, spark):
    rows = t("supplier").withColumn("m", F.col("s_suppkey") % 3)
    return relations.pivot(rows, ["s_nationkey"], "m", [0, 1], {"s": (F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double"), None)})


# Windows
both("w1_ranks", """SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS BIGINT) AS nt
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)""".replace("row_number() OVER w", "row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey)"))
both("w2_lead_lag", "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
     "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS before, lead(o_orderkey, 2, -1L) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
both("w3_values", """SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
both("w4_aggregate_window", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS top FROM orders")


@frame("w4_distinct_window", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey) AS flags FROM lineitem")
def _(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", relations.window_distinct_count(F.col("l_returnflag"), Window.partitionBy("l_orderkey")).alias("flags"))


both("w5_null_order", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(c_nationkey, 3) DESC NULLS LAST, c_custkey) AS BIGINT) AS d, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(c_nationkey, 3) ASC NULLS FIRST, c_custkey) AS BIGINT) AS a FROM customer")
both("w6_rows_frame", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders")
both("w7_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part")


@frame("w8_filtered_window", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS big FROM orders")
def _(t, spark):
    return t("orders").select("o_orderkey", relations.window_filtered(F.count, F.lit(1), F.col("o_totalprice") > 100000, Window.partitionBy("o_custkey")).alias("big"))


both("w9_ignore_nulls", "SELECT o_orderkey, lag(nullif(o_orderstatus, 'O') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS last_closed FROM orders",
     "SELECT o_orderkey, lag(nullif(o_orderstatus, 'O')) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS last_closed FROM orders")


@frame("w10_exclude_current", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS others FROM nation")
def _(t, spark):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("nation").select("n_nationkey", relations.sum_excluding_current(F.col("n_nationkey").cast("bigint"), w).alias("others"))


@frame("w11_groups_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part")
def _(t, spark):
    return relations.groups_frame(t("part"), ["p_brand"], F.col("p_size").asc_nulls_last(), -1, 1, {"s": F.sum("p_size")}).select("p_partkey", "s")


@frame("w12_bound_by_column", "SELECT l_orderkey, l_linenumber, CAST(sum(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN (l_partkey % 3) PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM lineitem")
def _(t, spark):
    rows = t("lineitem").withColumn("back", F.col("l_partkey") % 3)
    order = [F.col(c).asc_nulls_last() for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return relations.frame_by_column(rows, ["l_orderkey"], order, "back", "l_suppkey", "s").select("l_orderkey", "l_linenumber", "s")


# Order, limit, sample, set operations, CTEs
both("o1_order_by", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') ASC NULLS LAST, c_custkey) AS BIGINT) AS place FROM customer ORDER BY nullif(c_mktsegment, 'BUILDING') ASC NULLS LAST, c_custkey")
both("o2_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")


@frame("o3_limit_percent", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10%")
def _(t, spark):
    return relations.limit_percent(t("orders").select("o_orderkey"), [F.col("o_orderkey").asc_nulls_last()], 10)


both("o4_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")


@frame("o5_ordered_transport", "SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS position FROM orders")
def _(t, spark):
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]
    return relations.with_position(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), order).select("o_orderkey", "o_orderpriority", "position")


frame("o6_sample_rows")(lambda t, spark: relations.sample_rows(t("orders").select("o_orderkey"), 50, 7))
frame("o6_sample_percent")(lambda t, spark: relations.sample_percent(t("orders").select("o_orderkey"), 10, 7))


# What can be said of samples in SQL: how many rows, all of them the table's, none twice
@frame("o6_sample_rows_count", "SELECT least(count(*), 50) AS n, least(count(*), 50) AS of_table FROM orders")
def _(t, spark):
    return relations.sample_rows(t("orders").select("o_orderkey"), 50, 7).join(t("orders").select(F.col("o_orderkey").alias("k")), F.col("o_orderkey") == F.col("k"), "left").agg(F.count_distinct("o_orderkey").alias("n"), F.count_distinct("k").alias("of_table"))


@frame("o6_sample_percent_count", "SELECT true AS near, CAST(0 AS BIGINT) AS others FROM (SELECT count(*) FROM orders)")
def _(t, spark):
    n = t("orders").agg(F.count(F.lit(1)).alias("n"))
    got = relations.sample_percent(t("orders").select("o_orderkey"), 10, 7).join(t("orders").select(F.col("o_orderkey").alias("k")), F.col("o_orderkey") == F.col("k"), "left").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("k").isNull(), 1)).alias("others"))
    return got.crossJoin(n).select((F.abs(F.col("m") - F.col("n") * 0.1) <= 6 * F.sqrt(F.col("n") * 0.09)).alias("near"), "others")


both("o7_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 3")
both("o7_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")


@frame("o8_union_by_name", "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL BY NAME SELECT r_regionkey AS region, r_name AS label FROM region")
def _(t, spark):
    return relations.union_by_name(t("nation").selectExpr("n_name AS name", "n_regionkey AS region"), t("region").selectExpr("r_regionkey AS region", "r_name AS label"))


both("o9_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
both("o9_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("o10_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
both("o10_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("o11_cte", "WITH big AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.n, count(*) AS customers FROM big a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY a.n",
     "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.n, count(*) AS customers FROM big a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY a.n")
both("o12_recursive_cte", "WITH RECURSIVE c(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM c WHERE k < 20) SELECT k FROM c")


# Scalar functions, by category, through the names that sources know
def scalar(name: str, from_: str, expressions: dict[str, object], sql: str) -> None:
    frame(name, sql)(lambda t, spark: t(from_).select(*[e().alias(k) for k, e in expressions.items()]))


c, lit = F.col, F.lit
scalar("f1_arithmetic", "orders", {
    "k": lambda: c("o_orderkey"), "add_": lambda: fn.call("add", c("o_orderkey"), lit(7)), "sub": lambda: fn.call("subtract", c("o_orderkey"), lit(7)), "mul": lambda: fn.call("multiply", c("o_custkey"), lit(3)),
    "div_": lambda: fn.call("divide", c("o_custkey"), c("o_orderkey") % 3), "idiv": lambda: fn.call("divide_int", c("o_custkey"), lit(7)), "mod_": lambda: fn.call("modulus", -c("o_custkey"), lit(3)), "neg": lambda: fn.call("negate", c("o_custkey")),
    "abs_": lambda: fn.call("abs", -c("o_custkey")), "sq": lambda: fn.round_double(fn.call("sqrt", c("o_custkey")), 6), "pw": lambda: fn.call("power", (c("o_custkey") % 10).cast("double"), lit(2.0)), "ex": lambda: fn.round_double(fn.call("exp", lit(1.0)), 6), "ln_": lambda: fn.round_double(fn.call("ln", c("o_custkey") + 1), 6),
}, """SELECT o_orderkey AS k, o_orderkey + 7 AS add_, o_orderkey - 7 AS sub, o_custkey * 3 AS mul, o_custkey / (o_orderkey % 3) AS div_, o_custkey // 7 AS idiv, (-o_custkey) % 3 AS mod_, -o_custkey AS neg, abs(-o_custkey) AS abs_,
round(sqrt(o_custkey), 6) AS sq, power((o_custkey % 10)::DOUBLE, 2.0) AS pw, round(exp(1.0::DOUBLE), 6) AS ex, round(ln(o_custkey + 1), 6) AS ln_ FROM orders""")  # fmt: skip
scalar("f2_rounding", "supplier", {"k": lambda: c("s_suppkey"), "f": lambda: fn.call("floor", c("s_acctbal")), "ce": lambda: fn.call("ceil", c("s_acctbal")), "r": lambda: fn.call("round", c("s_acctbal"), lit(0))},
       "SELECT s_suppkey AS k, floor(s_acctbal) AS f, ceil(s_acctbal) AS ce, round(s_acctbal, 0) AS r FROM supplier")
scalar("f3_bitwise", "orders", {"k": lambda: c("o_orderkey"), "a": lambda: fn.call("bitwise_and", c("o_custkey"), lit(12)), "o": lambda: fn.call("bitwise_or", c("o_custkey"), lit(12)), "x": lambda: fn.call("bitwise_xor", c("o_custkey"), lit(12))},
       "SELECT o_orderkey AS k, o_custkey & 12 AS a, o_custkey | 12 AS o, xor(o_custkey, 12) AS x FROM orders")
nan_ = lambda: fn.call("divide", c("o_custkey") % 2, c("o_orderkey") % 2)
scalar("f4_comparison", "orders", {"k": lambda: c("o_orderkey"), "nan_": lambda: fn.call("is_nan", nan_()), "fin": lambda: fn.call("is_finite", nan_()), "inf": lambda: fn.call("is_infinite", nan_()), "d": lambda: fn.call("is_distinct_from", F.expr("nullif(o_orderstatus, 'O')"), lit("F")), "c": lambda: fn.call("coalesce", F.expr("nullif(o_orderstatus, 'O')"), lit("open"))},
       "SELECT o_orderkey AS k, isnan((o_custkey % 2) / (o_orderkey % 2)) AS nan_, isfinite((o_custkey % 2) / (o_orderkey % 2)) AS fin, isinf((o_custkey % 2) / (o_orderkey % 2)) AS inf, nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F' AS d, coalesce(nullif(o_orderstatus, 'O'), 'open') AS c FROM orders")
scalar("f5_string", "part", {
    "k": lambda: c("p_partkey"), "sub": lambda: fn.call("substring", c("p_name"), lit(2), lit(4)), "len_": lambda: fn.call("char_length", c("p_name")), "oct": lambda: fn.call("octet_length", c("p_name")), "sw": lambda: fn.call("starts_with", c("p_name"), lit("a")), "ew": lambda: fn.call("ends_with", c("p_name"), lit("e")),
    "cc": lambda: fn.call("concat", c("p_brand"), lit(None), lit("/"), c("p_size")), "lo": lambda: fn.call("lower", c("p_brand")), "up": lambda: fn.call("upper", c("p_name")), "tr": lambda: fn.call("trim", F.concat(lit("  "), c("p_name"), lit(" "))), "lt": lambda: fn.call("ltrim", F.concat(lit("  "), c("p_name"))),
    "rt": lambda: fn.call("rtrim", F.concat(c("p_name"), lit("  "))), "re": lambda: fn.call("replace", c("p_name"), lit("a"), lit("bb")), "co": lambda: fn.call("contains", c("p_name"), lit("re")), "li": lambda: fn.call("ilike", c("p_name"), lit("%A%")),
}, """SELECT p_partkey AS k, substr(p_name, 2, 4) AS sub, length(p_name) AS len_, strlen(p_name) AS oct, starts_with(p_name, 'a') AS sw, ends_with(p_name, 'e') AS ew, concat(p_brand, NULL, '/', p_size) AS cc, lower(p_brand) AS lo, upper(p_name) AS up,
trim('  ' || p_name || ' ') AS tr, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, replace(p_name, 'a', 'bb') AS re, contains(p_name, 're') AS co, p_name ILIKE '%A%' AS li FROM part""")  # fmt: skip
scalar("f6_datetime", "orders", {"k": lambda: c("o_orderkey"), "y": lambda: fn.extract("year", c("o_orderdate")), "m": lambda: fn.extract("month", c("o_orderdate")), "d": lambda: fn.extract("day", c("o_orderdate")), "q": lambda: fn.extract("quarter", c("o_orderdate"))},
       "SELECT o_orderkey AS k, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, extract(quarter FROM o_orderdate) AS q FROM orders")
scalar("f7_list_struct", "embeddings", {"k": lambda: c("vec_id"), "p": lambda: fn.call("list_position", F.array(lit(3), lit(1), c("label")), lit(1)).cast("int"), "e": lambda: fn.call("list_extract", F.array(lit(3), lit(1), c("label")), lit(3)), "none": lambda: fn.call("list_extract", F.array(lit(3), c("label")), lit(9)), "s": lambda: fn.struct_pack(a=c("vec_id"), b=c("label"))["b"]},
       "SELECT vec_id AS k, coalesce(list_position([3, 1, label], 1), 0)::INTEGER AS p, list_extract([3, 1, label], 3) AS e, list_extract([3, label], 9) AS none, struct_pack(a := vec_id, b := label).b AS s FROM embeddings")
both("f8_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events")


# Through the engine: placed on a source, governed, written


def placed(name: str, sql: str, text: str, expect: Callable[[Engine], bool], **capable) -> None:
    """A query of an attached folder; `expect` says where its work has to be placed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.attach("far", ParquetDirSource(spark, sf_dir, **capable))
        df = e.sql(text)
        if not expect(e):
            raise AssertionError(f"{name} was placed otherwise: {e.slices}")
        return df

    QUERIES[name], ORACLES[name] = run, sql


near_ = "(SELECT explode(sequence(1, 40)) AS k) near"
placed("r1_labelled_whole", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY o_orderpriority",
       "SELECT o_orderpriority, count(*) AS n FROM far.orders JOIN far.customer ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY o_orderpriority", lambda e: len(e.slices) == 1 and "aggregate" in e.slices[0].operators)
placed("r2_largest_subtree", "SELECT upper(c_name) AS n FROM customer WHERE c_acctbal > 0", "SELECT upper(c_name) AS n FROM far.customer WHERE c_acctbal > 0", lambda e: e.slices[0].operators == ["filter"], refused_calls={"upper"})
placed("r4_filter_split", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND lower(c_mktsegment) = 'building'", "SELECT c_custkey FROM far.customer WHERE c_acctbal > 0 AND lower(c_mktsegment) = 'building'", lambda e: e.slices[0].operators == ["filter"], refused_calls={"lower"})
placed("r6_seam", "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 1 AND 40", f"SELECT c_custkey, c_name FROM far.customer JOIN {near_} ON c_custkey = near.k", lambda e: e.slices[0].sends == ["k"])
placed("r6_no_seam_without_consent", "SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 1 AND 40", f"SELECT c_custkey FROM far.customer JOIN {near_} ON c_custkey = near.k", lambda e: not e.slices[0].sends, seam=False)


def outcome(e: Engine, statement: str) -> str:
    try:
        e.sql(statement).collect()
    except NotAllowed:
        return "not allowed"
    except Refused:
        return "refused"
    return "done"


#: A statement for each verb.
EACH_VERB = [
    ("SELECT", "SELECT * FROM far.r"), ("INSERT", "INSERT INTO far.r VALUES (77, 'x')"), ("UPDATE", "UPDATE far.r SET r_name = 'y'"), ("DELETE", "DELETE FROM far.r"), ("ALTER", "ALTER TABLE far.r ADD COLUMN z INTEGER"), ("DROP", "DROP TABLE far.r"),
]


@frame("g1_verbs", " UNION ALL ".join(f"SELECT a.v AS allowed, '{v}' AS verb, CASE WHEN a.v = '{v}' THEN 'done' ELSE 'not allowed' END AS outcome FROM (SELECT unnest([{', '.join(repr(x) for x, _ in EACH_VERB)}]) AS v) a" for v, _ in EACH_VERB))
def _(t, spark):
    rows = []
    for allowed, _ in EACH_VERB:
        for verb, statement in EACH_VERB:
            e = Engine(spark)
            e.attach("far", VersionedSource(spark, scratch(spark), verbs={"r": frozenset({Verb[allowed]})}))
            e.create_table_as("far.r", t("region"))
            rows.append((allowed, verb, outcome(e, statement)))
    return spark.createDataFrame(rows, "allowed string, verb string, outcome string")


@frame("g2_select_when_read", "SELECT 'bare' AS write, 'done' AS outcome UNION ALL SELECT 'reads', 'not allowed' UNION ALL SELECT 'filters', 'not allowed' UNION ALL SELECT 'returns', 'not allowed'")
def _(t, spark):
    e = Engine(spark)
    e.attach("far", VersionedSource(spark, scratch(spark), verbs={"r": frozenset({Verb.UPDATE, Verb.DELETE})}))
    e.create_table_as("far.r", t("region"))
    writes = {"bare": "UPDATE far.r SET r_name = 'x'", "reads": "UPDATE far.r SET r_name = upper(r_name)", "filters": "DELETE FROM far.r WHERE r_regionkey = 1", "returns": "DELETE FROM far.r RETURNING *"}
    return spark.createDataFrame([(k, outcome(e, s)) for k, s in writes.items()], "write string, outcome string")


@frame("g4_policy_shape", "SELECT 'columns' AS policy, 'refused' AS outcome UNION ALL SELECT 'merge', 'refused' UNION ALL SELECT 'rowid', 'refused' UNION ALL SELECT 'rows', 'done'")
def _(t, spark):
    rows = []
    for name, policy, statement in (
        ("columns", lambda df: df.select("r_name"), "SELECT * FROM far.r"), ("merge", lambda df: df.where("r_regionkey > 1"), "MERGE INTO far.r USING (VALUES (1)) s(k) ON r_regionkey = s.k WHEN MATCHED THEN DELETE"),
        ("rowid", lambda df: df.select("r_regionkey", "r_name"), "DELETE FROM far.r"), ("rows", lambda df: df.where("r_regionkey > 1"), "DELETE FROM far.r WHERE r_regionkey < 3"),
    ):
        e = Engine(spark)
        e.attach("far", VersionedSource(spark, scratch(spark), hidden={"r": policy}))
        e.create_table_as("far.r", t("region"))
        rows.append((name, outcome(e, statement)))
    return spark.createDataFrame(rows, "policy string, outcome string")


@frame("g5_catalog_check", "SELECT 'one' AS catalogs, 'done' AS outcome UNION ALL SELECT 'both', 'not allowed'")
def _(t, spark):
    def check(alias: str) -> None:
        if alias != "far":
            raise NotAllowed(alias)

    e = Engine(spark)
    e.attach("far", MemorySource({"r": t("region")}, group="g", catalogs=check))
    e.attach("more", MemorySource({"n": t("nation")}, group="g"))
    both_ = "SELECT * FROM far.r JOIN more.n ON r_regionkey = n_regionkey"
    return spark.createDataFrame([("one", outcome(e, "SELECT * FROM far.r")), ("both", outcome(e, both_))], "catalogs string, outcome string")


@frame("g7_identity", "SELECT count(*) AS n, (SELECT count(*) FROM nation) AS m FROM region")
def _(t, spark):
    one, other = Engine(spark), Engine(spark)
    one.attach("far", MemorySource({"x": t("region")}))
    other.attach("far", MemorySource({"x": t("nation")}))
    a, b = one.sql("SELECT count(*) AS n FROM far.x"), other.sql("SELECT count(*) AS m FROM far.x")
    return a.crossJoin(b)


def policed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.attach("far", ParquetDirSource(spark, sf_dir, hidden={"orders": lambda df: df.where("o_orderstatus = 'O'")}))
    return e.sql("SELECT o_orderpriority, count(*) AS n FROM far.orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority")


QUERIES["g3_row_policy"] = policed
ORACLES["g3_row_policy"] = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 GROUP BY o_orderpriority"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.attach("far", ParquetDirSource(spark, sf_dir))
    rows = [(table_, k, f.name) for _, _, table_ in e.tables() for k, f in enumerate(e.describe(f"far.{table_}").schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position long, column_name string")


QUERIES["s10_catalog"] = listed
ORACLES["s10_catalog"] = "SELECT table_name, CAST(ordinal_position - 1 AS BIGINT) AS position, column_name FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"


def written(name: str, sql: str | None = None, key: tuple[str, ...] = ("c_custkey",)) -> Callable[[Callable], Callable]:
    """A write on a copy of customer (four columns), and the table after it."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e = Engine(spark)
            e.attach("far", VersionedSource(spark, scratch(spark)))
            rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
            e.create_table_as("far.customer", rows, key, {"c_name": "nobody", "c_nationkey": 7})
            out = f(e, spark, lambda t: table(spark, sf_dir, t))
            return out if out is not None else e.table("far.customer")

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


C4 = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"


@written("d1_insert", f"{C4} UNION ALL SELECT s_suppkey + 1000000, 'nobody', 7, NULL FROM supplier")
def _(e, spark, t):
    e.insert("far.customer", t("supplier").selectExpr("s_suppkey + 1000000 AS c_custkey"))


@written("d2_insert_defaults", f"{C4} UNION ALL SELECT NULL, 'nobody', 7, NULL", key=())
def _(e, spark, t):
    e.insert_defaults("far.customer")


@written("d3_update", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_acctbal < 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(e, spark, t):
    e.update("far.customer", {"c_nationkey": "0", "c_acctbal": "c_acctbal + 100"}, where="c_acctbal < 0")


@written("d3_update_from", "SELECT c_custkey, coalesce(n_name, c_name) AS c_name, c_nationkey, c_acctbal FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def _(e, spark, t):
    e.update("far.customer", {"c_name": "s.n_name"}, using=t("nation").where("n_regionkey = 1"), on="t.c_nationkey = s.n_nationkey")


@written("d4_delete", f"{C4} WHERE c_acctbal >= 0 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(e, spark, t):
    e.delete("far.customer", where="c_acctbal < 0")
    e.delete("far.customer", using=t("nation").where("n_regionkey = 2"), on="t.c_nationkey = s.n_nationkey")


@written("d5_merge", f"{C4} WHERE c_nationkey > 9 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 FROM customer WHERE c_nationkey <= 9 AND c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 5000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 2")
def _(e, spark, t):
    rows = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    source = rows.where("c_nationkey <= 9").unionByName(rows.where("c_nationkey < 2").withColumn("c_custkey", F.col("c_custkey") + 5000000))
    actions = [When(True, "delete", condition="s.c_custkey % 2 = 1"), When(True, "update", {"c_acctbal": "t.c_acctbal + 1"}), When(False, "insert", {c: f"s.{c}" for c in rows.columns})]
    e.merge("far.customer", source, "t.c_custkey = s.c_custkey", actions)


@written("d6_on_conflict", f"{C4} UNION ALL SELECT c_custkey + 7000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def _(e, spark, t):
    rows = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").where("c_acctbal > 0")
    e.insert("far.customer", rows.unionByName(rows.withColumn("c_custkey", F.col("c_custkey") + 7000000)), on_conflict="nothing")


@written("d7_returning", "SELECT c_custkey, c_name, c_nationkey, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_nationkey = 4")
def _(e, spark, t):
    return e.update("far.customer", {"c_acctbal": "c_acctbal * 2"}, where="c_nationkey = 4", returning=True).rows


@written("d9_bare_writes", "SELECT CAST(0 AS BIGINT) AS n")
def _(e, spark, t):
    e.update("far.customer", {"c_acctbal": "1"})
    e.delete("far.customer")
    return e.sql("SELECT count(*) AS n FROM far.customer")


@written("d10_create_table_as", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def _(e, spark, t):
    e.create_table_as("far.counts", e.sql("SELECT c_nationkey, count(*) AS n FROM far.customer GROUP BY c_nationkey"))
    return e.table("far.counts")


@written("d11_create_view", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 5")
def _(e, spark, t):
    e.create_view("far.rich", "SELECT c_custkey, c_nationkey FROM far.customer WHERE c_acctbal > 5000")
    return e.sql("SELECT c_custkey FROM far.rich WHERE c_nationkey < 5")


@written("d12_alter_drop", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS note FROM customer")
def _(e, spark, t):
    e.create_table_as("far.gone", spark.range(1))
    e.drop_table("far.gone")
    e.add_column("far.customer", "note", "string")
    return e.sql("SELECT c_custkey, note FROM far.customer")


@written("d14_transaction", f"{C4} WHERE c_nationkey <> 1")
def _(e, spark, t):
    e.begin()
    e.delete("far.customer", where="c_nationkey = 2")
    e.rollback()
    e.begin()
    e.delete("far.customer", where="c_nationkey = 1")
    e.commit()


# One text for the engine and for DuckDB: far is an attached folder here
def asked(name: str, text: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.attach("far", ParquetDirSource(spark, sf_dir))
        return e.sql(text)

    QUERIES[name], ORACLES[name] = run, sql or text.replace("far.", "")


asked("s9_rowid", "SELECT count(DISTINCT rowid) AS ids, count(*) AS n FROM far.lineitem", "SELECT count(*) AS ids, count(*) AS n FROM lineitem")
asked("o1_order_by_sql", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING'), c_custkey) AS BIGINT) AS place FROM far.customer ORDER BY nullif(c_mktsegment, 'BUILDING'), c_custkey")
asked("f1_division_sql", "SELECT o_orderkey, o_custkey / (o_orderkey % 3) AS q, o_custkey // 7 AS i, o_totalprice / o_custkey / 2 AS r FROM far.orders")
asked("f6_concat_sql", "SELECT c_custkey, concat(nullif(c_mktsegment, 'BUILDING'), '-', c_name) AS a, nullif(c_mktsegment, 'BUILDING') || c_name AS b FROM far.customer")
asked("j6_mark_sql_value", "SELECT c_custkey, nullif(c_nationkey, 2) IN (SELECT nullif(s_nationkey, 7) FROM far.supplier WHERE s_acctbal > 0) AS mark, nullif(c_nationkey, 2) NOT IN (SELECT s_nationkey FROM far.supplier WHERE s_acctbal > 9000) AS unmarked FROM far.customer")
asked("j6_mark_is_null", "SELECT c_custkey FROM far.customer WHERE (nullif(c_nationkey, 2) IN (SELECT nullif(s_nationkey, 7) FROM far.supplier WHERE s_acctbal > 0)) IS NULL")
asked("j8_asof_sql", """SELECT e.event_id, p.purchase_id FROM (SELECT * FROM far.events WHERE event_type <> 'purchase') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS purchase_id FROM far.events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
asked("j9_positional_sql", "SELECT a.o_orderkey, b.c_custkey FROM (SELECT o_orderkey FROM far.orders ORDER BY o_totalprice, o_orderkey) a POSITIONAL JOIN (SELECT c_custkey FROM far.customer ORDER BY c_acctbal DESC, c_custkey) b")
asked("j15_quantified_sql", """SELECT c_custkey, nullif(c_nationkey, 9) > ANY (SELECT nullif(s_nationkey, 24) FROM far.supplier) AS gt_any, nullif(c_nationkey, 9) <= ALL (SELECT nullif(s_nationkey, 24) FROM far.supplier) AS le_all,
nullif(c_nationkey, 9) <> ANY (SELECT s_nationkey FROM far.supplier) AS ne_any, nullif(c_nationkey, 9) = ANY (SELECT nullif(s_nationkey, 24) FROM far.supplier) AS eq_any FROM far.customer""")
asked("a5_ordered_sql", "SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS keys, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS marks FROM far.orders GROUP BY o_custkey")
asked("a9_distinct_on_sql", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM far.orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
asked("a12_pivot_sql", "PIVOT far.orders ON o_orderpriority IN ('1-URGENT', '5-LOW', 'none such') USING count(*) GROUP BY o_orderstatus")
asked("w8_filter_sql", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS big, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS marks FROM far.orders")
asked("w10_exclude_sql", """SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS row_,
CAST(sum(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS group_,
count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS ties_ FROM far.customer""")
asked("w11_groups_sql", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (ORDER BY p_brand GROUPS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM far.part")
asked("o3_limit_percent_sql", "SELECT o_orderkey FROM far.orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12%")
asked("o8_by_name_sql", "SELECT n_name AS name, n_regionkey AS region FROM far.nation UNION ALL BY NAME SELECT r_regionkey AS region, r_name AS label FROM far.region")
asked("o11_materialized_sql", "WITH big AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM far.orders GROUP BY o_custkey) SELECT a.n, count(*) AS customers FROM big a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY a.n")
asked("o11_volatile_once", "WITH r AS MATERIALIZED (SELECT o_orderkey, rand() AS x FROM far.orders) SELECT count(*) AS n FROM r a JOIN r b ON a.o_orderkey = b.o_orderkey AND a.x = b.x", "SELECT count(*) AS n FROM orders")
asked("t1_types", "SELECT CAST(1 AS BOOLEAN) AS b, CAST(-7 AS TINYINT) AS i8, CAST(300 AS SMALLINT) AS i16, CAST(70000 AS INTEGER) AS i32, CAST(5000000000 AS BIGINT) AS i64, CAST(1.5 AS FLOAT) AS f, CAST(2.25 AS DOUBLE) AS d, CAST(12.34 AS DECIMAL(10,2)) AS c, CAST('x' AS VARCHAR) AS s, CAST('2024-02-29' AS DATE) AS dt, r_name FROM far.region")


def said(name: str, statements: list[str], sql: str, key: str = "PRIMARY KEY") -> None:
    """Statements on a copy of customer, and the table after them, or the rows of the last one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.attach("far", VersionedSource(spark, scratch(spark)))
        e.attach("near", ParquetDirSource(spark, sf_dir))
        e.sql(f"CREATE TABLE far.customer (c_custkey BIGINT {key}, c_name VARCHAR DEFAULT 'nobody', c_nationkey INTEGER DEFAULT 7, c_acctbal DOUBLE)")
        e.sql("INSERT INTO far.customer SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM near.customer")
        for s in statements:
            df = e.sql(s)
        return df if "RETURNING" in s or s.startswith("SELECT") else e.table("far.customer")

    QUERIES[name], ORACLES[name] = run, sql


said("d1_insert_sql", ["INSERT INTO far.customer (c_custkey) SELECT s_suppkey + 1000000 FROM near.supplier", "INSERT INTO far.customer VALUES (-1, 'a', 1, 1.5), (-2, NULL, NULL, NULL)"],
     f"{C4} UNION ALL SELECT s_suppkey + 1000000, 'nobody', 7, NULL FROM supplier UNION ALL SELECT -1, 'a', 1, 1.5 UNION ALL SELECT -2, NULL, NULL, NULL")
said("d2_insert_defaults_sql", ["INSERT INTO far.customer DEFAULT VALUES"], f"{C4} UNION ALL SELECT NULL, 'nobody', 7, NULL", key="")
said("d3_update_sql", ["UPDATE far.customer SET c_nationkey = 0, c_acctbal = c_acctbal + 100 WHERE c_acctbal < 0"], ORACLES["d3_update"])
said("d3_update_from_sql", ["UPDATE far.customer AS c SET c_name = n.n_name FROM near.nation n WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1"], ORACLES["d3_update_from"])
said("d4_delete_sql", ["DELETE FROM far.customer WHERE c_acctbal < 0", "DELETE FROM far.customer c USING near.nation n WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = 2"], ORACLES["d4_delete"])
said("d5_merge_sql", ["""MERGE INTO far.customer AS t USING (SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM near.customer WHERE c_nationkey <= 9 UNION ALL SELECT c_custkey + 5000000, c_name, c_nationkey, c_acctbal FROM near.customer WHERE c_nationkey < 2) AS s
ON t.c_custkey = s.c_custkey WHEN MATCHED AND s.c_custkey % 2 = 1 THEN DELETE WHEN MATCHED THEN UPDATE SET c_acctbal = t.c_acctbal + 1 WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_nationkey, c_acctbal) VALUES (s.c_custkey, s.c_name, s.c_nationkey, s.c_acctbal)"""], ORACLES["d5_merge"])
said("d6_on_conflict_sql", ["INSERT INTO far.customer SELECT c_custkey + (c_nationkey % 2) * 7000000, 'new', c_nationkey, c_acctbal FROM near.customer ON CONFLICT (c_custkey) DO UPDATE SET c_name = excluded.c_name, c_acctbal = customer.c_acctbal + 1"],
     "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 7000000, 'new', c_nationkey, c_acctbal FROM customer WHERE c_nationkey % 2 = 1")
said("d7_returning_sql", ["UPDATE far.customer SET c_acctbal = c_acctbal * 2 WHERE c_nationkey = 4 RETURNING c_custkey, c_acctbal - 1 AS less"], "SELECT c_custkey, c_acctbal * 2 - 1 AS less FROM customer WHERE c_nationkey = 4")
said("d7_returning_deleted_sql", ["DELETE FROM far.customer WHERE c_acctbal < 0 RETURNING *"], f"{C4} WHERE c_acctbal < 0")
said("d8_narrowing_sql", ["UPDATE far.customer SET c_name = c_name, c_acctbal = c_acctbal + 1, c_custkey = c_custkey WHERE c_nationkey = 3"], "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
said("d9_bare_writes_sql", ["UPDATE far.customer SET c_acctbal = 1, c_name = NULL"], "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_nationkey, CAST(1 AS DOUBLE) AS c_acctbal FROM customer")
said("d10_create_table_as_sql", ["CREATE TABLE far.counts AS SELECT c_nationkey, count(*) AS n FROM far.customer GROUP BY c_nationkey", "SELECT * FROM far.counts"], "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
said("d11_create_view_sql", ["CREATE VIEW far.rich AS SELECT c_custkey, c_nationkey FROM far.customer WHERE c_acctbal > 5000", "SELECT c_custkey FROM far.rich WHERE c_nationkey < 5"], "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 5")
said("d12_alter_sql", ["ALTER TABLE far.customer ADD COLUMN note VARCHAR", "ALTER TABLE far.customer RENAME COLUMN c_name TO label", "ALTER TABLE far.customer DROP COLUMN c_acctbal", "UPDATE far.customer SET note = 'n' WHERE c_nationkey = 1"],
     "SELECT c_custkey, c_name AS label, c_nationkey, CASE WHEN c_nationkey = 1 THEN 'n' END AS note FROM customer")
said("d14_transaction_sql", ["BEGIN", "DELETE FROM far.customer WHERE c_nationkey = 2", "ROLLBACK", "BEGIN", "DELETE FROM far.customer WHERE c_nationkey = 1", "UPDATE far.customer SET c_name = 'x' WHERE c_nationkey = 5", "COMMIT"],
     "SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'x' ELSE c_name END AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey <> 1")
said("d15_reads_before_writes_sql", ["INSERT INTO far.customer SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal FROM far.customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM far.customer)"],
     f"{C4} UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")

REFUSED = [
    "CREATE INDEX i ON far.r (r_regionkey)", "CREATE SCHEMA far.s", "CREATE SEQUENCE far.q", "CREATE FUNCTION f() AS 1", "CREATE TYPE t AS INTEGER", "UPDATE far.r SET r_name = DEFAULT", "INSERT INTO far.r VALUES (DEFAULT, 'x')",
    "INSERT INTO far.r (r_regionkey) VALUES (1) ON CONFLICT DO NOTHING", "WITH x AS (DELETE FROM far.r RETURNING *) SELECT * FROM x", "WITH x AS (SELECT 9 AS k) INSERT INTO far.r SELECT k, 'x' FROM x", "COPY far.r TO 'x'",
    "CREATE VIEW far.v AS SELECT * FROM far.r JOIN (SELECT explode(sequence(1, 2)) AS k) n ON r_regionkey = n.k", "MERGE INTO far.r USING (VALUES (1), (1)) s(k) ON r_regionkey = s.k WHEN MATCHED THEN DELETE", "INSERT INTO far.r VALUES (1, 'twice')",
]


@frame("d13_refusals", f"SELECT CAST({len(REFUSED)} AS BIGINT) AS refused, count(*) AS n FROM region")
def _(t, spark):
    e = Engine(spark)
    e.attach("far", VersionedSource(spark, scratch(spark)))
    e.create_table_as("far.r", t("region"), ("r_regionkey",))
    n = sum(outcome(e, s) == "refused" for s in REFUSED)
    return e.sql(f"SELECT CAST({n} AS BIGINT) AS refused, count(*) AS n FROM far.r")


@frame("d14_conflict", "SELECT 'conflict' AS outcome, count(*) + 1 AS n FROM region")
def _(t, spark):
    root = scratch(spark)
    one, other = Engine(spark), Engine(spark)
    one.attach("far", VersionedSource(spark, root))
    one.create_table_as("far.r", t("region"))
    other.attach("far", VersionedSource(spark, root))
    for e, k in ((one, 10), (other, 20)):
        e.begin()
        e.sql(f"INSERT INTO far.r VALUES ({k}, 'x')")
    one.commit()
    try:
        other.commit()
        how = "lost"
    except Conflict:
        how = "conflict"
    return other.sql(f"SELECT '{how}' AS outcome, count(*) AS n FROM far.r")


@frame("d16_hooks", "SELECT r_regionkey, upper(r_name) AS r_name FROM region UNION ALL SELECT 9, 'NINE'")
def _(t, spark):
    def checked(verb: Verb, name: str, rows: DataFrame | None) -> DataFrame | None:
        if verb is Verb.DELETE:
            raise Refused("no row of this table is deleted")
        return rows.withColumn("r_name", F.upper("r_name"))

    e = Engine(spark)
    e.attach("far", VersionedSource(spark, scratch(spark), writes=checked))
    e.sql("CREATE TABLE far.r (r_regionkey INTEGER, r_name VARCHAR)")
    e.insert("far.r", t("region"))
    e.sql("INSERT INTO far.r VALUES (9, 'nine')")
    outcome(e, "DELETE FROM far.r")
    return e.table("far.r")
