"""The same text on attached tables here and in DuckDB: equal rows."""

import duckdb
import pytest

from tidewater.engine import Engine
from tidewater.errors import Refused
from tidewater.sources import MemorySource, VersionedSource

QUERIES = [
    # where nulls stand
    "SELECT id, name FROM far.orders ORDER BY name",
    "SELECT id, name FROM far.orders ORDER BY name DESC, id",
    "SELECT id, name FROM far.orders ORDER BY name NULLS FIRST LIMIT 2",
    "SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM far.orders ORDER BY id",
    "SELECT id, row_number() OVER w AS r FROM far.orders WINDOW w AS (PARTITION BY tenant ORDER BY score DESC) ORDER BY id",
    # division and concat
    "SELECT id, amt / tenant AS q, amt / (tenant - 5) AS z, -amt / 0 AS m, 0 / 0 AS n, amt // 7 AS i FROM far.orders",
    "SELECT id, amt * 2 / tenant + 1 AS q, 100 / amt / 2 AS r, sum(amt) OVER () / count(*) OVER () AS a FROM far.orders",
    "SELECT id, concat(name, '-', id) AS c, name || '-' AS d FROM far.orders",
    """SELECT "id", o."name" AS "a b", 'x\\n\\' AS s, 'it''s' AS q, 'say "hi"' AS h FROM far."orders" o WHERE "amt" > 20""",
    # IN as a value
    "SELECT id, name IN (SELECT name FROM far.orders WHERE id < 13) AS m FROM far.orders",
    "SELECT id, name NOT IN (SELECT name FROM far.orders WHERE id < 13) AS m FROM far.orders",
    "SELECT id FROM far.orders WHERE (name IN (SELECT name FROM far.orders WHERE id < 13)) IS NULL",
    "SELECT id FROM far.orders WHERE NOT (name IN (SELECT name FROM far.orders WHERE id > 13))",
    "SELECT id FROM far.orders WHERE name NOT IN (SELECT name FROM far.orders WHERE id > 13)",
    "SELECT id FROM far.orders WHERE amt > 300 OR name IN (SELECT name FROM far.orders WHERE id < 13)",
    "SELECT id, CASE WHEN tenant IN (SELECT tenant FROM far.customers) THEN 'y' ELSE 'n' END AS c FROM far.orders",
    "SELECT id, tenant IN (SELECT tenant FROM far.customers WHERE tenant > 99) AS m FROM far.orders",
    "SELECT id FROM far.orders WHERE (tenant, amt) IN (SELECT tenant, amt FROM far.archive)",
    "SELECT id, id IN (11, 12) AS m FROM far.orders",
    # quantified comparisons
    "SELECT id FROM far.orders WHERE amt > ANY (SELECT amt FROM far.archive)",
    "SELECT id FROM far.orders WHERE amt >= ALL (SELECT amt FROM far.archive)",
    "SELECT id, tenant <> ANY (SELECT tenant FROM far.customers) AS a, tenant = ALL (SELECT tenant FROM far.customers WHERE tenant = 5) AS b, tenant = ANY (SELECT tenant FROM far.customers) AS c FROM far.orders",
    "SELECT id, score < ALL (SELECT score FROM far.orders) AS a, score <= ANY (SELECT score FROM far.orders) AS b, amt > ALL (SELECT amt FROM far.orders WHERE id > 99) AS c FROM far.orders",
    # DISTINCT ON, QUALIFY
    "SELECT DISTINCT ON (tenant) tenant, id, amt FROM far.orders ORDER BY tenant, amt DESC, id",
    "SELECT DISTINCT ON (tenant) id FROM far.orders ORDER BY tenant DESC, amt, id LIMIT 2",
    "SELECT id, tenant FROM far.orders QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY amt, id) = 1 ORDER BY id",
    # aggregates in order
    "SELECT tenant, list(name ORDER BY name) AS l, list(id ORDER BY amt DESC, id DESC) AS m, string_agg(name, '/' ORDER BY id DESC) AS s FROM far.orders GROUP BY tenant",
    "SELECT tenant, sum(amt ORDER BY id) AS s, count(name ORDER BY id) AS n FROM far.orders GROUP BY tenant",
    "SELECT tenant, first(id ORDER BY amt DESC, id DESC) AS f FROM far.orders GROUP BY tenant",
    # windows
    "SELECT id, count(*) FILTER (WHERE amt > 60) OVER (PARTITION BY tenant) AS n, sum(amt) FILTER (WHERE name IS NOT NULL) OVER (PARTITION BY tenant ORDER BY id) AS s FROM far.orders",
    "SELECT id, count(DISTINCT amt) OVER (PARTITION BY tenant) AS n FROM far.orders",
    "SELECT id, sum(amt) OVER (ORDER BY amt GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY tenant ORDER BY amt GROUPS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n FROM far.orders WHERE id < 16",
    "SELECT id, sum(amt) OVER (PARTITION BY tenant ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS s, count(*) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n FROM far.orders",
    "SELECT id, sum(amt) OVER (ORDER BY amt RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS g, sum(amt) OVER (ORDER BY amt RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS t, avg(amt) OVER (ORDER BY amt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS a, count(name) OVER (ORDER BY amt RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE NO OTHERS) AS o FROM far.orders",
    "SELECT id, max(amt) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS a, min(amt) OVER (PARTITION BY tenant ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS b FROM far.orders",
    # limits, sets, CTEs
    "SELECT id FROM far.orders ORDER BY id LIMIT 50%",
    "SELECT id FROM far.orders ORDER BY amt DESC, id LIMIT 34 PERCENT",
    "SELECT id, name FROM far.orders UNION ALL BY NAME SELECT cname AS name, tenant FROM far.customers",
    "SELECT tenant FROM far.orders UNION BY NAME SELECT tenant FROM far.customers ORDER BY tenant",
    "WITH c AS (SELECT tenant, cname AS name FROM far.customers) SELECT name, tenant FROM c UNION ALL BY NAME SELECT tenant FROM far.orders",
    "SELECT tenant FROM far.orders EXCEPT SELECT tenant FROM far.customers UNION ALL SELECT 1",
    "WITH t AS MATERIALIZED (SELECT tenant, sum(amt) AS s FROM far.orders GROUP BY tenant), u AS NOT MATERIALIZED (SELECT * FROM t) SELECT a.tenant, b.s FROM t a JOIN u b ON a.tenant = b.tenant",
    "SELECT * FROM (SELECT id FROM far.orders ORDER BY name LIMIT 3) ORDER BY id",
    # pivots
    "PIVOT far.sales ON quarter IN ('spring', 'summer', 'autumn') USING sum(amount) GROUP BY region",
    "PIVOT far.sales ON quarter IN ('spring', 'winter') USING count(*) AS n, sum(amount) AS s GROUP BY region",
    "PIVOT far.sales ON quarter USING count(*) GROUP BY region",
    "SELECT region, autumn FROM (PIVOT far.sales ON quarter IN ('autumn', 'spring') USING count(amount))",
    # joins that Spark lacks
    "SELECT o.id, a.id AS prior FROM far.orders o ASOF JOIN far.archive a ON o.tenant = a.tenant AND o.ts >= a.ts",
    "SELECT o.id, a.id AS prior, a.name FROM far.orders o ASOF LEFT JOIN far.archive a ON a.tenant = o.tenant AND a.ts < o.ts",
    "SELECT * FROM (SELECT id, tenant, amt FROM far.orders) o ASOF JOIN (SELECT tenant AS t, amt AS least FROM far.archive) a ON o.tenant = a.t AND o.amt >= a.least WHERE id > 11",
    "SELECT id, cname FROM (SELECT id FROM far.orders ORDER BY id) o POSITIONAL JOIN (SELECT cname FROM far.customers ORDER BY cname DESC) c",
    "SELECT count(*) AS n, max(c.cname) AS m FROM (SELECT id FROM far.orders ORDER BY id DESC) o POSITIONAL JOIN (SELECT cname FROM far.customers ORDER BY cname) c WHERE o.id > 13",
]


@pytest.fixture(scope="module")
def duck(seed):
    con = duckdb.connect()
    con.execute("ATTACH ':memory:' AS far")
    for name, df in seed.items():
        rows = df.toArrow()  # noqa: F841
        con.execute(f"CREATE TABLE far.{name} AS SELECT * FROM rows")
    return con


def canonical(rows):
    def value(x):
        return ("nan",) if isinstance(x, float) and x != x else round(float(x), 9) if isinstance(x, float) or type(x).__name__ in ("int", "Decimal") and not isinstance(x, bool) else list(map(value, x)) if isinstance(x, (list, tuple)) else x

    return [tuple(map(value, r)) for r in rows]


@pytest.mark.parametrize("sql", QUERIES)
def test_same_as_duckdb(spark, seed, duck, sql):
    e = Engine(spark)
    e.attach("far", MemorySource(seed))
    df = e.sql(sql)
    want = duck.execute(sql)
    names, rows = [d[0] for d in want.description], canonical(want.fetchall())
    assert [c.lower() for c in df.columns] == [c.lower() for c in names]
    got = canonical([tuple(r) for r in df.collect()])
    last = sql.upper().rpartition(")")[2] if "OVER" in sql.upper() else sql.upper()
    assert got == rows if "ORDER BY" in last and "GROUP BY" not in last.partition("ORDER BY")[2] and "JOIN" not in last else sorted(got, key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("sql", [
    "SELECT id, max(amt) OVER (ORDER BY id RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) FROM far.orders", "SELECT sum(amt) OVER (GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM far.orders",
    "SELECT * FROM (far.orders a ASOF JOIN far.archive b ON a.id = b.id AND a.ts >= b.ts) JOIN far.customers c ON a.tenant = c.tenant", "SELECT * FROM (SELECT id FROM far.orders LIMIT 10%)", "SELECT (id, amt) IN (SELECT id, amt FROM far.archive) FROM far.orders", "SELECT a.id FROM far.orders a ASOF JOIN far.archive b ON a.id = b.id",
    "SELECT a.id FROM far.orders a JOIN far.customers c ON a.tenant = c.tenant ASOF JOIN far.archive b ON a.ts >= b.ts", "SELECT list(id ORDER BY amt, id DESC) FROM far.orders",
])
def test_refused(spark, seed, sql):
    e = Engine(spark)
    e.attach("far", MemorySource(seed))
    with pytest.raises(Refused):
        e.sql(sql)


def test_volatile_cte_runs_once(spark, seed):
    e = Engine(spark)
    e.attach("far", MemorySource(seed))
    r = e.sql("WITH r AS MATERIALIZED (SELECT id, rand() AS x FROM far.orders) SELECT count(*) AS n FROM r a JOIN r b ON a.id = b.id AND a.x = b.x").first()
    assert r.n == 6


#: Statements, and the tables that count after each.
WRITES = [
    "INSERT INTO far.t VALUES (4, 40, 'd'), (5, NULL, 'e')",
    "INSERT INTO far.t (id, note) SELECT tenant, cname FROM far.customers",
    "INSERT INTO far.t (note, id) VALUES ('x', 6) RETURNING id, v",
    "INSERT INTO far.t SELECT id + 100, amt, name FROM far.orders WHERE amt > 60 ORDER BY id LIMIT 2",
    "INSERT INTO far.k VALUES (1, 5), (9, 9) ON CONFLICT DO NOTHING",
    "INSERT INTO far.k VALUES (1, 5), (9, 9) ON CONFLICT (id) DO UPDATE SET v = excluded.v + 1",
    "INSERT INTO far.k VALUES (2, 5) ON CONFLICT (id) DO UPDATE SET v = k.v + excluded.v RETURNING *",
    "UPDATE far.t SET v = v + 1, note = 'up' WHERE id > 1",
    "UPDATE far.t SET v = 0",
    "UPDATE far.t AS a SET v = a.v * 2, id = a.id WHERE a.note IS NOT NULL RETURNING id, v",
    "UPDATE far.t SET note = c.cname FROM far.customers c WHERE t.id + 4 = c.tenant",
    "UPDATE far.t SET v = (SELECT max(amt) FROM far.orders) WHERE id IN (SELECT tenant - 4 FROM far.customers)",
    "DELETE FROM far.t WHERE v IS NULL OR id = 1",
    "DELETE FROM far.t",
    "DELETE FROM far.t USING far.customers c WHERE t.id + 4 = c.tenant RETURNING t.id",
    "DELETE FROM far.t a WHERE EXISTS (SELECT 1 FROM far.customers c WHERE c.tenant = a.id + 4) RETURNING *",
    "MERGE INTO far.k USING (VALUES (1, 100), (3, 300), (8, 800)) AS s(id, v) ON k.id = s.id WHEN MATCHED AND s.v > 200 THEN DELETE WHEN MATCHED THEN UPDATE SET v = k.v + s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)",
    "MERGE INTO far.k AS t USING far.customers AS c ON t.id + 4 = c.tenant WHEN MATCHED THEN UPDATE SET v = c.tenant WHEN NOT MATCHED AND c.tenant > 99 THEN INSERT VALUES (c.tenant, 0) RETURNING merge_action, id, v",
    "CREATE TABLE far.made AS SELECT tenant, count(*) AS n FROM far.orders GROUP BY tenant",
    "CREATE TABLE far.fresh (id INTEGER PRIMARY KEY, v VARCHAR DEFAULT 'dflt', w DOUBLE); INSERT INTO far.fresh (id) VALUES (1); INSERT INTO far.fresh VALUES (2, 'b', 2.5)",
    "ALTER TABLE far.t ADD COLUMN more INTEGER; UPDATE far.t SET more = id",
    "ALTER TABLE far.t RENAME COLUMN note TO remark",
    "ALTER TABLE far.t DROP COLUMN note",
    "DROP TABLE far.t",
    "BEGIN; DELETE FROM far.t WHERE id = 1; INSERT INTO far.t VALUES (7, 7, 'g'); COMMIT",
    "BEGIN TRANSACTION; DELETE FROM far.t; ROLLBACK",
]


@pytest.mark.parametrize("sql", WRITES)
def test_writes_same_as_duckdb(spark, seed, tmp_path, sql):
    e, con = Engine(spark), duckdb.connect()
    e.attach("far", VersionedSource(spark, f"file://{tmp_path}/far"))
    con.execute("ATTACH ':memory:' AS far")
    for name in ("orders", "customers"):
        e.create_table_as(f"far.{name}", seed[name])
        rows = seed[name].toArrow()  # noqa: F841
        con.execute(f"CREATE TABLE far.{name} AS SELECT * FROM rows")
    for text in ("CREATE TABLE far.t (id INTEGER, v INTEGER DEFAULT 7, note VARCHAR)", "INSERT INTO far.t VALUES (1, 10, 'a'), (2, 20, NULL), (3, NULL, 'c'), (1, 10, 'a')", "CREATE TABLE far.k (id INTEGER PRIMARY KEY, v INTEGER)", "INSERT INTO far.k VALUES (1, 10), (2, 20), (3, 30)"):
        e.sql(text)
        con.execute(text)
    for text in sql.split("; "):
        df, want = e.sql(text), con.execute(text)
        if "RETURNING" in text:
            assert [c.lower() for c in df.columns] == [d[0].lower() for d in want.description]
        if text.split()[0] in ("INSERT", "UPDATE", "DELETE", "MERGE"):
            assert sorted(canonical([tuple(r) for r in df.collect()]), key=str) == sorted(canonical(want.fetchall()), key=str)
    tables = sorted(r[0] for r in con.execute("SELECT table_name FROM information_schema.tables WHERE table_catalog = 'far'").fetchall())
    assert tables == sorted(t for _, _, t in e.tables())
    for t in tables:
        want = con.execute(f"SELECT * FROM far.{t}")
        assert e.table(f"far.{t}").columns == [d[0] for d in want.description]
        assert sorted(canonical([tuple(r) for r in e.table(f"far.{t}").collect()]), key=str) == sorted(canonical(want.fetchall()), key=str)


REFUSED = [
    "UPDATE far.t SET v = DEFAULT", "INSERT INTO far.t VALUES (DEFAULT, 1)", "INSERT INTO far.t VALUES (1)", "INSERT INTO far.t (nope) VALUES (1)", "UPDATE far.t SET nope = 1", "INSERT INTO far.t (id) VALUES (9) ON CONFLICT DO NOTHING",
    "WITH x AS (SELECT 1 AS id) INSERT INTO far.t SELECT id, id FROM x", "WITH x AS (DELETE FROM far.t RETURNING *) SELECT * FROM x", "CREATE INDEX i ON far.t (id)", "CREATE SCHEMA far.s", "CREATE SEQUENCE far.q", "COPY far.t TO 'x'",
    "CREATE TABLE far.t AS SELECT 1 AS id", "CREATE VIEW far.w AS SELECT * FROM far.t JOIN (SELECT explode(sequence(1, 3)) AS k) n ON n.k = far.t.id", "MERGE INTO far.t USING (VALUES (1), (1)) s(id) ON t.id = s.id WHEN MATCHED THEN DELETE",
    "UPDATE far.t SET v = s.x FROM (VALUES (1, 1), (1, 2)) s(k, x) WHERE t.id = s.k", "INSERT INTO far.t VALUES (1, 1)", "UPDATE far.t SET id = 1", "DROP TABLE far.none", "ALTER TABLE far.t ADD COLUMN v INTEGER", "ALTER TABLE far.t DROP COLUMN id",
    "MERGE INTO far.t USING (VALUES (1)) s(id) ON t.id = s.id WHEN MATCHED THEN ERROR", "DELETE FROM far.t WHERE id = 1 garbage garbage", "CREATE TABLE far.c (id INTEGER CHECK (id > 0))", "VACUUM far.t",
]


def test_refused_writes_change_nothing(spark, tmp_path):
    e = Engine(spark)
    e.attach("far", VersionedSource(spark, f"file://{tmp_path}/far"))
    e.sql("CREATE TABLE far.t (id INTEGER PRIMARY KEY, v INTEGER)")
    e.sql("INSERT INTO far.t VALUES (1, 10), (2, 20)")
    before = e.tables(), sorted(map(tuple, e.table("far.t").collect()))
    for sql in REFUSED:
        with pytest.raises(Exception) as raised:
            e.sql(sql)
        assert isinstance(raised.value, Refused) or "garbage" in sql, (sql, raised.value)
        assert (e.tables(), sorted(map(tuple, e.table("far.t").collect()))) == before, sql


def test_rowid(spark, tmp_path, seed):
    e = Engine(spark)
    e.attach("far", VersionedSource(spark, f"file://{tmp_path}/far"))
    e.create_table_as("far.t", spark.range(0, 40, 1, 3).selectExpr("id", "id % 2 AS v"))
    ids = {r.rowid: r.id for r in e.sql("SELECT rowid, id FROM far.t").collect()}
    assert len(ids) == 40 and e.sql("SELECT * FROM far.t").columns == ["id", "v"]
    one = next(iter(ids))
    assert [tuple(r) for r in e.sql(f"SELECT id FROM far.t WHERE rowid = '{one}'").collect()] == [(ids[one],)]
    near = Engine(spark)
    near.attach("far", MemorySource(seed))
    with pytest.raises(Refused):
        near.sql("SELECT rowid FROM far.orders")
