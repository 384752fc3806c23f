import pytest

from tidewater.engine import Engine
from tidewater.errors import NotAllowed, Refused
from tidewater.sources import Verb, VersionedSource
from tidewater.writes import DEFAULT, When


@pytest.fixture
def e(spark, tmp_path):
    e = Engine(spark)
    e.attach("far", VersionedSource(spark, f"file://{tmp_path}/store"))
    e.create_table_as("far.t", spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, v int"), key=("id",))
    e.create_table_as("far.d", spark.createDataFrame([], "id int, v int, w int"), defaults={"v": 7, "w": 8})
    return e


def rows(e, name="far.t"):
    return sorted(tuple(r) for r in e.table(name).collect())


def test_insert(spark, e):
    r = e.insert("far.t", spark.createDataFrame([(4, 40)], "id int, v int"), returning=True)
    assert r.count == 1 and r.rows.collect()[0].v == 40 and len(rows(e)) == 4
    e.insert("far.d", spark.createDataFrame([(1,)], "id int"))
    e.insert_defaults("far.d")
    assert sorted(map(str, rows_raw(e))) == sorted(map(str, [(1, 7, 8), (None, 7, 8)]))
    with pytest.raises(Refused):
        e.insert("far.t", spark.createDataFrame([(1, 1)], "id int, v int"))
    assert len(rows(e)) == 4
    with pytest.raises(Refused):
        e.insert("far.t", spark.createDataFrame([(9,)], "nope int"))


def rows_raw(e):
    return [tuple(r) for r in e.table("far.d").collect()]


def test_on_conflict(spark, e):
    new = spark.createDataFrame([(3, 33), (5, 55)], "id int, v int")
    e.insert("far.t", new, on_conflict="nothing")
    assert rows(e) == [(1, 10), (2, 20), (3, 30), (5, 55)]
    e.insert("far.t", new, on_conflict="update")
    assert rows(e)[2] == (3, 33)
    with pytest.raises(Refused):
        e.insert("far.t", new.select("id"), on_conflict="nothing")


def test_update(spark, e):
    r = e.update("far.t", {"v": "t.v + 1", "id": "id"}, where="t.id > 1", returning=True)
    assert r.count == 2 and rows(e) == [(1, 10), (2, 21), (3, 31)]
    source = spark.createDataFrame([(1, 100), (9, 900)], "k int, n int")
    e.update("far.t", {"v": "s.n"}, using=source, on="t.id = s.k")
    assert rows(e)[0] == (1, 100)
    with pytest.raises(Refused):
        e.update("far.t", {"v": "s.n"}, using=source.union(source), on="t.id = s.k")
    with pytest.raises(Refused):
        e.update("far.t", {"v": DEFAULT})
    assert rows(e)[0] == (1, 100)


def test_delete(spark, e):
    assert e.delete("far.t", where="t.v >= 30").count == 1
    e.delete("far.t", using=spark.createDataFrame([(1,)], "k int"), on="t.id = s.k")
    assert rows(e) == [(2, 20)]
    e.delete("far.t")
    assert rows(e) == []


def test_merge(spark, e):
    source = spark.createDataFrame([(1, 5), (2, -1), (7, 70), (8, -8)], "id int, v int")
    actions = [When(True, "delete", condition="s.v < 0"), When(True, "update", {"v": "t.v + s.v"}), When(False, "nothing", condition="s.v < 0"), When(False, "insert", {"id": "s.id", "v": "s.v"})]
    r = e.merge("far.t", source, "t.id = s.id", actions, returning=True)
    assert rows(e) == [(1, 15), (3, 30), (7, 70)]
    assert sorted(x.merge_action for x in r.rows.collect()) == ["DELETE", "INSERT", "UPDATE"]
    with pytest.raises(Refused):
        e.merge("far.t", source.union(source), "t.id = s.id", actions)
    with pytest.raises(Refused):
        e.merge("far.t", source, "t.id = s.id", [When(True, "error")])
    assert rows(e) == [(1, 15), (3, 30), (7, 70)]


def test_transactions(spark, e, tmp_path):
    e.begin()
    e.delete("far.t", where="t.id = 1")
    assert len(rows(e)) == 2
    other = Engine(spark)
    other.attach("far", VersionedSource(spark, f"file://{tmp_path}/store"))
    assert len(rows(other)) == 3
    e.rollback()
    assert len(rows(e)) == 3
    e.begin()
    e.delete("far.t", where="t.id = 1")
    e.commit()
    other.refresh("far")
    assert len(rows(other)) == 2


def test_ddl(spark, e):
    e.add_column("far.t", "note", "string")
    assert [f.name for f in e.describe("far.t").schema.fields] == ["id", "v", "note"]
    with pytest.raises(Refused):
        e.create_table_as("far.t", spark.range(1))
    e.drop_table("far.t")
    with pytest.raises(Refused):
        e.table("far.t")
    assert ("far", "main", "d") in e.tables()


def test_verbs_and_returning(spark, tmp_path):
    e = Engine(spark)
    e.attach("far", VersionedSource(spark, f"file://{tmp_path}/s", verbs={"t": frozenset({Verb.UPDATE, Verb.DELETE})}, returning=False))
    e.create_table_as("far.t", spark.createDataFrame([(1, 10)], "id int, v int"))
    assert e.update("far.t", {"v": "5"}).count == 1
    with pytest.raises(NotAllowed):
        e.update("far.t", {"v": "v + 1"})
    with pytest.raises(NotAllowed):
        e.insert("far.t", spark.createDataFrame([(1, 1)], "id int, v int"))
    with pytest.raises(Refused):
        e.delete("far.t", returning=True)


def test_policy_on_writes(spark, tmp_path):
    e = Engine(spark)
    hidden = {"p": lambda df: df.where("tenant = 1")}
    e.attach("far", VersionedSource(spark, f"file://{tmp_path}/s", hidden=hidden))
    e.create_table_as("far.p", spark.createDataFrame([(1, 1), (2, 2)], "id int, tenant int"))
    assert e.delete("far.p").count == 1
    assert e.attached["far"].source.frame(spark, "main", "p").count() == 1
    with pytest.raises(Refused):
        e.merge("far.p", spark.createDataFrame([(1, 1)], "id int, tenant int"), "t.id = s.id", [When(True, "update", {"tenant": "2"})])
