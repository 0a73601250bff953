"""Tables are dealt to as many tasks as their rows ask for, whatever the session's shuffle partitions."""

from axisframe import store
from axisframe.operators import joins as J
from axisframe.operators import mechanics as M
from axisframe.operators import windows as W


def test_islands_and_gaps_are_dealt_by_rows(spark, monkeypatch):
    """F19."""
    assert store.tasks(spark.range(90), rows=10) == 9 and store.tasks(spark.range(90)) == 4
    monkeypatch.setattr(W, "tasks", lambda frame: store.tasks(frame, rows=10))
    frame = spark.range(90).selectExpr("id % 3 k", "id div 3 + id div 30 p").union(spark.sql("select 0L, 0L"))
    found = W.islands(frame, ["k"], "p")
    assert found.rdd.getNumPartitions() == 10
    assert sorted((r.k, r.lo, r.hi, r.n) for r in found.collect()) == [(k, 11 * i, 11 * i + 9, 10) for k in range(3) for i in range(3)]
    assert W.gaps(frame, ["k"], "p").rdd.getNumPartitions() == 10


def test_shared_edges_are_dealt_by_rows(spark, monkeypatch):
    """F20."""
    monkeypatch.setattr(M, "tasks", lambda frame: store.tasks(frame, rows=10))
    frame = spark.range(90).selectExpr("cast(id div 2 as string) g", "id div 2 div 3 * 2 + id % 2 e")
    found = M.shared_edges(frame, "g", "e")
    assert found.rdd.getNumPartitions() == 9
    for r in found.collect():
        others = ";".join(sorted(str(x) for x in range(int(r.g) // 3 * 3, int(r.g) // 3 * 3 + 3) if str(x) != r.g))
        assert (r.shared_with, r.identical_to) == (others, others)


def test_best_partners_are_dealt_by_rows(spark, monkeypatch):
    """F23."""
    monkeypatch.setattr(J, "tasks", lambda frame: store.tasks(frame, rows=10))
    left = spark.range(90).selectExpr("id % 30 s", "id div 30 m")
    right = spark.range(60).selectExpr("id % 20 t", "id div 20 m").union(spark.sql("select 7L, 2L"))
    found = J.best_partner(left, right, "s", "t", "m", least=2)
    assert found.rdd.getNumPartitions() == 9
    assert {tuple(r) for r in found.collect()} == {(s, 0, 3) for s in range(30)}  # ties to the smaller id
