import os

from sfumato.session import cut, ship


def test_ship_tells_local_workers_the_path(spark):
    ship(spark)
    ship(spark)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "") + os.pathsep + os.environ.get("PYTHONPATH", "")
    assert known.split(os.pathsep).count(root) >= 1


def test_cut_keeps_rows_and_ends_the_lineage(spark):
    df = cut(spark.range(10).selectExpr("id * 2 AS x"))
    assert sorted(r["x"] for r in df.collect()) == list(range(0, 20, 2))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
