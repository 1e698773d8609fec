import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sfumato.llm import packing


def slow_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                break
        else:
            room.append(capacity)
            i = len(room) - 1
        room[i] -= s
        out.append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_tree_is_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    assert packing.first_fit_decreasing(np.array(sizes, np.int64), 20).tolist() == slow_first_fit(sizes, 20)


def _pack(spark, rows, caps, **kw):
    items = spark.createDataFrame(rows, "doc_id int, tokens int").selectExpr("*", "1 AS _size", "2 AS _group", "3 AS capacity", "4 AS bin")
    kinds = spark.createDataFrame(caps, "size_id int, label string, capacity int")
    return packing.pack(items, kinds, **kw).toPandas()


def test_pieces_and_capacity(spark):
    rows = [(1, 25), (2, 10), (3, 4), (4, 6), (5, 0), (6, None), (7, -3), (3, 4), (None, 31)]
    got = _pack(spark, rows, [(1, "a", 10), (2, "b", 100), (3, "none", 0), (4, "null", None)])
    assert set(got["size_id"]) == {1, 2}
    used = got.groupby(["size_id", "capacity", "bin"])["size"].sum().reset_index()
    assert (used["size"] <= used["capacity"]).all()
    one = got[(got.size_id == 1) & (got.doc_id == 1)].sort_values("piece")
    assert one["size"].tolist() == [10, 10, 5] and one["start"].tolist() == [0, 10, 20]
    assert got[(got.size_id == 2)].groupby("doc_id", dropna=False).size().sum() == len(rows)
    assert got["bin"].notna().all() and got[got.size_id == 1]["size"].sum() == 25 + 10 + 4 + 6 + 4 + 31


def test_groups_cost_little(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(1, 900, 6000))]
    for group in (500, 6000):
        got = _pack(spark, rows, [(1, "a", 1000)], group_items=group)
        used = got.groupby("bin")["size"].sum()
        assert used.sum() == sum(s for _, s in rows) and used.mean() > 960 and used.max() <= 1000


def test_same_result_again_and_empty(spark):
    rows = [(i, i % 50) for i in range(500)]
    a, b = (_pack(spark, rows, [(1, "a", 64)], group_items=100).sort_values(["doc_id", "piece"]).reset_index(drop=True) for _ in range(2))
    assert a.equals(b)
    assert len(_pack(spark, [], [(1, "a", 64)])) == 0
