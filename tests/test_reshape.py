import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reference_split import split

from sfumato.operators.entries import entries, measure_key, valid
from sfumato.operators.packed import split_field, split_packed
from sfumato.operators.wide import attribute_index, cell_rows, unpivot_cells, widen

FIELDS = [
    None, "", "  ", "[]", "( )", "1", "[1, 2]", "(20,)", "1,,2", ",1", "19, , ", " 2 , 8 ", "1 2\t3", "'a b@1' c@2", '"5"" shelf@1", "x|y@2"',
    "'owner''s@1'; 'p (n), c@2'", "8，9、10", "{'a@1','b; c@2'}", "[ 'a@1'   b@2 ]", "'5\" shelf@1',,,'load@3'", "|a@1|'b/c@2'", '1\n"2"', "3,3", "owner's@1, x",
    chr(0xE000) + "0" + chr(0xE001) + ",'q,r'", "''", '"",1', "[1],[2]", "a 'b c", "1 , 2;3 / 4",
]


def _rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((r["pos"], r["item"]))
    return {k: sorted(v) for k, v in out.items()}


def test_packed_fields(spark):
    df = spark.createDataFrame(list(enumerate(FIELDS)), "id int, f string")
    got = _rows(split_packed(df, ["id"], "f"))
    for i, f in enumerate(FIELDS):
        assert got.get(i, []) == split(f), f


def test_packed_examples(spark):
    df = spark.createDataFrame([(1, '["5"" shelf@1", \'in/out@2\', 7]'), (2, "1,,2")], "id int, f string")
    assert _rows(split_packed(df, ["id"], "f")) == {1: [(1, '5" shelf@1'), (2, "in/out@2"), (3, "7")], 2: [(1, "1"), (3, "2")]}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1@ ,;|/[](){}\"'，", max_size=14))
def test_loop_agrees_with_state_machine(text):
    if not any(q in text for q in "\"'[](){}"):
        assert split_field(text) == split(text)


def test_packed_random_against_loop(spark):
    import random

    rng = random.Random(5)
    values = ["1", "22", "a@1", "in/out@2", "it's@3", '5" x@4', "a, b@5", "p (n)@6"]

    def quote(v):
        q = rng.choice("\"'")
        return q + v.replace(q, q + q) + q

    fields = []
    for _ in range(2000):
        vs = [quote(v) if " " in v or "," in v or "/" in v or "(" in v or rng.random() < 0.4 else v for v in rng.choices(values, k=rng.randint(1, 6))]
        text = vs[0]
        for v in vs[1:]:
            text += rng.choice([",", ", ", ";", " | ", "/", " ", "\t", ",,"]) + v
        a, b = rng.choice([("", ""), ("[", "]"), ("( ", " )"), ("{", "}")])
        fields.append(rng.choice(["", " "]) + a + text + b)
    got = _rows(split_packed(spark.createDataFrame(list(enumerate(fields)), "id int, f string"), ["id"], "f"))
    for i, f in enumerate(fields):
        assert got.get(i, []) == split(f) == split_field(f), f


def test_packed_long_and_repeated(spark):
    rows = [(1, ",".join(["'a,b'"] * 3000)), (1, ",".join(["'a,b'"] * 3000)), (2, "1," * 5000), (3, '"' + '""' * 5000 + '"')]
    got = _rows(split_packed(spark.createDataFrame(rows, "id int, f string"), ["id"], "f"))
    assert len(got[1]) == 6000 and got[1][0] == (1, "a,b") and len(got[2]) == 5000 and got[3] == [(1, '"' * 5000)]


def test_packed_empty_table(spark):
    df = spark.createDataFrame([], "id int, f string, _f string, pos int, item string")
    assert split_packed(df, ["id"], "f").collect() == []


CATALOG = [("rmse", "double"), ("size", "bigint")]


def _widen(spark, rows, heavy_rows=100_000, **kw):
    df = spark.createDataFrame(rows, "run bigint, at timestamp, id bigint, m string, v double, _ix int, _v string, n int")
    cells = cell_rows(df, ["run"], attribute_index(df, measure_key("m"), CATALOG), "v", ["at", "id"], CATALOG, heavy_rows)
    return widen(cells, ["run"], CATALOG, **kw)


def _row(run, day, id_, m, v):
    return (run, dt.datetime(2024, 1, day), id_, m, v, 1, "x", 2)


def test_wide_cells(spark):
    nan, inf = math.nan, math.inf
    rows = [
        _row(1, 1, 1, "RMSE", 1.0), _row(1, 2, 2, " rmse", 2.0), _row(1, 2, 3, "R-MSE", 3.0), _row(1, 9, 9, "rmse2", 9.0), _row(1, 9, 8, "rmse", nan),
        _row(1, 1, 4, "size", 7.0), _row(2, 1, 5, None, 1.0), _row(3, 1, 6, "rmse", inf), _row(None, 1, 7, "size", 2.6), _row(4, 1, 10, "size", 1e300),
        _row(1, 2, 3, "R-MSE", 3.0),
    ]
    for heavy_rows in (100_000, 3, 0):  # no entity is heavy, the first is, all are
        got = {r["run"]: (r["rmse"], r["size"], r["rmse__id"], r["size__id"]) for r in _widen(spark, rows, heavy_rows, provenance="id").collect()}
        assert got == {1: (3.0, 7, 3, 4), 2: (None,) * 4, 3: (None,) * 4, None: (None, 3, None, 7), 4: (None, None, None, 10)}


def test_wide_types(spark):
    catalog = [("d", "double"), ("f", "float"), ("i", "int"), ("b", "boolean"), ("t", "timestamp"), ("s", "string"), ("l", "bigint")]
    rows = [
        (1, 1, "d", "1.5"), (1, 2, "f", "0.5"), (1, 3, "i", "7"), (1, 4, "b", "true"), (1, 5, "t", "2024-01-01 00:00:00"), (1, 6, "s", "x"), (1, 7, "s", "y"), (1, 8, "l", "5000000000"),
        (2, 9, "i", "5000000000"), (2, 10, "d", "abc"), (2, 11, "b", "false"), (2, 12, "s", ""), (2, 13, "t", None), (3, 14, "z", "1"),
    ]
    df = spark.createDataFrame(rows, "e int, id bigint, m string, v string")
    wide = widen(cell_rows(df, ["e"], attribute_index(df, F.col("m"), catalog), "v", ["id"], catalog), ["e"], catalog, provenance="id")
    assert [wide.schema[c].dataType.simpleString() for c, _ in catalog] == ["double", "float", "int", "boolean", "timestamp", "string", "bigint"]
    got = {r["e"]: tuple(r[c] for c, _ in catalog) for r in wide.collect()}
    assert got == {1: (1.5, 0.5, 7, True, dt.datetime(2024, 1, 1), "y", 5_000_000_000), 2: (None, None, None, False, None, "", None), 3: (None,) * 7}
    assert wide.where("e = 1").head()["s__id"] == 7 and wide.where("e = 2").head()["i__id"] == 9


def test_wide_very_wide(spark):
    catalog = [(f"c{i}", "double") for i in range(3000)]
    df = spark.range(600).selectExpr("id % 200 AS e", "id", "concat('c', (id * 7) % 3000) AS m", "CAST(id AS DOUBLE) AS v")
    wide = widen(cell_rows(df, ["e"], attribute_index(df, F.col("m"), catalog), "v", ["id"], catalog), ["e"], catalog)
    assert {r["e"]: sum(x for x in r[1:] if x is not None) for r in wide.collect()} == {e: 3.0 * e + 600 for e in range(200)}


def test_wide_many_entities_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(20_000).selectExpr("id div 2 AS run", "timestamp'2024-01-01' AS at", "id", "CASE WHEN id % 2 = 0 THEN 'rmse' ELSE 'size' END AS m", "CAST(id AS DOUBLE) AS v").coalesce(1)
        cells = cell_rows(df, ["run"], attribute_index(df, measure_key("m"), CATALOG), "v", ["at", "id"], CATALOG)
        wide = widen(cells, ["run"], CATALOG, provenance="id")
        assert wide.count() == 10_000
        assert wide.where("rmse = run * 2 AND size = run * 2 + 1 AND rmse__id = run * 2").count() == 10_000
        assert unpivot_cells(wide, ["run"], CATALOG, "id").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wide_empty_table(spark):
    assert _widen(spark, []).collect() == []


def test_entries_and_keys(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "a", math.nan)], "id int, m string, v double")
    assert entries(df, "m", "v").count() == 2
    assert df.where(valid("v")).count() == 2
    got = spark.createDataFrame([("\tPin-Ball 05",), (None,)], "m string").select(measure_key("m").alias("k")).collect()
    assert [r["k"] for r in got] == ["pinball05", None]
    assert df.select(F.count("*")).head()[0] == 3
