"""Order-insensitive comparison of a Spark result with DuckDB's."""

import pandas as pd


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, int):
        x = float(x)
    return repr(x + 0.0) if isinstance(x, float) else str(x)


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(zip(*([_cell(v) for v in df[c]] for c in cols), strict=True)) if len(df) else []


def same(spark_df, sql_df) -> None:
    a = spark_df.toPandas()
    assert sorted(a.columns) == sorted(sql_df.columns)
    x, y = canonical(a), canonical(sql_df)
    assert len(x) == len(y)
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    assert not bad, bad[:3]
