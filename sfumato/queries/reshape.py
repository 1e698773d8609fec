"""Queries of the reshaping operators: wide tables and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sfumato.operators.entries import entries, measure_key
from sfumato.operators.packed import split_packed
from sfumato.operators.wide import attribute_index, cell_rows, unpivot_cells, widen
from sfumato.session import table


def _catalog(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """(measure, type) of measure_catalog; a fixed table of few rows."""
    return [(r["measure"], r["value_type"]) for r in table(spark, d, "measure_catalog").orderBy("measure").collect()]


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    catalog = _catalog(spark, d)
    keys = [("".join(ch for ch in m.lower() if ch.isalnum()), t) for m, t in catalog]
    cols = ["run_id", "run_date", "measure", "value", "id"]
    rows = table(spark, d, "benchmarks").select(F.lit("benchmarks").alias("source"), *cols).unionByName(
        table(spark, d, "hyperparam").select(F.lit("hyperparam").alias("source"), *cols))
    cells = cell_rows(rows, ["source", "run_id"], attribute_index(rows, measure_key("measure"), keys), "value", ["run_date", "id"], keys)
    return widen(cells, ["source", "run_id"], catalog, provenance="id"), catalog


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    wide, catalog = _wide(spark, d)
    return unpivot_cells(wide, ["source", "run_id"], catalog, "id").select("source", "run_id", "measure", "id")


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    wide, catalog = _wide(spark, d)
    return wide.select("source", "run_id", *(m for m, _ in catalog))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(table(spark, d, "hyperparam").where(F.col("lags").isNotNull()), "lags")
    return split_packed(rows, ["id"], "lags")


_MEASURES = "brier coverage crps f1 f2 mape pinball05 pinball25 pinball75 pinball95 resolution rmse sharpness size time u winkler05 winkler25".split()
_CELLS = """
WITH b AS (
  SELECT 'benchmarks' AS source, run_id, run_date, id, value, lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM benchmarks
  UNION ALL
  SELECT 'hyperparam' AS source, run_id, run_date, id, value, lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM hyperparam
), c AS (
  SELECT b.source, b.run_id, m.measure, b.id, b.value,
         row_number() OVER (PARTITION BY b.source, b.run_id, m.measure ORDER BY b.run_date DESC, b.id DESC) AS rn
  FROM b JOIN measure_catalog m ON lower(regexp_replace(m.measure, '[^\\p{L}\\p{N}]', '', 'g')) = b.k
  WHERE isfinite(b.value)
)
"""
_WIDE_COLS = ", ".join(
    f"{'CAST(' if m == 'size' else ''}max(CASE WHEN c.measure = '{m}' THEN c.value END){' AS BIGINT)' if m == 'size' else ''} AS {m}" for m in _MEASURES
)

QUERIES = {f.__name__: f for f in (p4_found, p4_wide, p5_found)}
SQL = {
    "p4_found": _CELLS + "SELECT source, run_id, measure, id FROM c WHERE rn = 1",
    "p4_wide": _CELLS
    + f"""SELECT e.source, e.run_id, {_WIDE_COLS}
FROM (SELECT DISTINCT source, run_id FROM b) e LEFT JOIN c ON c.source = e.source AND c.run_id = e.run_id AND c.rn = 1
GROUP BY e.source, e.run_id""",
}
