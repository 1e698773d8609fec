"""SQL twins of the pN queries, where SQL can express them over whole tables."""

_KEY = "lower(regexp_replace(measure, '[^\\p{L}\\p{N}]', '', 'g'))"

P1_FOUND = f"""
WITH e AS (
  SELECT DISTINCT id, model, partitions, value FROM benchmarks
  WHERE {_KEY} = 'time' AND isfinite(value) AND partitions IS NOT NULL
), r AS (
  SELECT model, partitions, value, row_number() OVER (PARTITION BY model, partitions ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY model, partitions) AS n
  FROM e
), q AS (
  SELECT model, partitions, n,
         min(CASE WHEN rn * 100 >= 50 * n THEN value END) AS med, min(CASE WHEN rn * 100 >= 90 * n THEN value END) AS p90
  FROM r GROUP BY model, partitions, n
)
SELECT model, partitions FROM q WHERE n >= 10 AND p90 > 8 * med
"""

P1_WITHIN = f"""
WITH e AS (
  SELECT DISTINCT id, model, partitions, value FROM benchmarks
  WHERE {_KEY} = 'time' AND isfinite(value) AND partitions IS NOT NULL
)
SELECT model, partitions, count(*) AS n, q, TRUE AS within FROM e, (VALUES (25), (50), (75), (90), (99)) v(q) GROUP BY model, partitions, q
"""

_POINT = f"""
  SELECT DISTINCT id, dataset, model, {_KEY} AS score, value FROM benchmarks
  WHERE type = 'point' AND dataset IS NOT NULL AND isfinite(value) AND {_KEY} IN ('rmse', 'mape', 'u', 'time')
"""

_MEANS = f"""
WITH e AS ({_POINT}), m AS (
  SELECT dataset, model, avg(value) FILTER (score = 'rmse') AS rmse, avg(value) FILTER (score = 'mape') AS mape,
         avg(value) FILTER (score = 'u') AS u, avg(value) FILTER (score = 'time') AS time
  FROM e GROUP BY dataset, model HAVING count(DISTINCT score) = 4
)
"""

P2_FOUND = f"""
{_MEANS}, n AS (SELECT dataset FROM m GROUP BY dataset HAVING count(*) >= 3)
SELECT a.dataset, a.model FROM m a WHERE a.dataset IN (SELECT dataset FROM n) AND NOT EXISTS (
  SELECT 1 FROM m b WHERE b.dataset = a.dataset AND b.model <> a.model
  AND NOT (b.rmse - a.rmse > 1e-9 AND b.mape - a.mape > 1e-9 AND b.u - a.u > 1e-9 AND b.time - a.time > 1e-9))
"""

_EACH = lambda f: ", ".join(f(s) for s in ("rmse", "mape", "u", "time"))

P2_RANK = f"""
{_MEANS}, p AS (
  SELECT dataset, {_EACH(lambda s: f"quantile_cont({s}, 0.05) AS {s}_lo, quantile_cont({s}, 0.95) AS {s}_hi")} FROM m GROUP BY dataset
), w AS (
  SELECT m.dataset, m.model, {_EACH(lambda s: f"least(greatest(m.{s}, p.{s}_lo), p.{s}_hi) AS {s}")} FROM m JOIN p ON m.dataset = p.dataset
), v AS (
  SELECT dataset, model, {_EACH(lambda s: f"CASE WHEN sum({s} * {s}) OVER g > 0 THEN {s} / sqrt(sum({s} * {s}) OVER g) ELSE 0 END AS {s}")}
  FROM w WINDOW g AS (PARTITION BY dataset)
), x AS (
  SELECT *, {_EACH(lambda s: f"min({s}) OVER g AS {s}_b, max({s}) OVER g AS {s}_a")} FROM v WINDOW g AS (PARTITION BY dataset)
), c AS (
  SELECT dataset, model,
    sqrt(pow(rmse - rmse_b, 2) + pow(mape - mape_b, 2) + pow(u - u_b, 2) + pow(time - time_b, 2)) AS di,
    sqrt(pow(rmse - rmse_a, 2) + pow(mape - mape_a, 2) + pow(u - u_a, 2) + pow(time - time_a, 2)) AS da
  FROM x
)
SELECT dataset, model, round(CASE WHEN di = 0 THEN 1 ELSE da / (di + da) END, 6) AS closeness FROM c
"""

P3_FOUND = f"""
WITH e AS (
  SELECT DISTINCT 'benchmarks' AS source, id, dataset, value, run_date FROM benchmarks
  WHERE {_KEY} = 'rmse' AND isfinite(value) AND dataset IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'hyperparam' AS source, id, dataset, value, run_date FROM hyperparam
  WHERE {_KEY} = 'rmse' AND isfinite(value) AND dataset IS NOT NULL
), r AS (
  SELECT source, dataset, id, CAST(row_number() OVER (PARTITION BY source, dataset ORDER BY value, run_date, id) AS INTEGER) AS rnk FROM e
)
SELECT source, dataset, rnk, id FROM r WHERE rnk <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_within": P1_WITHIN, "p2_found": P2_FOUND, "p2_rank": P2_RANK, "p3_found": P3_FOUND}
