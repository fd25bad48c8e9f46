"""SQL fragments shared by the checks. Plain definitions, written for DuckDB."""
from __future__ import annotations

from panelwright.plans.rounding import SHIFT


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round(({expr}) + {SHIFT}, {digits}) + 0.0)"


def t_of(month: str) -> str:
    return f"CAST(date_diff('month', DATE '1995-01-01', {month}) AS INTEGER)"


N = 79
LAST = "DATE '2001-07-01'"

SPENDING = """
spending AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_returnflag AS category,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000.0 AS value
  FROM lineitem GROUP BY 1, 2, 3)"""

TOTAL = """
total AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000.0 AS value
  FROM lineitem GROUP BY 1, 2)"""

CATEGORY = SPENDING + """,
catpanel AS (
  SELECT series_id || '|' || category AS series_id, category, month, value FROM spending)"""

AGGREGATE = """
agg AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0 AS value
  FROM lineitem GROUP BY 1)"""

INDUSTRY = """
industry AS (
  SELECT p_type AS series_key, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0 AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

REGIONS = """
regions AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS series_id, n_name AS region, r_name AS macro
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def cleaned(source: str, extra: str = "", prefix: str = "") -> str:
    """``{prefix}dense``, ``{prefix}prof`` and ``{prefix}clean`` of a panel CTE.

    ``extra`` names further key columns, e.g. ``"category"``.
    """
    p = prefix
    keys = "series_id" + (f", {extra}" if extra else "")
    on = "USING (series_id" + (f", {extra}" if extra else "") + ")"
    return f"""
{p}ids AS (SELECT DISTINCT {keys} FROM {source} WHERE month BETWEEN DATE '1995-01-01' AND {LAST}),
{p}dense AS (
  SELECT {keys}, CAST(g.t AS INTEGER) AS t,
         CAST(DATE '1995-01-01' + to_months(CAST(g.t AS INTEGER)) AS DATE) AS month, s.value AS y
  FROM {p}ids CROSS JOIN range(0, {N}) AS g(t)
  LEFT JOIN (SELECT {keys}, {t_of('month')} AS t, value FROM {source}) s
  USING ({keys}, t)),
{p}runs AS (
  SELECT *, count(y) OVER (PARTITION BY {keys} ORDER BY t) AS island,
         min(CASE WHEN y IS NOT NULL THEN t END) OVER (PARTITION BY {keys}) AS first_t,
         max(CASE WHEN y IS NOT NULL THEN t END) OVER (PARTITION BY {keys}) AS last_t
  FROM {p}dense),
{p}isl AS (
  SELECT {keys}, island, first_t, last_t, count(y) AS known, count(*) - count(y) AS missing,
         count(*) FILTER (WHERE y IS NULL AND t BETWEEN first_t AND last_t) AS gap
  FROM {p}runs GROUP BY ALL),
{p}prof AS (
  SELECT {keys}, CAST(sum(known) AS INTEGER) AS n_known, CAST(sum(missing) AS INTEGER) AS n_missing,
         CAST(max(gap) AS INTEGER) AS max_gap, CAST(min(first_t) AS INTEGER) AS first_t,
         CAST(min(last_t) AS INTEGER) AS last_t,
         sum(missing) = 0 AS complete, min(first_t) = 0 AND min(last_t) = {N - 1} AS edges,
         sum(missing) = 0 OR (min(first_t) = 0 AND min(last_t) = {N - 1} AND max(gap) <= 2) AS kept
  FROM {p}isl GROUP BY {keys}),
{p}around AS (
  SELECT {keys}, t, month, y,
         last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS bt,
         last_value(y IGNORE NULLS) OVER b AS by_,
         first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS at_,
         first_value(y IGNORE NULLS) OVER a AS ay
  FROM {p}dense
  WINDOW b AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{p}filled AS (
  SELECT {keys}, t, month,
         CASE WHEN y IS NOT NULL THEN y
              ELSE by_ + (ay - by_) * (CAST(t - bt AS DOUBLE) / CAST(at_ - bt AS DOUBLE)) END AS y,
         y IS NULL AND by_ IS NOT NULL AND ay IS NOT NULL AS filled, y AS raw
  FROM {p}around),
{p}clean AS (
  SELECT f.* FROM {p}filled f JOIN {p}prof {on} WHERE kept)"""


FOLDS3 = """
folds AS (SELECT 3 AS horizon, CAST(i AS INTEGER) AS fold, CAST(70 + 3 * i AS INTEGER) AS train_end FROM range(0, 3) AS g(i))"""

FOLDSH = """
plan(horizon, k) AS (VALUES (1, 9), (3, 3), (6, 2), (12, 1)),
folds AS (
  SELECT horizon, CAST(i AS INTEGER) AS fold, CAST(79 - k * horizon + i * horizon AS INTEGER) AS train_end
  FROM plan, range(0, 9) AS g(i) WHERE i < k)"""


def forecasts(source: str = "filled", folds: str = FOLDSH) -> str:
    """Closed-form forecasts of every series of ``source(series_id, t, y)`` with a full training window."""
    return f"""{folds},
steps AS (SELECT horizon, fold, train_end, CAST(s AS INTEGER) AS step FROM folds, range(1, 13) AS g(s) WHERE s <= horizon),
tr AS (
  SELECT f.horizon, f.fold, f.train_end, p.series_id,
         count(*) = count(p.y) AS ok,
         max(CASE WHEN t = train_end - 1 THEN y END) AS y_last, max(CASE WHEN t = 0 THEN y END) AS y_first,
         least(12, f.train_end - 12) AS k,
         avg(CASE WHEN t >= train_end - least(12, f.train_end - 12) THEN y END) AS m_recent,
         avg(CASE WHEN t >= train_end - 12 - least(12, f.train_end - 12) AND t < train_end - 12 THEN y END) AS m_earlier
  FROM folds f JOIN {source} p ON p.t < f.train_end GROUP BY ALL),
fc AS (
  SELECT m.model, s.horizon, s.fold, s.train_end, tr.series_id, s.step, s.train_end + s.step - 1 AS t,
         CASE m.model
           WHEN 'naive_last' THEN y_last
           WHEN 'drift' THEN y_last + (y_last - y_first) / (s.train_end - 1) * s.step
           WHEN 'seasonal_naive' THEN z.y
           ELSE z.y + (CASE WHEN k >= 1 THEN (m_recent - m_earlier) / 12 ELSE 0 END) * s.step END AS forecast
  FROM steps s JOIN tr ON tr.horizon = s.horizon AND tr.fold = s.fold AND tr.ok
  JOIN {source} z ON z.series_id = tr.series_id AND z.t = s.train_end - 12 + (s.step - 1) % 12
  CROSS JOIN (VALUES ('naive_last'), ('seasonal_naive'), ('drift'), ('seasonal_drift')) AS m(model))"""


def scores(source: str = "filled", folds: str = FOLDS3) -> str:
    return forecasts(source, folds) + f""",
scale AS (
  SELECT f.horizon, f.fold, d.series_id, avg(abs(d.d)) AS scale
  FROM folds f JOIN (SELECT series_id, t, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS d FROM {source}) d
    ON d.t < f.train_end AND d.t > 0 GROUP BY ALL),
good AS (
  SELECT model, horizon, fold, train_end, series_id, avg(abs(a.y - forecast)) AS mae,
         CASE WHEN sum(a.y * a.y) IS NOT NULL AND var_pop(a.y) <> 0
              THEN 1 - sum((a.y - forecast) * (a.y - forecast)) / (var_pop(a.y) * count(*)) END AS r2,
         100 * avg(CASE WHEN abs(a.y) + abs(forecast) > 0
                        THEN abs(a.y - forecast) / ((abs(a.y) + abs(forecast)) / 2) END) AS smape,
         sum((a.y - forecast) * (a.y - forecast)) AS sse, var_pop(a.y) * count(*) AS sst,
         CAST(count(*) AS INTEGER) AS n, sum(a.y) AS y_sum, sum(a.y * a.y) AS y_sq,
         count(a.y) = count(*) AS ok
  FROM fc JOIN {source} a USING (series_id, t) GROUP BY ALL),
every AS (
  SELECT m.model, f.horizon, f.fold, f.train_end, i.series_id
  FROM folds f CROSS JOIN (SELECT DISTINCT series_id FROM {source}) i
  CROSS JOIN (VALUES ('naive_last'), ('seasonal_naive'), ('drift'), ('seasonal_drift')) AS m(model)),
scores AS (
  SELECT e.*, g.mae, g.r2, g.smape, CASE WHEN g.mae IS NOT NULL AND s.scale <> 0 THEN g.mae / s.scale END AS mase,
         g.sse, g.sst, g.n, g.y_sum, g.y_sq,
         CASE WHEN NOT tr.ok THEN 'ValueError: missing values in the training window'
              WHEN g.mae IS NULL THEN 'ValueError: missing values in the test window' END AS error
  FROM every e JOIN tr USING (horizon, fold, train_end, series_id)
  LEFT JOIN (SELECT * FROM good WHERE ok) g USING (model, horizon, fold, train_end, series_id)
  LEFT JOIN scale s USING (horizon, fold, series_id))"""


CAT_SCORES = CATEGORY + "," + cleaned("catpanel", "category") + "," + scores()
CAT_SCORES_H = CATEGORY + "," + cleaned("catpanel", "category") + "," + scores(folds=FOLDSH)
TOTAL_CLEAN = TOTAL + "," + cleaned("total")


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}" if "RECURSIVE_" in ctes else f"WITH {ctes}\n{select}"
