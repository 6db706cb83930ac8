"""DuckDB SQL for the reports over the published mart, from the base relations."""

from __future__ import annotations

from ..plans.mart_reports import SLICER_DAYS
from .sql import big, dbl, xr

_PERIOD = "year(order_purchase_timestamp) AS anio, quarter(order_purchase_timestamp) AS trimestre, month(order_purchase_timestamp) AS mes"

MART_SQL = {
    "a3_distinct_by_period": f"""
WITH p AS (SELECT order_id, customer_unique_id, {_PERIOD} FROM a_orders LEFT JOIN a_customers USING (customer_id))
SELECT 'mes' AS nivel, anio, trimestre, mes, count(DISTINCT customer_unique_id) AS clientes, count(DISTINCT order_id) AS pedidos FROM p GROUP BY ALL
UNION ALL
SELECT 'trimestre', anio, trimestre, NULL, count(DISTINCT customer_unique_id), count(DISTINCT order_id) FROM p GROUP BY ALL
UNION ALL
SELECT 'anio', anio, NULL, NULL, count(DISTINCT customer_unique_id), count(DISTINCT order_id) FROM p GROUP BY ALL""",
    "s8_mart_rows_by_month": f"""
SELECT year(order_purchase_timestamp) AS anio, month(order_purchase_timestamp) AS mes, COUNT(*) AS filas,
       COUNT(order_item_id) AS items, {dbl('SUM(price)')} AS ingreso
FROM a_orders LEFT JOIN a_items USING (order_id) GROUP BY ALL""",
    "s8_mart_satisfaction": f"""
WITH por_orden AS (
  SELECT order_id, count(order_item_id) AS n, sum(price) AS sp FROM a_orders LEFT JOIN a_items USING (order_id) GROUP BY order_id),
resenas AS (SELECT order_id, sum(review_score) AS ss, count(review_score) AS sn FROM a_reviews GROUP BY order_id)
SELECT CASE varios WHEN TRUE THEN 'Envío Dividido (+ de 1 Vendedor)' WHEN FALSE THEN 'Envío Simple (1 Vendedor)'
            ELSE 'Sin Vendedor / Cancelado' END AS tipo_logistica,
       COUNT(*) AS ordenes, {big('SUM(n)')} AS items, {dbl('SUM(sp)')} AS ingreso,
       {xr('SUM(sp)', 'COUNT(sp)', 2, num_scale=2)} AS ticket_promedio, {xr('SUM(ss)', 'SUM(sn)', 2)} AS score_promedio
FROM por_orden LEFT JOIN resenas USING (order_id) LEFT JOIN variedad USING (order_id) GROUP BY varios""",
    "p15_calendar_slicer": f"""
WITH dias AS (
  SELECT order_id, customer_id, quarter(order_purchase_timestamp) AS quarter, isodow(order_purchase_timestamp) AS day_of_week FROM a_orders)
SELECT customer_state, COUNT(*) AS items, {dbl('SUM(price)')} AS ingreso
FROM a_items JOIN dias USING (order_id) JOIN a_customers USING (customer_id)
WHERE {SLICER_DAYS} GROUP BY customer_state""",
}
