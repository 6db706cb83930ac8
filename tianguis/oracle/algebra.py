"""DuckDB SQL for the measure algebra: every level and measure by its own rule."""

from __future__ import annotations

from .sql import dbl, xq, xr

_ROWS = f"""
fila AS (  -- one row per order with everything a measure asks for
  SELECT o.*, c.customer_state AS estado, year(order_purchase_timestamp) AS anio, month(order_purchase_timestamp) AS mes,
         quarter(order_purchase_timestamp) AS trimestre,
         (SELECT sum(price) FROM a_items i WHERE i.order_id = o.order_id) AS precio,
         EXISTS (FROM a_items i WHERE i.order_id = o.order_id) AS con_items,
         (SELECT u FROM nota n WHERE n.order_id = o.order_id) AS u,
         (SELECT sum(review_score) <= 2 * count(review_score) FROM a_reviews r WHERE r.order_id = o.order_id) AS mala,
         (SELECT sum(payment_value) FROM a_payments p WHERE p.order_id = o.order_id) AS pagado,
         (SELECT COALESCE({xq('SUM(payment_installments * payment_value)', 'SUM(payment_value)', 6, 2, 2)}, 0)
          FROM a_payments p WHERE p.order_id = o.order_id AND payment_type = 'credit_card' HAVING count(*) > 0) AS cuotas
  FROM pedidos o LEFT JOIN a_customers c USING (customer_id))"""

_OVERVIEW = f"""{dbl('SUM(precio)')} AS total_ingresos, COUNT(*) AS total_pedidos,
       {xr('SUM(precio)', 'COUNT(*) FILTER (con_items)', 2, num_scale=2)} AS ticket_promedio,
       {xr('SUM(u)', 'COUNT(u) * 1000000', 2)} AS score_promedio,
       {xr('COUNT(*) FILTER (mala)', 'COUNT(u)', 2, factor=100)} AS tasa_insatisfaccion,
       {xr("COUNT(*) FILTER (order_status = 'delivered')", 'COUNT(*)', 2, factor=100)} AS tasa_entrega"""

_LOGISTICS = f"""COALESCE({xr('COUNT(*) FILTER (tarde)', 'COUNT(d_total)', 2, factor=100)}, 0) AS tasa_retraso,
       {xr('SUM(d_total)', 'COUNT(d_total)', 2)} AS dias_entrega,
       {xr('SUM(d_demora) FILTER (tarde)', 'COUNT(d_demora) FILTER (tarde)', 2)} AS dias_retraso,
       {dbl('SUM(pagado)')} AS total_pagado, {xr('SUM(pagado)', 'COUNT(pagado)', 2, 2)} AS pago_promedio,
       {xr('SUM(cuotas)', 'COUNT(cuotas) * 1000000', 2)} AS cuotas_promedio"""


def _levels(axes: list[str], sets: list[list[str]], body: str) -> str:
    """One SELECT per level."""
    out = []
    for s in sets:
        shown = ", ".join(a if a in s else f"NULL AS {a}" for a in axes)
        group = f"GROUP BY {', '.join(s)}" if s else ""
        out.append(f"SELECT {shown}, '{','.join(a for a in axes if a in s)}' AS nivel, {body} FROM fila {group}")
    return " UNION ALL ".join(out)


_STATE_MONTHS = """
venta AS (
  SELECT customer_state AS estado, date_trunc('month', order_purchase_timestamp)::DATE AS d, sum(price) AS ingreso
  FROM a_orders LEFT JOIN a_customers USING (customer_id) LEFT JOIN a_items USING (order_id) GROUP BY ALL),
marco AS (
  SELECT estado, unnest(generate_series((SELECT min(d) FROM venta), (SELECT max(d) FROM venta), INTERVAL 1 MONTH))::DATE AS d
  FROM (SELECT DISTINCT estado FROM venta)),
serie AS (
  SELECT estado, year(d) AS anio, month(d) AS mes, (SELECT v.ingreso FROM venta v WHERE v.estado IS NOT DISTINCT FROM marco.estado AND v.d = marco.d) AS ingreso
  FROM marco)"""

ALGEBRA_SQL = {
    "m_overview_by_state_and_month": f"""
WITH {_ROWS.strip()}
{_levels(["estado", "anio", "mes"], [["estado", "anio", "mes"], ["estado"], ["anio", "mes"], []], _OVERVIEW)}""",
    "m_logistics_and_payments_by_status": f"""
WITH {_ROWS.strip()}
SELECT order_status AS estado_de_orden, anio, trimestre, 'estado_de_orden,anio,trimestre' AS nivel, {_LOGISTICS}
FROM fila GROUP BY ALL
UNION ALL
SELECT NULL, anio, NULL, 'anio', {_LOGISTICS} FROM fila GROUP BY ALL""",
    "m04_mom_growth_by_state": f"""
WITH {_STATE_MONTHS.strip()},
l AS (SELECT *, LAG(ingreso) OVER (PARTITION BY estado ORDER BY anio, mes) AS prev FROM serie)
SELECT estado, anio, mes, {dbl('ingreso')} AS ingreso, {dbl('prev')} AS ingreso_mes_anterior,
       COALESCE({xr('COALESCE(ingreso, 0) - prev', 'prev', 4, 2, 2)}, 0) AS crecimiento_mom
FROM l""",
    "m05_revenue_ytd_by_state": f"""
WITH {_STATE_MONTHS.strip()}
SELECT estado, anio, mes, {dbl('ingreso')} AS ingreso,
       {dbl('(SELECT sum(x.ingreso) FROM serie x WHERE x.estado IS NOT DISTINCT FROM s.estado AND x.anio = s.anio AND x.mes <= s.mes)')} AS ingreso_acumulado_ytd
FROM serie s""",
    "m14_group_gaps_by_year": f"""
WITH grupos AS (
  SELECT year(order_purchase_timestamp) AS anio, 'H1' AS hallazgo, if(tarde, 'Entregas con Retraso', 'Entregas sin Retraso') AS grupo,
         {xq('SUM(u)', 'COUNT(u) * 1000000', 2)} AS q, NOT tarde AS base
  FROM pedidos LEFT JOIN nota USING (order_id) GROUP BY ALL
  UNION ALL
  SELECT year(order_purchase_timestamp), 'H2', if(varios, 'Envío Dividido (+ de 1 Vendedor)', 'Envío Simple (1 Vendedor)'),
         {xq('SUM(review_score)', 'COUNT(review_score)', 2)}, NOT varios
  FROM variedad JOIN a_orders USING (order_id) LEFT JOIN a_reviews USING (order_id) GROUP BY ALL)
SELECT g.anio, g.hallazgo, g.grupo, CAST(g.q AS DOUBLE) / 100 AS score_promedio, CAST(b.q AS DOUBLE) / 100 AS score_base,
       CAST(g.q - b.q AS DOUBLE) / 100 AS diferencia
FROM grupos g LEFT JOIN grupos b ON b.anio = g.anio AND b.hallazgo = g.hallazgo AND b.base""",
    "m13_courier_share_by_year": f"""
WITH e AS (
  SELECT year(order_purchase_timestamp) AS anio, {xq('SUM(d_vendedor)', 'COUNT(d_vendedor)', 2)} AS v,
         {xq('SUM(d_courier)', 'COUNT(d_courier)', 2)} AS c
  FROM pedidos WHERE order_status = 'delivered' AND tarde GROUP BY ALL)
SELECT anio, CAST(v AS DOUBLE) / 100 AS dias_vendedor_courier, CAST(c AS DOUBLE) / 100 AS dias_courier_cliente,
       CAST(v + c AS DOUBLE) / 100 AS dias_totales, {xr('c', 'v + c', 2, factor=100)} AS participacion_courier
FROM e""",
}
