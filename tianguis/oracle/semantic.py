"""DuckDB SQL for the measures (M1-M15) and dashboard datasets (V1-V17)."""

from __future__ import annotations

from .queries import CUOTAS, H1_ROWS, H2_ROWS, VENDEDORES, VENDEDORES_COLS
from .sql import big, dbl, xq, xr

_LATE_O = ("COALESCE(CAST(order_delivered_customer_date AS DATE) "
           "> CAST(order_estimated_delivery_date AS DATE), FALSE)")

# calendar months (gap-free) with item revenue, as the time-intelligence measures need
_MONTHS = """
cal_span AS (
  SELECT MIN(CAST(order_purchase_timestamp AS DATE)) AS lo,
         MAX(CAST(order_purchase_timestamp AS DATE)) AS hi FROM a_orders),
cal_months AS (
  SELECT DISTINCT YEAR(d) AS anio, MONTH(d) AS mes
  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
        FROM cal_span WHERE lo IS NOT NULL) x),
rev_month AS (
  SELECT YEAR(o.order_purchase_timestamp) AS anio, MONTH(o.order_purchase_timestamp) AS mes,
         SUM(oi.price) AS ingreso
  FROM a_items oi JOIN a_orders o ON oi.order_id = o.order_id GROUP BY 1, 2),
m AS (
  SELECT c.anio, c.mes, r.ingreso
  FROM cal_months c LEFT JOIN rev_month r ON c.anio = r.anio AND c.mes = r.mes)"""

# stage means of delivered orders in hundredths of a day
_ETAPAS = f"""
etapas AS (
  SELECT tarde, {xq('SUM(d_vendedor)', 'COUNT(d_vendedor)', 2)} AS v, {xq('SUM(d_courier)', 'COUNT(d_courier)', 2)} AS c
  FROM pedidos WHERE order_status = 'delivered' GROUP BY tarde)"""

# mean score per category in hundredths
_NOTAS = f"""
notas AS (
  SELECT en AS categoria, {xq('SUM(u)', 'COUNT(u) * 1000000', 2)} AS q
  FROM a_items JOIN nota USING (order_id) JOIN categoria USING (product_id)
  WHERE u IS NOT NULL AND order_id IN (SELECT order_id FROM a_orders) GROUP BY ALL)"""

MEASURES_SQL = {
    "m01_score_per_order": f"""
WITH rt AS (
  SELECT r.order_id, {xq('SUM(r.review_score)', 'COUNT(r.review_score)', 6)} AS u
  FROM a_reviews r JOIN a_orders o ON r.order_id = o.order_id GROUP BY r.order_id)
SELECT {xr('SUM(u)', 'COUNT(u) * 1000000', 2)} AS score_promedio_por_orden FROM rt""",
    "m02_late_rate": f"""
SELECT COUNT(*) FILTER (tarde) AS pedidos_con_retraso, COUNT(d_total) AS pedidos_entregados,
       COALESCE({xr('COUNT(*) FILTER (tarde)', 'COUNT(d_total)', 2, factor=100)}, 0) AS tasa_retraso
FROM pedidos""",
    "m03_mean_installments": f"""
WITH per AS (
  SELECT order_id,
         COALESCE({xq('SUM(payment_installments * payment_value)', 'SUM(payment_value)', 6, 2, 2)},
                  0) AS u
  FROM f_payments WHERE payment_type = 'credit_card' GROUP BY order_id)
SELECT {xr('SUM(u)', 'COUNT(u) * 1000000', 2)} AS cuotas_promedio FROM per""",
    "m04_mom_growth": f"""
WITH {_MONTHS.strip()},
l AS (SELECT *, LAG(ingreso) OVER (ORDER BY anio, mes) AS prev FROM m)
SELECT anio, mes, {dbl('ingreso')} AS ingreso, {dbl('prev')} AS ingreso_mes_anterior,
       COALESCE({xr('COALESCE(ingreso, 0) - prev', 'prev', 4, 2, 2)}, 0) AS crecimiento_mom
FROM l""",
    "m05_revenue_ytd": f"""
WITH {_MONTHS.strip()}
SELECT anio, mes, {dbl('ingreso')} AS ingreso,
       {dbl('SUM(ingreso) OVER (PARTITION BY anio ORDER BY mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')}
           AS ingreso_acumulado_ytd
FROM m""",
    "m06_total_revenue": f"""
SELECT {dbl('SUM(oi.price)')} AS total_ingresos
FROM a_items oi JOIN a_orders o ON oi.order_id = o.order_id""",
    "m07_total_orders": "SELECT COUNT(DISTINCT order_id) AS total_pedidos FROM a_orders",
    "m08_average_ticket": f"""
WITH per AS (
  SELECT oi.order_id, SUM(oi.price) AS sp
  FROM a_items oi JOIN a_orders o ON oi.order_id = o.order_id GROUP BY oi.order_id)
SELECT {dbl('SUM(sp)')} AS total_ingresos, COUNT(DISTINCT order_id) AS pedidos_con_items,
       {xr('SUM(sp)', 'COUNT(DISTINCT order_id)', 2, 2)} AS ticket_promedio
FROM per""",
    "m09_dissatisfaction_rate": f"""
WITH s AS (
  SELECT r.order_id, SUM(r.review_score) AS ss, COUNT(r.review_score) AS n
  FROM a_reviews r JOIN a_orders o ON r.order_id = o.order_id
  GROUP BY r.order_id HAVING COUNT(r.review_score) > 0)
SELECT {big('SUM(CASE WHEN ss <= n * 2 THEN 1 ELSE 0 END)')} AS ordenes_insatisfechas,
       COUNT(*) AS ordenes_con_review,
       {xr('SUM(CASE WHEN ss <= n * 2 THEN 1 ELSE 0 END)', 'COUNT(*)', 2, factor=100)}
           AS tasa_insatisfaccion
FROM s""",
    "m10_delivery_rate": f"""
SELECT COUNT(*) FILTER (WHERE order_status = 'delivered') AS pedidos_entregados,
       COUNT(*) AS total_pedidos,
       {xr("COUNT(*) FILTER (WHERE order_status = 'delivered')", 'COUNT(*)', 2, factor=100)}
           AS tasa_entrega
FROM a_orders""",
    "m11_logistics_days": f"""
SELECT {xr('SUM(d_vendedor)', 'COUNT(d_vendedor)', 2)} AS dias_vendedor_courier,
       {xr('SUM(d_courier)', 'COUNT(d_courier)', 2)} AS dias_courier_cliente,
       {xr('SUM(d_total)', 'COUNT(d_total)', 2)} AS dias_entrega,
       {xr('SUM(d_demora) FILTER (tarde)', 'COUNT(d_demora) FILTER (tarde)', 2)} AS dias_retraso
FROM pedidos""",
    "m12_payments": f"""
WITH per AS (
  SELECT p.order_id, SUM(p.payment_value) AS pv
  FROM a_payments p JOIN a_orders o ON p.order_id = o.order_id GROUP BY p.order_id)
SELECT {dbl('SUM(pv)')} AS total_pagado, COUNT(*) AS ordenes_pagadas,
       {xr('SUM(pv)', 'COUNT(*)', 2, 2)} AS pago_promedio
FROM per""",
    "m13_courier_share_late": f"""
WITH {_ETAPAS.strip()}
SELECT CAST(v AS DOUBLE) / 100 AS dias_vendedor_courier, CAST(c AS DOUBLE) / 100 AS dias_courier_cliente,
       CAST(v + c AS DOUBLE) / 100 AS dias_totales, {xr('c', 'v + c', 2, factor=100)} AS participacion_courier
FROM etapas WHERE tarde""",
    "m14_group_gaps": f"""
WITH grupos AS (
  SELECT 'H1' AS hallazgo, tipo AS grupo, q, 'Entregas sin Retraso' AS base FROM ({H1_ROWS})
  UNION ALL
  SELECT 'H2', tipo, q, 'Envío Simple (1 Vendedor)' FROM ({H2_ROWS}))
SELECT g.hallazgo, g.grupo, CAST(g.q AS DOUBLE) / 100 AS score_promedio, CAST(b.q AS DOUBLE) / 100 AS score_base,
       CAST(g.q - b.q AS DOUBLE) / 100 AS diferencia
FROM grupos g LEFT JOIN grupos b ON b.hallazgo = g.hallazgo AND b.grupo = g.base""",
    "m15_commission": f"""
SELECT {dbl('SUM(oi.price)')} AS total_ingresos,
       CAST(CAST(0.10 AS DECIMAL(5, 4)) AS DOUBLE) AS tasa_comision,
       {dbl('SUM(oi.price) * CAST(0.10 AS DECIMAL(5, 4))')} AS comision
FROM a_items oi JOIN a_orders o ON oi.order_id = o.order_id""",
}


def _kpis(items: list[tuple[str, str, str]]) -> str:
    parts = [f"SELECT '{label}' AS kpi, CAST({col} AS DOUBLE) AS valor FROM ({body.strip()}) t"
             for label, body, col in items]
    return "\nUNION ALL\n".join(parts)


M = MEASURES_SQL
_CARD = "COUNT(*) FILTER (WHERE payment_type = 'credit_card')"
_CARD_SHARE = f"SELECT {xr(_CARD, 'COUNT(*)', 2, factor=100)} AS v FROM a_payments"

DASHBOARD_SQL = {
    "v01_kpis_overview": _kpis([
        ("total_ingresos", M["m06_total_revenue"], "total_ingresos"),
        ("total_pedidos", M["m07_total_orders"], "total_pedidos"),
        ("ticket_promedio", M["m08_average_ticket"], "ticket_promedio"),
        ("score_promedio", M["m01_score_per_order"], "score_promedio_por_orden"),
        ("tasa_insatisfaccion", M["m09_dissatisfaction_rate"], "tasa_insatisfaccion"),
        ("tasa_entrega", M["m10_delivery_rate"], "tasa_entrega"),
    ]),
    "v02_monthly_revenue": f"""
SELECT YEAR(o.order_purchase_timestamp) AS anio, MONTH(o.order_purchase_timestamp) AS mes,
       {dbl('SUM(oi.price)')} AS total_ingresos
FROM a_items oi JOIN a_orders o ON oi.order_id = o.order_id GROUP BY 1, 2""",
    "v03_revenue_by_category": f"""
WITH ventas AS (
  SELECT en, price FROM a_items JOIN categoria USING (product_id) WHERE order_id IN (SELECT order_id FROM a_orders))
SELECT en AS categoria, {dbl('SUM(price)')} AS ingreso,
       {xr('SUM(price)', '(SELECT SUM(price) FROM ventas)', 2, 2, 2, 100)} AS porcentaje
FROM ventas GROUP BY ALL""",
    "v04_top_states_by_revenue": f"""
SELECT c.customer_state, {dbl('SUM(oi.price)')} AS total_ingresos
FROM a_items oi JOIN a_orders o ON oi.order_id = o.order_id
LEFT JOIN a_customers c ON o.customer_id = c.customer_id
GROUP BY c.customer_state
ORDER BY SUM(oi.price) DESC NULLS LAST, c.customer_state ASC NULLS FIRST
LIMIT 10""",
    "v05_delivery_donut": f"""
SELECT CASE WHEN order_status = 'delivered' THEN 'Sí' ELSE 'No' END AS entregado,
       COUNT(*) AS pedidos,
       {xr('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 2, factor=100)} AS porcentaje
FROM a_orders GROUP BY 1""",
    "v06_stars_by_lateness": f"""
WITH s AS (
  SELECT order_id, {xr('SUM(review_score)', 'COUNT(review_score)', 0, as_int=True)} AS puntuacion
  FROM a_reviews GROUP BY order_id)
SELECT CASE WHEN {_LATE_O} THEN 'Sí' ELSE 'No' END AS is_late, puntuacion,
       COUNT(*) AS total_ordenes
FROM s JOIN a_orders o ON s.order_id = o.order_id GROUP BY 1, 2""",
    "v07_worst_categories": f"""
WITH {_NOTAS.strip()}
SELECT categoria, CAST(q AS DOUBLE) / 100 AS score_promedio FROM notas
ORDER BY q ASC NULLS LAST, categoria ASC NULLS FIRST LIMIT 20""",
    "v08_category_detail": f"""
WITH {_NOTAS.strip()},
conteo AS (
  SELECT en AS categoria, COUNT(*) AS total, COUNT(*) FILTER (tarde) AS tardes,
         COUNT(*) FILTER (tarde OR u <= 2000000) AS malas
  FROM (SELECT DISTINCT order_id, product_id FROM a_items)
  JOIN pedidos USING (order_id) JOIN categoria USING (product_id) LEFT JOIN nota USING (order_id) GROUP BY ALL)
SELECT categoria, total AS total_pedidos, CAST(q AS DOUBLE) / 100 AS score_promedio,
       {xr('tardes', 'total', 2, factor=100)} AS tasa_retraso, CAST(500 - q AS DOUBLE) / 100 AS score_inverso,
       {xr('malas', 'total', 2, factor=100)} AS tasa_ineficiencia
FROM conteo LEFT JOIN notas USING (categoria)""",
    "v09_kpis_logistics": _kpis([
        ("dias_vendedor_courier", M["m11_logistics_days"], "dias_vendedor_courier"),
        ("dias_courier_cliente", M["m11_logistics_days"], "dias_courier_cliente"),
        ("dias_entrega", M["m11_logistics_days"], "dias_entrega"),
        ("dias_retraso", M["m11_logistics_days"], "dias_retraso"),
        ("tasa_retraso", M["m02_late_rate"], "tasa_retraso"),
    ]),
    "v10_transit_stages": f"""
WITH {_ETAPAS.strip()}
SELECT if(tarde, 'Sí', 'No') AS is_late, e.etapa, CAST(e.x AS DOUBLE) / 100 AS dias
FROM (SELECT tarde, unnest([{{'etapa': 'Vendedor → Courier', 'x': v}}, {{'etapa': 'Courier → Cliente', 'x': c}}]) AS e
      FROM etapas)""",
    "v11_late_rate_by_state": f"""
WITH ol AS (
  SELECT customer_id, {_LATE_O} AS late,
         date_diff('day', order_purchase_timestamp, order_delivered_customer_date) AS dd
  FROM a_orders)
SELECT c.customer_state,
       COUNT(*) FILTER (WHERE dd IS NOT NULL) AS pedidos_entregados,
       COUNT(*) FILTER (WHERE late) AS pedidos_con_retraso,
       {xr('COUNT(*) FILTER (WHERE late)', 'COUNT(*) FILTER (WHERE dd IS NOT NULL)', 2, factor=100)}
           AS tasa_retraso
FROM ol JOIN a_customers c ON ol.customer_id = c.customer_id
GROUP BY c.customer_state""",
    "v12_worst_sellers": f"""
WITH {VENDEDORES.strip()},
peores AS (SELECT {VENDEDORES_COLS} FROM entregas GROUP BY seller_id HAVING COUNT(*) >= 30)
SELECT seller_id, seller_city, seller_state, total_pedidos, pedidos_con_retraso, tasa_retraso, dias_promedio_retraso
FROM peores LEFT JOIN a_sellers USING (seller_id)""",
    "v13_kpis_payments": _kpis([
        ("total_pagado", M["m12_payments"], "total_pagado"),
        ("cuotas_promedio", M["m03_mean_installments"], "cuotas_promedio"),
        ("pago_promedio", M["m12_payments"], "pago_promedio"),
        ("participacion_tarjeta", _CARD_SHARE, "v"),
    ]),
    "v14_payment_donut": f"""
WITH tipos AS (
  SELECT DISTINCT order_id, payment_type FROM a_orders LEFT JOIN a_payments USING (order_id))
SELECT payment_type, COUNT(*) AS total_ordenes,
       {xr('COUNT(*)', '(SELECT COUNT(*) FROM tipos)', 2, factor=100)} AS porcentaje
FROM tipos GROUP BY ALL""",
    "v15_ticket_by_installments": f"""
WITH {CUOTAS.strip()},
medias AS (
  SELECT rango_cuotas, {xq('SUM(payment_value)', 'COUNT(payment_value)', 6, 2)} AS q FROM tarjeta GROUP BY ALL)
SELECT rango_cuotas, CAST(q AS DOUBLE) / 1000000 AS ticket_promedio,
       {xr('q', "(SELECT q FROM medias WHERE rango_cuotas = '1 cuota (contado)')", 2)} AS multiplicador
FROM medias""",
    "v16_ticket_by_month": f"""
WITH per AS (SELECT order_id, SUM(price) AS sp FROM a_items GROUP BY order_id)
SELECT YEAR(o.order_purchase_timestamp) AS anio, MONTH(o.order_purchase_timestamp) AS mes,
       {dbl('SUM(sp)')} AS total_ingresos, COUNT(*) AS pedidos_con_items,
       {xr('SUM(sp)', 'COUNT(*)', 2, 2)} AS ticket_promedio
FROM per JOIN a_orders o ON per.order_id = o.order_id GROUP BY 1, 2""",
    "v17_top_states_by_customers": """
SELECT customer_state, COUNT(DISTINCT customer_unique_id) AS clientes_unicos
FROM a_customers GROUP BY customer_state
ORDER BY clientes_unicos DESC, customer_state ASC NULLS FIRST LIMIT 10""",
}


def state_slicer_sql(states: list[str]) -> str:
    """V11 restricted to the slicer's states (P15)."""
    body = DASHBOARD_SQL["v11_late_rate_by_state"]
    in_list = ", ".join("'" + st.replace("'", "''") + "'" for st in states)
    return body.replace("GROUP BY c.customer_state",
                        f"WHERE c.customer_state IN ({in_list})\nGROUP BY c.customer_state")
