"""DuckDB SQL for the cleaning / data-quality reports and the listed extras."""

from __future__ import annotations

from ..plans.quality_reports import (EXPECTED_COUNTS, LABEL_EDGES, LOAD_RULES, LOAD_WIDTHS,
                                     NUMERIC_RULES, RAW_WIDTHS, SELLERS_WITH_COMMA,
                                     SLICER_CATEGORY)
from ..sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, VARCHAR_LIMITS

_ALIAS = {"customers": "a_customers", "orders": "a_orders", "products": "a_products",
          "sellers": "a_sellers", "order_items": "a_items", "order_payments": "a_payments",
          "order_reviews": "a_reviews", "category_translation": "a_translation"}

_LATE_O = ("COALESCE(CAST(order_delivered_customer_date AS DATE) "
           "> CAST(order_estimated_delivery_date AS DATE), FALSE)")


def _pk_report() -> str:
    parts = []
    for name, key in PRIMARY_KEYS.items():
        cols = ", ".join(key)
        nulls = " OR ".join(f"{k} IS NULL" for k in key)
        parts.append(f"""
SELECT '{name}' AS tabla, '{cols}' AS clave, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS filas,
       COUNT(*) FILTER (WHERE n > 1) AS claves_duplicadas,
       CAST(COALESCE(SUM(CASE WHEN anynull THEN n ELSE 0 END), 0) AS BIGINT) AS claves_nulas
FROM (SELECT {cols}, COUNT(*) AS n, ({nulls}) AS anynull FROM {_ALIAS[name]} GROUP BY {cols}) g""")
    return "\nUNION ALL".join(parts)


def _fk_report() -> str:
    parts = []
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        parts.append(f"""
SELECT '{child}' AS hijo, '{ccol}' AS columna, '{parent}' AS padre, COUNT(*) AS filas_huerfanas
FROM {_ALIAS[child]} c
WHERE c.{ccol} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {_ALIAS[parent]} p WHERE p.{pcol} = c.{ccol})""")
    return "\nUNION ALL".join(parts)


def _domain_report() -> str:
    parts = []
    for name, cols in VARCHAR_LIMITS.items():
        if name not in _ALIAS:
            continue
        for c, n in cols.items():
            if n is None:
                continue
            parts.append(f"""
SELECT '{name}' AS tabla, '{c}' AS columna, CAST({n} AS BIGINT) AS limite,
       COUNT(*) FILTER (WHERE length({c}) > {n}) AS valores_excedidos FROM {_ALIAS[name]}""")
    return "\nUNION ALL".join(parts)


def _row_counts() -> str:
    return "\nUNION ALL".join(
        f"\nSELECT '{name}' AS tabla, COUNT(*) AS registros FROM {alias}"
        for name, alias in _ALIAS.items())


def _label_orphans() -> str:
    return "\nUNION ALL".join(f"""
SELECT '{c}' AS hijo, '{k}' AS columna, '{p}' AS padre,
       (SELECT COUNT(*) FROM {c} WHERE {k} IS NOT NULL) - (SELECT COUNT(*) FROM {c} WHERE {k} IN (SELECT {pk} FROM {p}))
           AS filas_huerfanas""" for c, k, p, pk in LABEL_EDGES)


def _raw_widths() -> str:
    return "\nUNION ALL".join(f"""
SELECT '{t}' AS tabla, '{c}' AS columna, CAST({n} AS BIGINT) AS limite, SUM(CAST(length({c}) > {n} AS BIGINT))::BIGINT AS valores_excedidos
FROM {t}""" for t, cols in RAW_WIDTHS.items() for c, n in cols.items())


def _numeric_rules() -> str:
    return "\nUNION ALL".join(f"""
SELECT '{t}' AS tabla, '{c}' AS columna, CAST({p} AS BIGINT) AS digitos, CAST({s} AS BIGINT) AS decimales,
       COUNT(CASE WHEN x >= {10 ** (p - s)} OR x <= -{10 ** (p - s)} THEN 1 END) AS fuera_de_rango,
       COUNT(CASE WHEN (x * {10 ** s}) % 1 <> 0 THEN 1 END) AS exceso_decimales
FROM (SELECT CAST({c} AS DECIMAL(24, 6)) AS x FROM {t})""" for t, cols in NUMERIC_RULES.items() for c, (p, s) in cols.items())


def _expected_counts() -> str:
    rows = "\nUNION ALL".join(f" SELECT '{t}' AS tabla, COUNT(*) AS registros, CAST({n} AS BIGINT) AS esperado FROM {t}"
                              for t, n in EXPECTED_COUNTS.items())
    return f"SELECT *, registros = esperado AS coincide FROM ({rows}) c"


# Raw-table reports do not need the model prefix.
def _load_checks() -> str:
    """Every observed number by a scan of its own over the base relations."""
    parts = [f"SELECT '{n}' AS tabla, '{rule}' AS regla, '' AS columna, {value} AS valor FROM {rel}" for n, rel in _ALIAS.items()
             for rule, value in (("registros", "COUNT(*)"), ("cuarentena", "COUNT(*) FILTER (false)"))]
    parts += [f"SELECT '{n}', 'ancho', '{c}', COUNT(*) FILTER (length({c}) > {w}) FROM {_ALIAS[n]}" for n, ws in LOAD_WIDTHS.items() for c, w in ws.items()]
    for n, rules in LOAD_RULES.items():
        for c, (digits, decimals) in rules.items():
            parts.append(f"SELECT '{n}', 'rango', '{c}', COUNT(*) FILTER (abs({c}) >= {10 ** (digits - decimals)}) FROM {_ALIAS[n]}")
            parts.append(f"SELECT '{n}', 'decimales', '{c}', COUNT(*) FILTER ({c} * {10 ** decimals} % 1 <> 0) FROM {_ALIAS[n]}")
    return " UNION ALL ".join(parts)


RAW_SQL = {
    "s1b_raw_split": f"""
SELECT 'tabla' AS destino, s_suppkey::VARCHAR AS clave, lower(s_name) AS seller_city FROM supplier WHERE s_suppkey % {SELLERS_WITH_COMMA} <> 0
UNION ALL
SELECT 'cuarentena', '"' || s_suppkey || '","' || s_nationkey || '","' || lower(s_name) || ', norte","XX"', NULL
FROM supplier WHERE s_suppkey % {SELLERS_WITH_COMMA} = 0""",
    "s2_multiline_insert": """
SELECT doc_id::VARCHAR AS review_id, source AS order_id, doc_id % 5 + 1 AS review_score, lang AS review_comment_title,
       length(text) AS largo, md5(text) AS md5 FROM documents""",
    "c1_stored_update": "SELECT event_id, array_to_string(string_split(props, chr(34)), '') AS props FROM events",
    "c5b_label_orphans": _label_orphans(),
    "c6_text_widths": _raw_widths(),
    "c6_numeric_rules": _numeric_rules(),
    "c7_expected_counts": _expected_counts(),
    "c1_strip_quotes": "SELECT event_id, replace(props, '\"', '') AS props FROM events",
    "c2_replace_commas": "SELECT doc_id, replace(text, ',', ' -') AS text FROM documents",
    "c4_offending_rows": """
SELECT doc_id, length(text) - length(replace(text, ',', '')) AS n_comas
FROM documents WHERE contains(text, ',')""",
    "c5a_pk_violations": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS BIGINT) AS line_number,
       COUNT(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
}

MODEL_SQL = {
    "c6_load_checks": _load_checks(),
    "c5_pk_report": _pk_report(),
    "c5b_fk_orphans": _fk_report(),
    "c6_domain_violations": _domain_report(),
    "c7_row_counts": _row_counts(),
    "c8_untranslated": """
SELECT DISTINCT p.product_category_name FROM a_products p
WHERE p.product_category_name IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM a_translation t
                  WHERE t.product_category_name = p.product_category_name)""",
    "c9_orders_without_items": """
SELECT order_id, order_status FROM a_orders o
WHERE NOT EXISTS (SELECT 1 FROM a_items i WHERE i.order_id = o.order_id)""",
    "p14_customers_with_late_orders": f"""
SELECT * FROM a_customers
WHERE customer_id IN (SELECT customer_id FROM a_orders WHERE {_LATE_O})""",
    "s1_csv_round_trip": """
SELECT order_id, payment_sequential, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value
FROM a_payments""",
    "p15_category_slicer": f"""
SELECT (SELECT CAST(SUM(l.price) AS DOUBLE) FROM a_items l
        WHERE EXISTS (FROM a_products p WHERE p.product_id = l.product_id AND p.product_category_name = '{SLICER_CATEGORY}')
          AND EXISTS (FROM a_orders o WHERE o.order_id = l.order_id)) AS total_ingresos,
       CAST(SUM(payment_value) AS DOUBLE) AS total_pagado, COUNT(DISTINCT order_id) AS ordenes_pagadas
FROM a_payments WHERE order_id IN (SELECT order_id FROM a_orders)""",
    "w5_month_rank": """
WITH cal_span AS (
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
m AS (SELECT c.anio, c.mes, r.ingreso FROM cal_months c
      LEFT JOIN rev_month r ON c.anio = r.anio AND c.mes = r.mes)
SELECT anio, mes, CAST(ingreso AS DOUBLE) AS ingreso,
       ROW_NUMBER() OVER (PARTITION BY anio ORDER BY ingreso DESC NULLS LAST, mes) AS posicion,
       COUNT(*) OVER (PARTITION BY anio) AS meses_en_anio
FROM m""",
    "f9_latest_milestone": """
SELECT order_id, greatest(order_purchase_timestamp, order_approved_at,
                          order_delivered_carrier_date, order_delivered_customer_date) AS ultimo_hito
FROM a_orders""",
}


def sliced_sql(body: str, states: list[str]) -> str:
    """``body`` evaluated on the relations visible under a customer-state slicer."""
    in_list = ", ".join("'" + st.replace("'", "''") + "'" for st in states)
    ctes = f"""WITH s_customers AS (SELECT * FROM a_customers WHERE customer_state IN ({in_list})),
s_orders AS (SELECT * FROM a_orders WHERE customer_id IN (SELECT customer_id FROM s_customers)),
s_items AS (SELECT * FROM a_items WHERE order_id IN (SELECT order_id FROM s_orders)),
s_reviews AS (SELECT * FROM a_reviews WHERE order_id IN (SELECT order_id FROM s_orders)),
s_payments AS (SELECT * FROM a_payments WHERE order_id IN (SELECT order_id FROM s_orders))
"""
    for name in ("customers", "orders", "items", "reviews", "payments"):
        body = body.replace(f"a_{name}", f"s_{name}")
    return ctes + f"SELECT * FROM ({body}) sliced"


def model_sql_with_slicer() -> dict[str, str]:
    from .semantic import DASHBOARD_SQL, state_slicer_sql
    from ..plans.quality_reports import SLICER_STATES
    out = dict(MODEL_SQL)
    out["p15_state_slicer"] = state_slicer_sql(SLICER_STATES)
    out["p15_kpis_state_slicer"] = sliced_sql(DASHBOARD_SQL["v01_kpis_overview"], SLICER_STATES)
    return out
