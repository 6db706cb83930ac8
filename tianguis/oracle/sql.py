"""Independent DuckDB formulation of every registered query.

The driver tables are pre-registered as views; ``ADAPTER`` derives the
marketplace model from them with the same rules as ``sources/adapter.py``,
``STAR`` states order-grain rules and the facts over them, and each query is
derived from the rule it must satisfy, by another route than the engine's
where there is one (membership tests, windows with QUALIFY, correlated sums).
Differences that are only about engines are normalised:

* averages, percentages and ratios are computed as exact integers
  (``(2*A + B) // (2*B)`` is HALF_UP of A/B) and divided by a power of ten as
  DOUBLE, which is bit-identical to Spark's rounded DECIMAL cast to DOUBLE;
* money and other decimals are published as DOUBLE, integers as BIGINT;
* Top-N ties are broken explicitly, NULL ordering is stated.
"""

from __future__ import annotations

# ----------------------------------------------------------------------------
# helpers producing SQL text


def hi(expr: str, scale: int = 0) -> str:
    """Exact integer of ``expr * 10^scale`` (``expr`` has at most ``scale`` decimals)."""
    return f"CAST(({expr}) * {10 ** scale} AS HUGEINT)" if scale else f"CAST(({expr}) AS HUGEINT)"


def xq(num: str, den: str, scale: int = 2, num_scale: int = 0, den_scale: int = 0,
       factor: int = 1) -> str:
    """Integer ``round_half_up(factor * num / den * 10^scale)`` (away from zero),
    NULL when den is 0 or NULL."""
    a = f"({factor} * {hi(num, num_scale)} * {10 ** (den_scale + scale)})"
    b = f"NULLIF({hi(den, den_scale)} * {10 ** num_scale}, 0)"
    return f"(sign({a}) * ((2 * abs({a}) + {b}) // (2 * {b})))"


def xr(num: str, den: str, scale: int = 2, num_scale: int = 0, den_scale: int = 0,
       factor: int = 1, as_int: bool = False) -> str:
    """``factor * num / den`` rounded HALF_UP to ``scale`` digits, as DOUBLE
    (BIGINT when ``as_int``); NULL when den is 0 or NULL."""
    q = xq(num, den, scale, num_scale, den_scale, factor)
    if as_int:
        return f"CAST({q} AS BIGINT)"
    return f"(CAST({q} AS DOUBLE) / {10 ** scale})"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


# ----------------------------------------------------------------------------
# adapter: driver tables -> marketplace model

ADAPTER = """
a_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         CAST(c_custkey - c_custkey % 2 AS VARCHAR) AS customer_unique_id,
         CAST(c_nationkey * 1000 + c_custkey % 7 AS VARCHAR) AS customer_zip_code_prefix,
         c_mktsegment AS customer_city,
         n_name AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
a_orders0 AS (
  SELECT o_orderkey AS k, o_custkey, o_orderdate,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN 'delivered'
              WHEN o_orderkey % 5 = 0 THEN 'shipped'
              WHEN o_orderkey % 5 = 1 THEN 'canceled'
              WHEN o_orderkey % 5 = 2 THEN 'processing'
              WHEN o_orderkey % 5 = 3 THEN 'unavailable'
              WHEN o_orderkey % 5 = 4 THEN 'invoiced' END AS order_status,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS pts
  FROM orders),
a_orders1 AS (
  SELECT *,
         CASE WHEN k % 97 <> 0 THEN pts + to_hours(CAST(1 + (k * 7) % 40 AS BIGINT)) END AS approved,
         CASE WHEN order_status IN ('delivered', 'shipped')
                   OR (order_status = 'canceled' AND k % 10 = 1)
              THEN pts + to_hours(CAST(24 + (k * 11) % 120 AS BIGINT)) END AS cts
  FROM a_orders0),
a_orders AS (
  SELECT CAST(k AS VARCHAR) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         order_status,
         pts AS order_purchase_timestamp,
         approved AS order_approved_at,
         cts AS order_delivered_carrier_date,
         CASE WHEN order_status IN ('delivered', 'canceled') AND k % 211 <> 0
              THEN cts + to_hours(CAST(24 + (k * 13) % 480 + (o_custkey % 5) * 24 AS BIGINT))
         END AS order_delivered_customer_date,
         o_orderdate + to_days(CAST(18 + (k % 3) * 4 AS INTEGER)) AS order_estimated_delivery_date
  FROM a_orders1),
a_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_partkey % 50 <> 0 THEN lower(p_brand) END AS product_category_name,
         CAST(length(p_name) AS BIGINT) AS product_name_lenght,
         CAST(NULL AS BIGINT) AS product_description_lenght,
         CAST(NULL AS BIGINT) AS product_photos_qty,
         CAST(p_size AS BIGINT) AS product_weight_g,
         CAST(NULL AS BIGINT) AS product_length_cm,
         CAST(NULL AS BIGINT) AS product_height_cm,
         CAST(NULL AS BIGINT) AS product_width_cm
  FROM part),
a_translation AS (
  SELECT DISTINCT lower(p_brand) AS product_category_name,
         upper(p_brand) AS product_category_name_english
  FROM part WHERE p_brand NOT IN ('Brand#24', 'Brand#25')
  UNION ALL
  SELECT * FROM (VALUES ('brand#24', 'BRAND#24'), ('sin_ventas', 'NO_SALES'))
         AS v(product_category_name, product_category_name_english)),
a_sellers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id,
         CAST(s_nationkey * 1000 + s_suppkey % 7 AS VARCHAR) AS seller_zip_code_prefix,
         lower(n_name) AS seller_city,
         n_name AS seller_state
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
a_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CAST(l_linenumber AS BIGINT) AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(l_suppkey AS VARCHAR) AS seller_id,
         l_shipdate AS shipping_limit_date,
         CAST(l_extendedprice AS DECIMAL(10, 2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(10, 2)) * CAST(l_tax AS DECIMAL(4, 2))
              AS DECIMAL(10, 2)) AS freight_value
  FROM lineitem),
a_payments AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
         CAST(seq AS BIGINT) AS payment_sequential,
         CASE (o_orderkey + seq) % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'credit_card'
              WHEN 2 THEN 'voucher' ELSE 'boleto' END AS payment_type,
         CAST(CASE WHEN (o_orderkey + seq) % 4 IN (0, 1) THEN (o_orderkey + 3 * seq) % 14
                   ELSE 1 END AS BIGINT) AS payment_installments,
         CAST(CAST(o_totalprice AS DECIMAL(10, 2))
              * CASE seq WHEN 1 THEN CAST(0.50 AS DECIMAL(3, 2))
                         WHEN 2 THEN CAST(0.30 AS DECIMAL(3, 2))
                         ELSE CAST(0.20 AS DECIMAL(3, 2)) END AS DECIMAL(10, 2)) AS payment_value
  FROM orders, (SELECT unnest([1, 2, 3]) AS seq) s
  WHERE seq <= 1 + o_orderkey % 3 AND o_orderkey % 1000 <> 0),
a_reviews AS (
  SELECT order_id || '-' || CAST(seq AS VARCHAR) AS review_id,
         order_id,
         CAST(CASE WHEN CAST(order_delivered_customer_date AS DATE)
                        > CAST(order_estimated_delivery_date AS DATE)
                   THEN 1 + (k + seq) % 3 ELSE 3 + (k + seq * 2) % 3 END AS BIGINT) AS review_score,
         CAST(NULL AS VARCHAR) AS review_comment_title,
         CAST(NULL AS VARCHAR) AS review_comment_message,
         order_purchase_timestamp AS review_creation_date,
         CAST(NULL AS TIMESTAMP) AS review_answer_timestamp
  FROM (SELECT *, CAST(order_id AS BIGINT) AS k FROM a_orders) o,
       (SELECT unnest([1, 2]) AS seq) s
  WHERE k % 50 <> 0 AND (seq = 1 OR k % 40 = 1))
"""

# ----------------------------------------------------------------------------
# order-grain facts and the star schema, stated as rules over the base relations

STAR = """
pedidos AS (  -- one row per order: lateness and stage lengths in calendar days
  SELECT *,
         coalesce(order_delivered_customer_date::DATE > order_estimated_delivery_date::DATE, FALSE) AS tarde,
         order_delivered_customer_date::DATE - order_purchase_timestamp::DATE AS d_total,
         order_delivered_carrier_date::DATE - order_approved_at::DATE AS d_vendedor,
         order_delivered_customer_date::DATE - order_delivered_carrier_date::DATE AS d_courier,
         greatest(order_delivered_customer_date::DATE - order_estimated_delivery_date::DATE, 0) AS d_demora
  FROM a_orders),
variedad AS (  -- orders with a known seller: one seller or several
  SELECT order_id, min(seller_id) <> max(seller_id) AS varios
  FROM a_items GROUP BY order_id HAVING count(seller_id) > 0),
nota AS (  -- mean score of an order in millionths
  SELECT order_id, {u} AS u FROM a_reviews GROUP BY order_id),
categoria AS (  -- products whose category has an English name
  SELECT product_id, product_category_name_english AS en
  FROM a_products JOIN a_translation USING (product_category_name)),
f_items AS (
  SELECT order_id, order_item_id, customer_id, product_id, seller_id, order_status,
         order_purchase_timestamp AS purchase_date, order_approved_at, shipping_limit_date,
         order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date,
         d_total AS delivery_days, d_vendedor AS seller_to_courier_delivery_days,
         d_courier AS courier_to_customer_delivery_days, if(tarde, 'Sí', 'No') AS is_late,
         d_demora AS delay_days, price, freight_value, price + freight_value AS subtotal
  FROM (FROM a_items JOIN pedidos USING (order_id)
        UNION ALL BY NAME
        FROM pedidos WHERE order_id NOT IN (SELECT order_id FROM a_items))),
f_payments AS (
  SELECT order_id, payment_sequential, payment_type, payment_installments, payment_value,
         customer_id, order_status, order_purchase_timestamp AS purchase_date, order_approved_at,
         order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date
  FROM (FROM a_payments JOIN a_orders USING (order_id)
        UNION ALL BY NAME
        FROM a_orders WHERE order_id NOT IN (SELECT order_id FROM a_payments))),
f_reviews AS (
  SELECT review_id, order_id, customer_id, review_score, review_comment_title,
         review_comment_message, review_creation_date, review_answer_timestamp, order_status,
         order_purchase_timestamp AS purchase_date, order_approved_at,
         order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date,
         d_total AS delivery_days, if(tarde, 'Sí', 'No') AS is_late, d_demora AS delay_days,
         coalesce((SELECT if(varios, 'Envío Dividido (+ de 1 Vendedor)', 'Envío Simple (1 Vendedor)')
                   FROM variedad v WHERE v.order_id = x.order_id), 'Sin Vendedor / Cancelado') AS tipo_logistica
  FROM (FROM a_reviews JOIN pedidos USING (order_id)
        UNION ALL BY NAME
        FROM pedidos WHERE order_id NOT IN (SELECT order_id FROM a_reviews)) x),
d_product AS (
  SELECT p.*, (SELECT max(t.product_category_name_english) FROM a_translation t
               WHERE t.product_category_name = p.product_category_name) AS product_category_name_english
  FROM a_products p)
""".replace("{u}", xq("SUM(review_score)", "COUNT(review_score)", 6))


def with_model(body: str) -> str:
    """Prefix a query with the adapter and star CTEs (unused ones are ignored)."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ADAPTER.strip()},\n{STAR.strip()},\n{body[5:]}"
    return f"WITH {ADAPTER.strip()},\n{STAR.strip()}\n{body}"
