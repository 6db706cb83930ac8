"""Dashboard datasets V1-V17: one DataFrame per visual.

KPI strips are returned in long format (``kpi``, ``valor``), each from one aggregate
of the measure algebra (``plans.algebra``): a strip scans each table once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (DELIVERED, INSTALLMENT_RANGES, NEGATIVE_SCORE_MAX, ratio,
                               share_pct, yes_no)
from ..sources.tables import Tables
from .algebra import kpi_strip
from .common import order_logistics, purchase_month, review_stats_by_order
from .findings import (b1_score_by_category, b4_revenue_by_category, h3_transit_days_by_lateness,
                       h4_sellers_by_late_rate, h5_ticket_by_installments, order_mean_score)
from .star import dim_customer, dim_seller

# Transit stage labels of the stacked bar.
STAGE_SELLER = "Vendedor → Courier"
STAGE_COURIER = "Courier → Cliente"


def v01_kpis_overview(t: Tables) -> DataFrame:
    """M6-M10 and M1: six measures of the algebra from one aggregate at order grain."""
    return kpi_strip(t, ["total_ingresos", "total_pedidos", "ticket_promedio", "score_promedio",
                         "tasa_insatisfaccion", "tasa_entrega"])


def v02_monthly_revenue(t: Tables) -> DataFrame:
    """Item revenue (price) per purchase month - the trend line."""
    per = (t.order_items.groupBy("order_id").agg(F.sum("price").alias("sp"))
           .join(t.orders.select("order_id", "order_purchase_timestamp"), "order_id"))
    return (per.groupBy(*purchase_month()).agg(F.sum("sp").alias("total_ingresos"))
            .orderBy("anio", "mes"))


def v03_revenue_by_category(t: Tables) -> DataFrame:
    """B4 with each category's share of the translated revenue (bars)."""
    b4 = b4_revenue_by_category(t)
    return b4.select("categoria", "ingreso",
                     share_pct("ingreso", F.sum("ingreso").over(Window.partitionBy()),
                               num_scale=2, den_scale=2).alias("porcentaje")
                     ).orderBy(F.desc("ingreso"), "categoria")


def v04_top_states_by_revenue(t: Tables, n: int = 10) -> DataFrame:
    """Item revenue per buyer state (orders without a known customer form NULL)."""
    per = (t.order_items.groupBy("order_id").agg(F.sum("price").alias("sp"))
           .join(t.orders.select("order_id", "customer_id"), "order_id")
           .join(dim_customer(t).select("customer_id", "customer_state"), "customer_id", "left"))
    g = per.groupBy("customer_state").agg(F.sum("sp").alias("total_ingresos"))
    return g.orderBy(F.desc_nulls_last("total_ingresos"), F.asc_nulls_first("customer_state")).limit(n)


def v05_delivery_donut(t: Tables) -> DataFrame:
    g = (t.orders.groupBy(yes_no(F.col("order_status") == DELIVERED).alias("entregado"))
         .agg(F.count(F.lit(1)).alias("pedidos")))
    return g.select("entregado", "pedidos",
                    share_pct("pedidos", F.sum("pedidos").over(Window.partitionBy()))
                    .alias("porcentaje"))


def v06_stars_by_lateness(t: Tables) -> DataFrame:
    """Orders per rounded mean score (1-5 stars), split by lateness."""
    s = (review_stats_by_order(t)
         .select("order_id", ratio("sum_score", "n_scored", 0).cast("int").alias("puntuacion"))
         .join(order_logistics(t).select("order_id", "late"), "order_id"))
    return (s.groupBy(yes_no("late").alias("is_late"), "puntuacion")
            .agg(F.count(F.lit(1)).alias("total_ordenes")))


def v07_worst_categories(t: Tables, n: int = 20) -> DataFrame:
    return b1_score_by_category(t).orderBy(F.asc_nulls_last("score_promedio"),
                                           F.asc_nulls_first("categoria")).limit(n)


def v08_category_detail(t: Tables) -> DataFrame:
    """Per category: order-product pairs, mean score (B1), late rate (B2),
    inverse score (5 - score) and inefficiency rate (share of pairs late or with
    an order mean score of at most 2) - B1 and B2 in one pass over the
    (order, product, item count) aggregate."""
    per = (t.order_items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
           .join(order_logistics(t).select("order_id", "late"), "order_id")
           .join(order_mean_score(t), "order_id", "left"))
    s = F.col("avg_review_score")
    bad = F.col("late") | F.coalesce(s <= NEGATIVE_SCORE_MAX, F.lit(False))
    per = per.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total_pedidos"),
        F.count_if("late").alias("_late"),
        F.count_if(bad).alias("_bad"),
        F.sum(F.when(s.isNotNull(), F.col("n") * s)).alias("_s"),
        F.sum(F.when(s.isNotNull(), F.col("n"))).alias("_n"))
    named = per.join(t.products.select("product_id", "product_category_name")
                     .join(t.category_translation, "product_category_name"), "product_id")
    g = named.groupBy(F.col("product_category_name_english").alias("categoria")).agg(
        *[F.sum(c).alias(c) for c in ("total_pedidos", "_late", "_bad", "_s", "_n")])
    score = ratio("_s", "_n", 2, num_scale=6)
    return g.select("categoria", "total_pedidos", score.alias("score_promedio"),
                    share_pct("_late", "total_pedidos").alias("tasa_retraso"),
                    (F.lit(5) - score).alias("score_inverso"),
                    share_pct("_bad", "total_pedidos").alias("tasa_ineficiencia")
                    ).orderBy(F.desc("tasa_ineficiencia"), "categoria")


def v09_kpis_logistics(t: Tables) -> DataFrame:
    """M11 and M2 in one pass over the orders."""
    return kpi_strip(t, ["dias_vendedor_courier", "dias_courier_cliente", "dias_entrega",
                         "dias_retraso", "tasa_retraso"])


def v10_transit_stages(t: Tables) -> DataFrame:
    """H3 in long format for a stacked bar: (is_late, etapa, dias)."""
    h = h3_transit_days_by_lateness(t)
    return h.select("is_late", F.explode(F.array(
        F.struct(F.lit(STAGE_SELLER).alias("etapa"), F.col("avg_seller_to_courier").alias("dias")),
        F.struct(F.lit(STAGE_COURIER).alias("etapa"), F.col("avg_courier_to_customer").alias("dias"))
    )).alias("s")).select("is_late", "s.etapa", "s.dias")


def v11_late_rate_by_state(t: Tables, states: Sequence[str] | None = None) -> DataFrame:
    """Map data: late rate (%) per buyer state among orders with a delivery date.
    ``states`` is the page slicer (P15); the filter reaches the customer scan."""
    c = t.customers.select("customer_id", "customer_state")
    if states is not None:
        c = c.where(F.col("customer_state").isin(list(states)))
    o = order_logistics(t).select("customer_id", "late", "delivery_days")
    g = (o.join(c, "customer_id").groupBy("customer_state").agg(
        F.count_if(F.col("delivery_days").isNotNull()).alias("pedidos_entregados"),
        F.count_if("late").alias("pedidos_con_retraso")))
    return (g.withColumn("tasa_retraso", share_pct("pedidos_con_retraso", "pedidos_entregados"))
            .orderBy(F.desc("tasa_retraso"), "customer_state"))


def v12_worst_sellers(t: Tables) -> DataFrame:
    """H4 with the seller's location for the table visual."""
    return h4_sellers_by_late_rate(t).join(dim_seller(t), "seller_id", "left").select(
        "seller_id", "seller_city", "seller_state", "total_pedidos", "pedidos_con_retraso",
        "tasa_retraso", "dias_promedio_retraso").orderBy(F.desc("tasa_retraso"), "seller_id")


def v13_kpis_payments(t: Tables) -> DataFrame:
    """M12, M3 and the credit-card share of payment rows (those without an order
    included) from one pass over the payments at order grain."""
    return kpi_strip(t, ["total_pagado", "cuotas_promedio", "pago_promedio", "participacion_tarjeta"])


def v14_payment_donut(t: Tables) -> DataFrame:
    from .findings import b5_payment_type_distribution
    b5 = b5_payment_type_distribution(t)
    return b5.select("payment_type", "total_ordenes",
                     share_pct("total_ordenes", F.sum("total_ordenes").over(Window.partitionBy()))
                     .alias("porcentaje"))


def v15_ticket_by_installments(t: Tables) -> DataFrame:
    """H5 plus each range's multiplier against the single-installment ticket."""
    base_label = INSTALLMENT_RANGES[0][0]
    h = h5_ticket_by_installments(t)
    base = F.max(F.when(F.col("rango_cuotas") == base_label, F.col("ticket_promedio"))).over(
        Window.partitionBy())
    return h.select("rango_cuotas", "ticket_promedio",
                    ratio("ticket_promedio", base, 2, num_scale=6, den_scale=6)
                    .alias("multiplicador"))


def v16_ticket_by_month(t: Tables) -> DataFrame:
    """Average ticket (price / orders with items) per purchase month."""
    per = (t.order_items.groupBy("order_id").agg(F.sum("price").alias("sp"))
           .join(t.orders.select("order_id", "order_purchase_timestamp"), "order_id"))
    g = per.groupBy(*purchase_month()).agg(F.sum("sp").alias("total_ingresos"),
                                           F.count(F.lit(1)).alias("pedidos_con_items"))
    return g.withColumn("ticket_promedio",
                        ratio("total_ingresos", "pedidos_con_items", 2, num_scale=2))


def v17_top_states_by_customers(t: Tables, n: int = 10) -> DataFrame:
    """Distinct customers (persons) per state, from the customer dimension."""
    g = dim_customer(t).groupBy("customer_state").agg(
        F.count_distinct("customer_unique_id").alias("clientes_unicos"))
    return g.orderBy(F.desc("clientes_unicos"), F.asc_nulls_first("customer_state")).limit(n)


DASHBOARD = {
    "v01_kpis_overview": v01_kpis_overview,
    "v02_monthly_revenue": v02_monthly_revenue,
    "v03_revenue_by_category": v03_revenue_by_category,
    "v04_top_states_by_revenue": v04_top_states_by_revenue,
    "v05_delivery_donut": v05_delivery_donut,
    "v06_stars_by_lateness": v06_stars_by_lateness,
    "v07_worst_categories": v07_worst_categories,
    "v08_category_detail": v08_category_detail,
    "v09_kpis_logistics": v09_kpis_logistics,
    "v10_transit_stages": v10_transit_stages,
    "v11_late_rate_by_state": v11_late_rate_by_state,
    "v12_worst_sellers": v12_worst_sellers,
    "v13_kpis_payments": v13_kpis_payments,
    "v14_payment_donut": v14_payment_donut,
    "v15_ticket_by_installments": v15_ticket_by_installments,
    "v16_ticket_by_month": v16_ticket_by_month,
    "v17_top_states_by_customers": v17_top_states_by_customers,
}
