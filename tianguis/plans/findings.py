"""Findings H1-H5 and category/state/payment breakdowns B1-B5.

Semantics follow the report exactly (grains, filters, NULL handling); the
plans differ where a cheaper shape gives the same rows:

* order-level attributes (lateness, transit days) are read from the order
  table instead of being re-aggregated from the item fact;
* child tables are aggregated to order grain before any join;
* lateness is aggregated as a Boolean (hash aggregate) and labelled last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (CREDIT_CARD, DELIVERED, LATE_DELIVERY, ON_TIME_DELIVERY,
                               SINGLE_SELLER, SPLIT_SHIPMENT, installment_range,
                               ratio, share_pct, yes_no)
from ..sources.tables import Tables, shared_plan
from .common import order_logistics, review_stats_by_order
from .star import fact_order_payments


@shared_plan
def order_mean_score(t: Tables) -> DataFrame:
    """Per-order mean review score, HALF_UP at 6 decimals (order grain)."""
    return review_stats_by_order(t).select(
        "order_id", ratio("sum_score", "n_scored", 6).alias("avg_review_score"))


def h1_score_by_lateness(t: Tables) -> DataFrame:
    """Mean over orders of the per-order mean score, late vs not late.

    'Not late' includes undelivered orders; unreviewed orders drop out of the
    mean. Always two rows (a group with no orders gives a NULL score).
    """
    o = order_logistics(t).select("order_id", "late")
    j = o.join(order_mean_score(t), "order_id", "left")
    s, late = F.col("avg_review_score"), F.col("late")
    a = j.agg(F.sum(F.when(late, s)).alias("ls"), F.count(F.when(late, s)).alias("lc"),
              F.sum(F.when(~late, s)).alias("os"), F.count(F.when(~late, s)).alias("oc"))
    return a.select(F.explode(F.array(
        F.struct(F.lit(LATE_DELIVERY).alias("tipo_entrega"),
                 ratio("ls", "lc", 2, num_scale=6).alias("score_promedio")),
        F.struct(F.lit(ON_TIME_DELIVERY).alias("tipo_entrega"),
                 ratio("os", "oc", 2, num_scale=6).alias("score_promedio")))).alias("r")
    ).select("r.*")


def h2_score_by_shipment_type(t: Tables) -> DataFrame:
    """Review-grain mean score for single- vs multi-seller orders.

    ``volumen_ordenes`` counts review-fact rows: an order with two reviews
    counts twice and an unreviewed order counts once. Orders without sellers
    are excluded.
    """
    sellers = t.order_items.groupBy("order_id").agg(
        F.min("seller_id").alias("_lo"), F.max("seller_id").alias("_hi")).where("_lo is not null")
    per = (t.orders.select("order_id").join(sellers, "order_id")
           .join(review_stats_by_order(t), "order_id", "left"))
    kind = F.when(F.col("_lo") == F.col("_hi"), F.lit(SINGLE_SELLER)).otherwise(F.lit(SPLIT_SHIPMENT))
    return (per.groupBy(kind.alias("tipo_logistica")).agg(
        F.sum(F.coalesce("n_reviews", F.lit(1))).alias("volumen_ordenes"),
        ratio("sum(sum_score)", "sum(n_scored)", 2).alias("score_promedio"))
        .orderBy("tipo_logistica"))


def h3_transit_days_by_lateness(t: Tables) -> DataFrame:
    """Delivered orders: mean seller->courier and courier->customer days, by lateness."""
    o = order_logistics(t).where(F.col("order_status") == DELIVERED)
    s2c, c2c = "seller_to_courier_delivery_days", "courier_to_customer_delivery_days"
    g = o.groupBy("late").agg(
        ratio(f"sum({s2c})", f"count({s2c})", 2).alias("avg_seller_to_courier"),
        ratio(f"sum({c2c})", f"count({c2c})", 2).alias("avg_courier_to_customer"))
    return g.select(yes_no("late").alias("is_late"), "avg_seller_to_courier",
                    "avg_courier_to_customer")


def h4_sellers_by_late_rate(t: Tables, min_orders: int = 30) -> DataFrame:
    """Sellers with at least ``min_orders`` delivered (order, seller) pairs.

    Delivered orders without items form a NULL-seller row, as in the item fact.
    """
    o = (order_logistics(t).where(F.col("order_status") == DELIVERED)
         .select("order_id", "late", "delay_days"))
    pairs = o.join(t.order_items.select("order_id", "seller_id").distinct(), "order_id", "left")
    late = F.col("late")
    g = pairs.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("total_pedidos"),
        F.count_if(late).alias("pedidos_con_retraso"),
        F.sum(F.when(late, F.col("delay_days"))).alias("_ds"),
        F.count(F.when(late, F.col("delay_days"))).alias("_dc"))
    return (g.where(F.col("total_pedidos") >= min_orders)
            .select("seller_id", "total_pedidos", "pedidos_con_retraso",
                    share_pct("pedidos_con_retraso", "total_pedidos").alias("tasa_retraso"),
                    ratio("_ds", "_dc", 2).alias("dias_promedio_retraso"))
            .orderBy(F.desc("tasa_retraso")))


@shared_plan
def _translated_products(t: Tables) -> DataFrame:
    return (t.products.select("product_id", "product_category_name")
            .join(t.category_translation, "product_category_name"))


def b1_score_by_category(t: Tables) -> DataFrame:
    """Order mean score repeated per item, averaged per English category. Items are shuffled
    once, by order, and on the left, where a hot order is split; sums per product follow."""
    scored = (order_mean_score(t).where(F.col("avg_review_score").isNotNull())
              .join(t.orders.select("order_id").distinct(), "order_id", "left_semi"))
    per = (t.order_items.select("order_id", "product_id").join(scored, "order_id")
           .groupBy("product_id").agg(F.sum("avg_review_score").alias("_s"), F.count(F.lit(1)).alias("_n"))
           .join(_translated_products(t), "product_id"))
    g = per.groupBy(F.col("product_category_name_english").alias("categoria")).agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return (g.select("categoria", ratio("_s", "_n", 2, num_scale=6).alias("score_promedio"))
            .orderBy("score_promedio"))


def b2_late_rate_by_category(t: Tables) -> DataFrame:
    """Grain (order, product): ``total_pedidos`` counts order-product pairs."""
    pairs = (t.order_items.select("order_id", "product_id").distinct()
             .join(order_logistics(t).select("order_id", "late"), "order_id"))
    per = pairs.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("late").alias("_l"))
    j = per.join(_translated_products(t), "product_id")
    g = j.groupBy(F.col("product_category_name_english").alias("categoria")).agg(
        F.sum("_n").alias("total_pedidos"), F.sum("_l").alias("pedidos_con_retraso"))
    return (g.select("categoria", "total_pedidos", "pedidos_con_retraso",
                     share_pct("pedidos_con_retraso", "total_pedidos").alias("tasa_retraso"))
            .orderBy(F.desc("tasa_retraso")))


def b3_late_rate_by_state(t: Tables) -> DataFrame:
    """Late share of orders with a delivery date, per buyer state (a fraction).
    A state with no delivered order has a NULL rate."""
    o = t.orders
    late = F.to_date("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    j = (o.select("customer_id", late.alias("late"),
                  F.col("order_delivered_customer_date").isNotNull().alias("has_date"))
         .join(t.customers.select("customer_id", "customer_state"), "customer_id"))
    g = j.groupBy("customer_state").agg(F.count_if("late").alias("_l"),
                                        F.count_if("has_date").alias("_d"))
    return (g.select("customer_state", ratio("_l", "_d", 4).alias("tasa_retraso"))
            .orderBy(F.desc("tasa_retraso")))


def b4_revenue_by_category(t: Tables) -> DataFrame:
    """Item price per English category (no freight, uncategorised dropped)."""
    known = t.order_items.select("order_id", "product_id", "price").join(
        t.orders.select("order_id").distinct(), "order_id", "left_semi")
    per_product = known.groupBy("product_id").agg(F.sum("price").alias("sp"))
    j = per_product.join(_translated_products(t), "product_id")
    return (j.groupBy(F.col("product_category_name_english").alias("categoria"))
            .agg(F.sum("sp").alias("ingreso")).orderBy(F.desc("ingreso")))


def h5_ticket_by_installments(t: Tables) -> DataFrame:
    """Mean credit-card payment value per installment range (payment rows);
    0 and NULL installments land in the open-ended last range."""
    p = (fact_order_payments(t).where(F.col("payment_type") == CREDIT_CARD)
         .select(installment_range("payment_installments").alias("rango_cuotas"),
                 "payment_value"))
    g = p.groupBy("rango_cuotas").agg(
        ratio("sum(payment_value)", "count(payment_value)", 6, num_scale=2)
        .alias("ticket_promedio"))
    return g.orderBy("ticket_promedio")


def b5_payment_type_distribution(t: Tables) -> DataFrame:
    """(order, type) pairs per payment type; unpaid orders form a NULL type."""
    kinds = t.order_payments.select("order_id", "payment_type").distinct()
    f = t.orders.select("order_id").distinct().join(kinds, "order_id", "left")
    return (f.groupBy("payment_type").agg(F.count(F.lit(1)).alias("total_ordenes"))
            .orderBy(F.desc("total_ordenes")))


FINDINGS = {
    "h1_score_by_lateness": h1_score_by_lateness,
    "h2_score_by_shipment_type": h2_score_by_shipment_type,
    "h3_transit_days_by_lateness": h3_transit_days_by_lateness,
    "h4_sellers_by_late_rate": h4_sellers_by_late_rate,
    "h5_ticket_by_installments": h5_ticket_by_installments,
    "b1_score_by_category": b1_score_by_category,
    "b2_late_rate_by_category": b2_late_rate_by_category,
    "b3_late_rate_by_state": b3_late_rate_by_state,
    "b4_revenue_by_category": b4_revenue_by_category,
    "b5_payment_type_distribution": b5_payment_type_distribution,
}
