"""Order-grain building blocks reused by many reports.

Every report that joins items, payments or reviews to orders first collapses
the child table to one row per order (a partial + final hash aggregate on
``order_id``). The join that follows is then 1:1, a hot order can no longer
skew it, and its input is already hash-partitioned on the join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import NEGATIVE_SCORE_MAX, day_diff, delay_days, is_late
from ..sources.tables import Tables, shared_plan


@shared_plan
def item_totals_by_order(t: Tables) -> DataFrame:
    """Per order: item count, sum of price, freight and price+freight."""
    return t.order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("price").alias("sum_price"),
        F.sum("freight_value").alias("sum_freight"),
        F.sum(F.col("price") + F.col("freight_value")).alias("sum_subtotal"))


@shared_plan
def review_stats_by_order(t: Tables) -> DataFrame:
    """Per order: review rows, scored rows, score sum and negative reviews."""
    s = F.col("review_score")
    return t.order_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count(s).alias("n_scored"),
        F.sum(s).alias("sum_score"),
        F.count_if(s <= NEGATIVE_SCORE_MAX).alias("n_negative"))


@shared_plan
def order_logistics(t: Tables) -> DataFrame:
    """One row per order with the delivery metrics of the item fact.

    Every order appears in the item fact at least once and these columns are
    order attributes, so this equals the item fact collapsed to order grain -
    without touching the item table at all.
    """
    o = t.orders
    return o.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        "order_delivered_customer_date", "order_estimated_delivery_date",
        day_diff("order_purchase_timestamp", "order_delivered_customer_date").alias("delivery_days"),
        day_diff("order_approved_at", "order_delivered_carrier_date")
        .alias("seller_to_courier_delivery_days"),
        day_diff("order_delivered_carrier_date", "order_delivered_customer_date")
        .alias("courier_to_customer_delivery_days"),
        is_late("order_delivered_customer_date", "order_estimated_delivery_date").alias("late"),
        delay_days("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("delay_days"))


def purchase_month(ts: str = "order_purchase_timestamp") -> list:
    return [F.year(ts).alias("anio"), F.month(ts).alias("mes")]
