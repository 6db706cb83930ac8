"""Star schema: three grain-separated facts and four conformed dimensions.

Facts are never joined to each other row-wise (an order with 3 items, 2
payments and 1 review would otherwise fan out to 6 rows). Each fact keeps
every order, with NULL child columns for orders that have no child rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import day_diff, delay_days, late_label, logistics_type
from ..operators.joins import keep_parents_join
from ..sources.tables import Tables, shared_plan

# English month and weekday names of the calendar dimension.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

_ORDER_DATES = ["order_approved_at", "order_delivered_carrier_date",
                "order_delivered_customer_date", "order_estimated_delivery_date"]


@shared_plan
def dim_customer(t: Tables) -> DataFrame:
    return t.customers.select("customer_id", "customer_unique_id", "customer_zip_code_prefix",
                              "customer_city", "customer_state")


@shared_plan
def dim_product(t: Tables) -> DataFrame:
    """Products with their English category; uncategorised products are kept."""
    p = t.products
    return (p.join(t.category_translation, "product_category_name", "left")
            .select("product_id", "product_category_name", "product_category_name_english",
                    "product_name_lenght", "product_description_lenght", "product_photos_qty",
                    "product_weight_g", "product_length_cm", "product_height_cm",
                    "product_width_cm"))


@shared_plan
def dim_seller(t: Tables) -> DataFrame:
    return t.sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")


@shared_plan
def dim_calendar(t: Tables) -> DataFrame:
    """One row per day between the first and last purchase date (gap-free).

    The span is bounded by the calendar, not by data volume: the global min/max
    is a partial aggregate, and only the resulting day list is generated.
    """
    month_names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    day_names = F.array(*[F.lit(d) for d in DAY_NAMES])
    span = t.orders.agg(F.min(F.to_date("order_purchase_timestamp")).alias("lo"),
                        F.max(F.to_date("order_purchase_timestamp")).alias("hi"))
    days = span.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    d = F.col("date")
    return days.select(
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.element_at(month_names, F.month(d)).alias("month_name"),
        (F.weekday(d) + 1).alias("day_of_week"),
        F.element_at(day_names, F.weekday(d) + 1).alias("day_name"))


@shared_plan
def _order_side(t: Tables) -> DataFrame:
    # renamed to purchase_date only after the join, so that both branches of
    # keep_parents_join read an identical parent plan (one shared exchange)
    return t.orders.select("order_id", "customer_id", "order_status",
                           "order_purchase_timestamp", *_ORDER_DATES)


_PURCHASE = "order_purchase_timestamp"


@shared_plan
def fact_order_items(t: Tables) -> DataFrame:
    """Item grain plus one all-NULL-item row per order without items."""
    items = t.order_items.select("order_id", "order_item_id", "product_id", "seller_id",
                                 "shipping_limit_date", "price", "freight_value")
    j = keep_parents_join(_order_side(t), items, "order_id")
    return j.select(
        "order_id", "order_item_id", "customer_id", "product_id", "seller_id", "order_status",
        F.col(_PURCHASE).alias("purchase_date"), "order_approved_at", "shipping_limit_date",
        "order_delivered_carrier_date", "order_delivered_customer_date",
        "order_estimated_delivery_date",
        day_diff(_PURCHASE, "order_delivered_customer_date").alias("delivery_days"),
        day_diff("order_approved_at", "order_delivered_carrier_date")
        .alias("seller_to_courier_delivery_days"),
        day_diff("order_delivered_carrier_date", "order_delivered_customer_date")
        .alias("courier_to_customer_delivery_days"),
        late_label("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("is_late"),
        delay_days("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("delay_days"),
        "price", "freight_value",
        (F.col("price") + F.col("freight_value")).alias("subtotal"))


@shared_plan
def fact_order_payments(t: Tables) -> DataFrame:
    """Payment grain plus one NULL-payment row per unpaid order."""
    pays = t.order_payments.select("order_id", "payment_sequential", "payment_type",
                                   "payment_installments", "payment_value")
    j = keep_parents_join(_order_side(t), pays, "order_id")
    return j.select("order_id", "payment_sequential", "payment_type", "payment_installments",
                    "payment_value", "customer_id", "order_status",
                    F.col(_PURCHASE).alias("purchase_date"), *_ORDER_DATES)


@shared_plan
def sellers_per_order(t: Tables) -> DataFrame:
    """Distinct sellers per order (a two-phase distinct aggregate, skew-safe)."""
    return (t.order_items.groupBy("order_id")
            .agg(F.count_distinct("seller_id").alias("cantidad_vendedores")))


@shared_plan
def fact_order_reviews(t: Tables) -> DataFrame:
    """Review grain plus one row per unreviewed order, with the shipment type."""
    orders = _order_side(t).join(sellers_per_order(t), "order_id", "left")
    reviews = t.order_reviews.select("order_id", "review_id", "review_score",
                                     "review_comment_title", "review_comment_message",
                                     "review_creation_date", "review_answer_timestamp")
    j = keep_parents_join(orders, reviews, "order_id")
    return j.select(
        "review_id", "order_id", "customer_id", "review_score", "review_comment_title",
        "review_comment_message", "review_creation_date", "review_answer_timestamp",
        "order_status", F.col(_PURCHASE).alias("purchase_date"), *_ORDER_DATES,
        day_diff(_PURCHASE, "order_delivered_customer_date").alias("delivery_days"),
        late_label("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("is_late"),
        delay_days("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("delay_days"),
        logistics_type("cantidad_vendedores").alias("tipo_logistica"))


STAR_BUILDERS = {
    "dim_customer": dim_customer,
    "dim_product": dim_product,
    "dim_seller": dim_seller,
    "dim_calendar": dim_calendar,
    "fact_order_items": fact_order_items,
    "fact_order_payments": fact_order_payments,
    "fact_order_reviews": fact_order_reviews,
}


def register_star(spark: SparkSession, t: Tables, prefix: str = "analytics_") -> None:
    """Named views over the builders (views stay lazy; nothing is materialised)."""
    for name, build in STAR_BUILDERS.items():
        build(t).createOrReplaceTempView(f"{prefix}{name}")
