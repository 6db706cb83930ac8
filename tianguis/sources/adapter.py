"""Derive the marketplace model from the driver's TPC-H-like parquet tables.

The driver tables carry no payments, reviews, delivery dates or NULLs, so they
are derived deterministically with expressions DuckDB can evaluate identically
(the oracle in ``tianguis.oracle.sql`` holds the same mapping in SQL). Every
derived relation is a lazy projection of a scan, so predicates and column
pruning of later queries reach the parquet readers.

The key-modulo rules below *synthesise* the model's variety (order statuses,
1-3 payments per order, a few unpaid and unreviewed orders, second reviews,
missing dates); they are part of the data derivation, never a way to thin the
input - every driver row is used.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import DELIVERED, dec, is_late
from .tables import Tables

# Driver order status -> marketplace status. 'F' and 'P' orders
# are delivered; open ('O') orders spread over five statuses by order key.
OPEN_STATUS_BY_KEY_MOD_5 = ["shipped", "canceled", "processing", "unavailable", "invoiced"]
# Payment types by (order key + sequence) % 4, and value weights per sequence.
PAYMENT_TYPE_BY_MOD_4 = ["credit_card", "credit_card", "voucher", "boleto"]
PAYMENT_WEIGHTS = ["0.50", "0.30", "0.20"]
# Brands left out of the translation file; one is inserted back later,
# plus one translation no product uses.
UNTRANSLATED_BRANDS = ["Brand#24", "Brand#25"]
INSERTED_TRANSLATIONS = [("brand#24", "BRAND#24"), ("sin_ventas", "NO_SALES")]


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _hours(n) -> F.Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def _days(n) -> F.Column:
    return F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    # nation is the fixed 25-row TPC-H dimension: a proven broadcast size.
    return (customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey, "left")
            .select(
                F.col("c_custkey").cast("string").alias("customer_id"),
                (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string").alias("customer_unique_id"),
                (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 7).cast("string")
                .alias("customer_zip_code_prefix"),
                F.col("c_mktsegment").alias("customer_city"),
                F.col("n_name").alias("customer_state")))


def orders(o: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus").isin("F", "P"), F.lit(DELIVERED))
    for i, name in enumerate(OPEN_STATUS_BY_KEY_MOD_5):
        status = status.when(key % 5 == i, F.lit(name))
    pts = F.col("o_orderdate") + _hours(key % 24)
    approved = F.when(key % 97 != 0, pts + _hours(1 + (key * 7) % 40))
    st = F.col("order_status")
    carrier = F.when(st.isin(DELIVERED, "shipped") | ((st == "canceled") & (key % 10 == 1)),
                     F.col("order_purchase_timestamp") + _hours(24 + (key * 11) % 120))
    customer = F.when(st.isin(DELIVERED, "canceled") & (key % 211 != 0),
                      F.col("order_delivered_carrier_date")
                      + _hours(24 + (key * 13) % 480 + (F.col("o_custkey") % 5) * 24))
    return (o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
            .withColumns({"order_status": status, "order_purchase_timestamp": pts,
                          "order_approved_at": approved})
            .withColumns({"order_delivered_carrier_date": carrier})
            .withColumns({"order_delivered_customer_date": customer,
                          "order_estimated_delivery_date":
                              F.col("o_orderdate") + _days(18 + (key % 3) * 4)})
            .select(key.cast("string").alias("order_id"),
                    F.col("o_custkey").cast("string").alias("customer_id"),
                    "order_status", "order_purchase_timestamp", "order_approved_at",
                    "order_delivered_carrier_date", "order_delivered_customer_date",
                    "order_estimated_delivery_date"))


def products(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    null_int = F.lit(None).cast("int")
    return part.select(
        k.cast("string").alias("product_id"),
        F.when(k % 50 != 0, F.lower("p_brand")).alias("product_category_name"),
        F.length("p_name").cast("int").alias("product_name_lenght"),
        null_int.alias("product_description_lenght"),
        null_int.alias("product_photos_qty"),
        F.col("p_size").cast("int").alias("product_weight_g"),
        null_int.alias("product_length_cm"),
        null_int.alias("product_height_cm"),
        null_int.alias("product_width_cm"))


def category_translation_file(part: DataFrame) -> DataFrame:
    """The translation file as delivered: one row per brand, two brands missing."""
    return (part.where(~F.col("p_brand").isin(*UNTRANSLATED_BRANDS))
            .select(F.lower("p_brand").alias("product_category_name"),
                    F.upper("p_brand").alias("product_category_name_english"))
            .distinct())


def sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return (supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey, "left")
            .select(F.col("s_suppkey").cast("string").alias("seller_id"),
                    (F.col("s_nationkey") * 1000 + F.col("s_suppkey") % 7).cast("string")
                    .alias("seller_zip_code_prefix"),
                    F.lower("n_name").alias("seller_city"),
                    F.col("n_name").alias("seller_state")))


def order_items(lineitem: DataFrame) -> DataFrame:
    """Line items; ``order_item_id`` is the line number of the source (it may repeat
    within an order, which the key report shows)."""
    price = F.col("l_extendedprice").cast(dec(10, 2))
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").cast("int").alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        (price * F.col("l_tax").cast(dec(4, 2))).cast(dec(10, 2)).alias("freight_value"))


def order_payments(o: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    seq = F.col("payment_sequential")
    ptype = None
    for i, name in enumerate(PAYMENT_TYPE_BY_MOD_4):
        cond = (key + seq) % 4 == i
        ptype = F.when(cond, F.lit(name)) if ptype is None else ptype.when(cond, F.lit(name))
    weight = None
    for i, w in enumerate(PAYMENT_WEIGHTS, start=1):
        lit = F.lit(w).cast(dec(3, 2))
        weight = F.when(seq == i, lit) if weight is None else weight.when(seq == i, lit)
    return (o.select("o_orderkey", "o_totalprice")
            .where(key % 1000 != 0)
            .withColumn("payment_sequential", F.explode(F.sequence(F.lit(1), F.lit(3))))
            .where(seq <= 1 + key % 3)
            .withColumn("payment_type", ptype)
            .select(key.cast("string").alias("order_id"),
                    seq.cast("int").alias("payment_sequential"),
                    "payment_type",
                    F.when(F.col("payment_type") == "credit_card", (key + 3 * seq) % 14)
                    .otherwise(F.lit(1)).cast("int").alias("payment_installments"),
                    (F.col("o_totalprice").cast(dec(10, 2)) * weight).cast(dec(10, 2))
                    .alias("payment_value")))


def order_reviews(adapted_orders: DataFrame) -> DataFrame:
    key = F.col("order_id").cast("bigint")
    seq = F.col("seq")
    late = is_late("order_delivered_customer_date", "order_estimated_delivery_date")
    score = F.when(late, 1 + (key + seq) % 3).otherwise(3 + (key + seq * 2) % 3)
    null_s = F.lit(None).cast("string")
    return (adapted_orders
            .select("order_id", "order_purchase_timestamp", "order_delivered_customer_date",
                    "order_estimated_delivery_date")
            .where(key % 50 != 0)
            .withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(2))))
            .where((seq == 1) | (key % 40 == 1))
            .select(F.concat("order_id", F.lit("-"), seq.cast("string")).alias("review_id"),
                    "order_id",
                    score.cast("int").alias("review_score"),
                    null_s.alias("review_comment_title"),
                    null_s.alias("review_comment_message"),
                    F.col("order_purchase_timestamp").alias("review_creation_date"),
                    F.lit(None).cast("timestamp_ntz").alias("review_answer_timestamp")))


def translation_inserts(spark: SparkSession) -> DataFrame:
    """The literal rows of the insert, as a JVM-side local relation."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(a).alias("product_category_name"),
                 F.lit(b).alias("product_category_name_english"))
        for a, b in INSERTED_TRANSLATIONS]))
    return spark.range(1).select(rows)


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All marketplace relations over the driver tables in ``sf_dir`` (lazy)."""
    from ..operators.clean import insert_missing  # local import: avoids a cycle

    r = lambda n: read_driver(spark, sf_dir, n)
    nation = r("nation").select("n_nationkey", "n_name")
    o = r("orders")
    adapted_orders = orders(o)
    part = r("part")
    return Tables(
        customers=customers(r("customer"), nation),
        orders=adapted_orders,
        products=products(part),
        sellers=sellers(r("supplier"), nation),
        order_items=order_items(r("lineitem")),
        order_payments=order_payments(o),
        order_reviews=order_reviews(adapted_orders),
        category_translation=insert_missing(category_translation_file(part),
                                            translation_inserts(spark),
                                            ["product_category_name"]),
    )
