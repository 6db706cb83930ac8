"""Declared schemas of the marketplace base tables (fixed, never inferred).

Ids and zip prefixes are strings (a zip prefix such as ``01037`` keeps its
leading zero), money is ``DECIMAL(10,2)``, instants are zone-less timestamps.
``VARCHAR_LIMITS`` keeps the declared text widths; they are checked as data
quality rules rather than enforced by truncation.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
D = T.DoubleType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


CUSTOMERS = _schema(
    ("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
    ("customer_city", S), ("customer_state", S))

ORDERS = _schema(
    ("order_id", S), ("customer_id", S), ("order_status", S),
    ("order_purchase_timestamp", TS), ("order_approved_at", TS),
    ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
    ("order_estimated_delivery_date", TS))

# The misspelt ``lenght`` columns are the real column names of the source.
PRODUCTS = _schema(
    ("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
    ("product_description_lenght", I), ("product_photos_qty", I), ("product_weight_g", I),
    ("product_length_cm", I), ("product_height_cm", I), ("product_width_cm", I))

SELLERS = _schema(
    ("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S), ("seller_state", S))

ORDER_ITEMS = _schema(
    ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
    ("shipping_limit_date", TS), ("price", MONEY), ("freight_value", MONEY))

ORDER_PAYMENTS = _schema(
    ("order_id", S), ("payment_sequential", I), ("payment_type", S),
    ("payment_installments", I), ("payment_value", MONEY))

ORDER_REVIEWS = _schema(
    ("review_id", S), ("order_id", S), ("review_score", I), ("review_comment_title", S),
    ("review_comment_message", S), ("review_creation_date", TS), ("review_answer_timestamp", TS))

CATEGORY_TRANSLATION = _schema(
    ("product_category_name", S), ("product_category_name_english", S))

GEOLOCATION = _schema(
    ("geolocation_zip_code_prefix", S), ("geolocation_lat", D), ("geolocation_lng", D),
    ("geolocation_city", S), ("geolocation_state", S))

SCHEMAS = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "category_translation": CATEGORY_TRANSLATION,
    "geolocation": GEOLOCATION,
}

# Primary keys as declared (order_payments, order_reviews, geolocation have none).
PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "order_items": ["order_id", "order_item_id"],
    "category_translation": ["product_category_name"],
}

# Foreign-key edges: (child, child column, parent, parent column).
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]

# Declared VARCHAR widths of the source tables (None = MAX).
VARCHAR_LIMITS = {
    "customers": {"customer_id": 100, "customer_unique_id": 100, "customer_zip_code_prefix": 20,
                  "customer_city": 100, "customer_state": 10},
    "orders": {"order_id": 100, "customer_id": 100, "order_status": 35},
    "products": {"product_id": 100, "product_category_name": 100},
    "sellers": {"seller_id": 100, "seller_zip_code_prefix": 20, "seller_city": 100,
                "seller_state": 10},
    "order_items": {"order_id": 100, "product_id": 100, "seller_id": 100},
    "order_payments": {"order_id": 100, "payment_type": 30},
    "order_reviews": {"review_id": 100, "order_id": 100, "review_comment_title": 255,
                      "review_comment_message": None},
    "category_translation": {"product_category_name": 100, "product_category_name_english": 100},
    "geolocation": {"geolocation_zip_code_prefix": 20, "geolocation_city": 100,
                    "geolocation_state": 10},
}

# Digits and decimals of the declared number columns (an INT has up to ten digits and no decimals).
NUMERIC_LIMITS = {
    name: {f.name: (f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, T.DecimalType) else (10, 0)
           for f in schema.fields if isinstance(f.dataType, (T.DecimalType, T.IntegerType))}
    for name, schema in SCHEMAS.items()}

# Default file name of each table inside a landing folder (overridable).
SOURCE_FILES = {name: f"{name}.csv" for name in SCHEMAS}
