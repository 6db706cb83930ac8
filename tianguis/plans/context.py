"""Filter context: slicers on dimensions propagated to every related table.

A dashboard slicer (e.g. buyer state) filters a dimension, and the model's
relationships carry the filter to the facts. Here the same happens with
predicates pushed to the dimension scans and LEFT SEMI joins on distinct keys:
customers -> orders -> items / payments / reviews. Products and sellers are
dimensions of the item fact alone, so their slicers reach the items only;
``both_directions`` carries them on to the orders that hold such an item and to
everything of these orders. Any report or measure then runs unchanged on the
sliced ``Tables``. Semi joins never duplicate rows, their right sides hold one
row per key, and a sliced dimension is usually small enough for AQE to broadcast.

``dates`` is a predicate on the calendar (date, year, quarter, month, month_name,
day_of_week, day_name): it selects the orders bought on these days. On the published
mart (``sliced_mart``) the months of the selected days prune the facts' partitions at run
time, before any file is opened. Only the calendar is broadcast, a row for each day.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables
from .star import dim_calendar


def _semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.distinct(), key, "left_semi")


def filter_context(t: Tables, customers: Column | None = None, orders: Column | None = None,
                   products: Column | None = None, sellers: Column | None = None,
                   dates: Column | None = None, both_directions: bool = False) -> Tables:
    """Restrict the model to the rows visible under the given predicates."""
    c, o, items = t.customers, t.orders, t.order_items
    p, s = t.products, t.sellers
    if customers is not None:
        c = c.where(customers)
        o = _semi(o, c.select("customer_id"), "customer_id")
    if orders is not None:
        o = o.where(orders)
    if dates is not None:
        days = dim_calendar(t).where(dates).select(F.col("date").alias("_day"))
        o = o.join(F.broadcast(days), F.to_date("order_purchase_timestamp") == F.col("_day"), "left_semi")
    if products is not None:
        p = p.where(products)
        items = _semi(items, p.select("product_id"), "product_id")
    if sellers is not None:
        s = s.where(sellers)
        items = _semi(items, s.select("seller_id"), "seller_id")
    if both_directions and (products is not None or sellers is not None):
        o = _semi(o, items.select("order_id"), "order_id")
    if all(x is None for x in (customers, orders, products, sellers, dates)):
        return t
    if customers is None and orders is None and dates is None and not both_directions:
        return replace(t, products=p, sellers=s, order_items=items)
    keys = o.select("order_id")
    return replace(t, customers=c, orders=o, products=p, sellers=s,
                   order_items=_semi(items, keys, "order_id"),
                   order_payments=_semi(t.order_payments, keys, "order_id"),
                   order_reviews=_semi(t.order_reviews, keys, "order_id"))


FACT_DIMENSIONS = {
    "fact_order_items": {"customers": "customer_id", "products": "product_id", "sellers": "seller_id"},
    "fact_order_payments": {"customers": "customer_id"},
    "fact_order_reviews": {"customers": "customer_id"},
}
_DIMENSION = {"customers": "dim_customer", "products": "dim_product", "sellers": "dim_seller"}


def sliced_mart(mart: dict[str, DataFrame], dates: Column | None = None, customers: Column | None = None,
                products: Column | None = None, sellers: Column | None = None) -> dict[str, DataFrame]:
    """The published tables (``sources.mart.open_mart``) under slicers on their dimensions.

    A date slicer reaches a fact twice: the selected months as a semi join on its partition
    columns, which Spark turns into a dynamic partition filter of the scan, and the days
    as a semi join on the rows left. Facts without a purchase date fall out."""
    out = dict(mart)
    predicates = {"customers": customers, "products": products, "sellers": sellers}
    for name, predicate in predicates.items():
        if predicate is not None:
            out[_DIMENSION[name]] = mart[_DIMENSION[name]].where(predicate)
    if dates is not None:
        out["dim_calendar"] = mart["dim_calendar"].where(dates)
    for fact, keys in FACT_DIMENSIONS.items():
        df = mart[fact]
        if dates is not None:
            days = out["dim_calendar"]
            months = days.select(F.col("year").alias("_y"), F.col("month").alias("_m")).distinct()
            df = df.join(F.broadcast(months), (df["purchase_year"] == months["_y"]) & (df["purchase_month"] == months["_m"]), "left_semi")
            df = df.join(F.broadcast(days.select(F.col("date").alias("_day"))), F.to_date("purchase_date") == F.col("_day"), "left_semi")
        for name, key in keys.items():
            if predicates[name] is not None:
                df = _semi(df, out[_DIMENSION[name]].select(key), key)
        out[fact] = df
    return out
