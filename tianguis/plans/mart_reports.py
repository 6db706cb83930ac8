"""Reports over the published mart: versions, co-located facts, calendar slicer.

``mart_root`` publishes the mart of a driver folder once per session, in two steps as in
daily use: first everything, with one month's items not yet delivered, then that month
again, whole. All reports read the newest version through the catalog.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..operators.distinct import bitmaps, dense_ids, rolled_up
from ..operators.joins import key_side
from ..session import shared_dir
from ..sources import mart
from ..sources.adapter import load_tables
from .context import sliced_mart

# The month of the registered refresh and the slicer's selection (second quarters, weekends).
LATE_MONTH = (1995, 3)
BUCKETS = 2
SLICER_DAYS = "quarter = 2 AND day_of_week >= 6"

_MARTS: dict[tuple[str, str], str] = {}


def mart_root(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the published mart of ``sf_dir``; written by the first report that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MARTS:
        t = load_tables(spark, sf_dir)
        root = shared_dir(spark, f"mart-{uuid.uuid4().hex}")
        late = t.orders.where(mart.in_months("order_purchase_timestamp", [LATE_MONTH])).select("order_id")
        buckets = mart.fitting_buckets(t, BUCKETS)
        mart.publish(spark, replace(t, order_items=t.order_items.join(key_side(late), "order_id", "left_anti")), root, buckets=buckets)
        mart.publish(spark, t, root, months=[LATE_MONTH], buckets=buckets)
        _MARTS[key] = root
    return _MARTS[key]


def mart_for(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return mart.open_mart(spark, mart_root(spark, sf_dir))


def s8_mart_rows_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and revenue of the item fact by month, after one month was published again; read
    by its name in the catalog, as the dashboard does."""
    root = mart_root(spark, sf_dir)
    mart.register(spark, root)
    f = spark.table(f"{mart.database_of(root)}.fact_order_items")
    return (f.groupBy(F.col("purchase_year").alias("anio"), F.col("purchase_month").alias("mes"))
            .agg(F.count(F.lit(1)).alias("filas"), F.count("order_item_id").alias("items"), F.sum("price").alias("ingreso")))


def satisfaction_by_shipment(m: dict[str, DataFrame]) -> DataFrame:
    """Orders, ticket and mean review score by shipment type. Both facts are bucketed by order:
    their order-grain aggregates and the join of these need no exchange of either."""
    items = m["fact_order_items"].groupBy("order_id").agg(F.count("order_item_id").alias("n_items"), F.sum("price").alias("sp"))
    reviews = m["fact_order_reviews"].groupBy("order_id", "tipo_logistica").agg(
        F.sum("review_score").alias("ss"), F.count("review_score").alias("sn"))
    j = items.join(reviews, "order_id")
    return j.groupBy("tipo_logistica").agg(
        F.count(F.lit(1)).alias("ordenes"), F.sum("n_items").alias("items"), F.sum("sp").alias("ingreso"),
        ratio("sum(sp)", "count(sp)", 2, num_scale=2).alias("ticket_promedio"),
        ratio("sum(ss)", "sum(sn)", 2).alias("score_promedio"))


def s8_mart_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return satisfaction_by_shipment(mart_for(spark, sf_dir))


def revenue_by_state(m: dict[str, DataFrame]) -> DataFrame:
    """Items and revenue by buyer state, summed by customer before the customers are joined."""
    per = m["fact_order_items"].where("order_item_id is not null").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("sp"))
    return (per.join(m["dim_customer"].select("customer_id", "customer_state"), "customer_id")
            .groupBy("customer_state").agg(F.sum("n").alias("items"), F.sum("sp").alias("ingreso")))


def p15_calendar_slicer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by state on weekends of second quarters: only the selected months' folders are read."""
    return revenue_by_state(sliced_mart(mart_for(spark, sf_dir), dates=F.expr(SLICER_DAYS)))


def monthly_bitmaps(spark: SparkSession, m: dict[str, DataFrame], root: str) -> DataFrame:
    """Bitmaps of customers (persons) and orders by purchase month, written under ``root`` with
    their dictionaries; reads them back."""
    people = m["dim_customer"].select("customer_id", "customer_unique_id")
    orders = m["fact_order_items"].select("order_id", "customer_id", "purchase_year", "purchase_month")
    ids = {}
    for name, df, key in (("clientes", people, "customer_unique_id"), ("pedidos", orders, "order_id")):
        path = f"{root}/{name}"
        dense_ids(df, key).write.parquet(path)
        ids[name] = spark.read.parquet(path).select(F.col("key").alias(key), F.col("id").alias(name))
    rows = (orders.distinct().join(people, "customer_id", "left").join(ids["clientes"], "customer_unique_id", "left")
            .join(ids["pedidos"], "order_id", "left"))
    path = f"{root}/months"
    bitmaps(rows, ["purchase_year", "purchase_month"], {"clientes": "clientes", "pedidos": "pedidos"}).write.partitionBy("purchase_year").parquet(path)
    return spark.read.parquet(path)


def a3_distinct_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers and orders of every month, quarter and year, all from the monthly bitmaps."""
    stored = monthly_bitmaps(spark, mart_for(spark, sf_dir), shared_dir(spark, f"bitmaps-{uuid.uuid4().hex}"))
    month = {"anio": "purchase_year", "trimestre": "CAST(ceil(purchase_month / 3) AS INT)", "mes": "purchase_month"}
    out = None
    for level, names in (("mes", ["anio", "trimestre", "mes"]), ("trimestre", ["anio", "trimestre"]), ("anio", ["anio"])):
        n = rolled_up(stored, {a: month[a] for a in names}).groupBy(*names).pivot("what", ["clientes", "pedidos"]).agg(F.first("n"))
        row = n.select(F.lit(level).alias("nivel"), *[F.col(a) if a in names else F.lit(None).cast("int").alias(a) for a in month],
                       F.coalesce("clientes", F.lit(0)).alias("clientes"), F.coalesce("pedidos", F.lit(0)).alias("pedidos"))
        out = row if out is None else out.unionByName(row)
    return out


MART_REPORTS = {
    "a3_distinct_by_period": a3_distinct_by_period,
    "s8_mart_rows_by_month": s8_mart_rows_by_month,
    "s8_mart_satisfaction": s8_mart_satisfaction,
    "p15_calendar_slicer": p15_calendar_slicer,
}
