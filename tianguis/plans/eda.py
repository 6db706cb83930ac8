"""Exploratory questions Q1-Q13 (output columns keep the report's names).

Plans are expressed so that the large relations are reduced before they are
joined: items, payments and reviews are aggregated to order (or product) grain
first, and windows only ever run on already-aggregated monthly or category rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (TREND_DOWN, TREND_FLAT, TREND_UP, dec,
                               ratio, share_pct)
from ..sources.tables import Tables
from .common import item_totals_by_order, purchase_month, review_stats_by_order



def _all():
    """Window over all rows - only ever applied to already-aggregated rows."""
    return Window.partitionBy()


def q01_orders_by_status(t: Tables) -> DataFrame:
    g = (t.orders.groupBy(F.col("order_status").alias("estado_de_orden"))
         .agg(F.count(F.lit(1)).alias("cantidad")))
    return (g.select("estado_de_orden", "cantidad",
                     share_pct("cantidad", F.sum("cantidad").over(_all())).alias("porcentaje"))
            .orderBy(F.desc("cantidad")))


def q02_time_range(t: Tables) -> DataFrame:
    ts = "order_purchase_timestamp"
    return (t.orders.agg(F.min(ts).alias("primera_compra"), F.max(ts).alias("ultima_compra"))
            .withColumn("dias_totales", F.datediff("ultima_compra", "primera_compra")))


def q03_orders_per_month(t: Tables) -> DataFrame:
    return (t.orders.groupBy(*purchase_month()).agg(F.count(F.lit(1)).alias("total_pedidos"))
            .orderBy("anio", "mes"))


def q04_price_freight_stats(t: Tables) -> DataFrame:
    i = t.order_items
    return i.agg(
        F.min("price").alias("precio_minimo"),
        F.max("price").alias("precio_maximo"),
        ratio("sum(price)", "count(price)", 2, num_scale=2).alias("precio_promedio"),
        F.min("freight_value").alias("flete_minimo"),
        F.max("freight_value").alias("flete_maximo"),
        ratio("sum(freight_value)", "count(freight_value)", 2, num_scale=2)
        .alias("flete_promedio"))


def q05_payment_methods(t: Tables) -> DataFrame:
    """Grain is (order, payment type): vouchers of one order count once."""
    per = (t.order_payments.groupBy("order_id", "payment_type")
           .agg(F.sum("payment_value").alias("monto"),
                F.max("payment_installments").alias("cuotas")))
    g = per.groupBy("payment_type").agg(
        F.count("order_id").alias("total_ordenes_por_metodo"),
        F.sum("monto").alias("monto_total_por_metodo"),
        F.count("monto").alias("_n_monto"),
        F.sum("cuotas").alias("_sum_cuotas"),
        F.count("cuotas").alias("_n_cuotas"))
    return (g.select(
        "payment_type", "total_ordenes_por_metodo",
        share_pct("total_ordenes_por_metodo", F.sum("total_ordenes_por_metodo").over(_all()))
        .alias("porcentaje"),
        "monto_total_por_metodo",
        ratio("monto_total_por_metodo", "_n_monto", 2, num_scale=2)
        .alias("ticket_promedio_por_metodo"),
        ratio("_sum_cuotas", "_n_cuotas", 2).alias("cuotas_promedio_por_metodo"))
        .orderBy(F.desc("monto_total_por_metodo")))


def q06_score_distribution(t: Tables) -> DataFrame:
    """Per-order mean score rounded half-up to an integer, then counted."""
    per = review_stats_by_order(t).select(
        ratio("sum_score", "n_scored", 0).cast("int").alias("puntuacion"))
    g = per.groupBy("puntuacion").agg(F.count(F.lit(1)).alias("total_ordenes"))
    return (g.select("puntuacion", "total_ordenes",
                     share_pct("total_ordenes", F.sum("total_ordenes").over(_all()))
                     .alias("porcentaje"))
            .orderBy(F.desc("puntuacion")))


def q07_top_categories_by_revenue(t: Tables, n: int = 15) -> DataFrame:
    """Top categories by item revenue; the percentage is of all categories."""
    per_product = (t.order_items.groupBy("product_id")
                   .agg(F.sum("price").alias("sp"), F.count("price").alias("cp")))
    j = (per_product.join(t.products.select("product_id", "product_category_name"),
                          "product_id", "left")
         .join(t.category_translation, "product_category_name", "left"))
    g = j.groupBy(F.col("product_category_name_english").alias("categoria_en"),
                  F.col("product_category_name").alias("categoria_pt")).agg(
        F.sum("sp").alias("revenue_total"), F.sum("cp").alias("_n"))
    out = g.select(
        "categoria_pt", "categoria_en", "revenue_total",
        share_pct("revenue_total", F.sum("revenue_total").over(_all()), num_scale=2, den_scale=2)
        .alias("porcentaje"),
        ratio("revenue_total", "_n", 2, num_scale=2).alias("precio_medio_por_categoria"))
    return out.orderBy(F.desc_nulls_last("revenue_total"), F.asc_nulls_first("categoria_pt"),
                       F.asc_nulls_first("categoria_en")).limit(n)


def q08_monthly_delivered_revenue(t: Tables) -> DataFrame:
    """``pedidos`` counts items. An order qualifies when delivered, or when both
    delivery dates are present whatever its status."""
    o = t.orders.where((F.col("order_status") == "delivered")
                       | (F.col("order_delivered_carrier_date").isNotNull()
                          & F.col("order_delivered_customer_date").isNotNull()))
    j = item_totals_by_order(t).join(o.select("order_id", "order_purchase_timestamp"), "order_id")
    return (j.groupBy(*purchase_month()).agg(
        F.sum("n_items").alias("pedidos"),
        F.sum("sum_price").alias("total_ingresos"),
        F.sum("sum_freight").alias("total_flete"))
        .orderBy("anio", "mes"))


def q09_dissatisfied_categories(t: Tables, min_reviews: int = 50) -> DataFrame:
    """Review x item fan-out per category, computed without materialising it.

    A review counts once per item of its order. Items meet the review stats of
    their order (one row each), are summed per product, then per Portuguese category, then FULL OUTER joined to the translation; products without a
    category or translation fall into one NULL group, and translation rows no
    product uses form one-row groups that the HAVING clause cuts.
    """
    r = review_stats_by_order(t).join(t.orders.select("order_id").distinct(), "order_id", "left_semi")
    by_product = t.order_items.select("order_id", "product_id").join(r, "order_id").groupBy("product_id").agg(
        F.sum("n_reviews").alias("rows"),
        F.sum("n_scored").alias("scored"),
        F.sum("sum_score").alias("score_sum"),
        F.sum("n_negative").alias("neg"))
    by_cat = (by_product.join(t.products.select("product_id", "product_category_name"), "product_id")
              .groupBy("product_category_name").agg(
                  *[F.sum(c).alias(c) for c in ("rows", "scored", "score_sum", "neg")]))
    tr = t.category_translation.select(
        F.col("product_category_name").alias("tr_name"), "product_category_name_english")
    j = by_cat.join(tr, by_cat.product_category_name == tr.tr_name, "full")
    g = j.groupBy("product_category_name_english", "tr_name").agg(
        F.sum(F.coalesce("rows", F.lit(1))).alias("reviews_totales"),
        F.sum("scored").alias("_scored"),
        F.sum("score_sum").alias("_score_sum"),
        F.sum(F.coalesce("neg", F.lit(0))).alias("reviews_negativos"))
    return (g.where(F.col("reviews_totales") >= min_reviews)
            .orderBy(F.try_divide(F.col("_score_sum").cast(dec(38, 0)), F.col("_scored")))
            .select(F.col("product_category_name_english").alias("categoria_en"),
                    ratio("_score_sum", "_scored", 2).alias("avg_review_score"),
                    "reviews_totales", "reviews_negativos",
                    share_pct("reviews_negativos", "reviews_totales")
                    .alias("pct_reviews_negativos")))


def q10_top_states(t: Tables, n: int = 10) -> DataFrame:
    """Orders need a payment (inner join); orders without a customer form a NULL state."""
    pays = t.order_payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    j = (t.orders.select("order_id", "customer_id").join(pays, "order_id")
         .join(t.customers.select("customer_id", "customer_unique_id", "customer_state"),
               "customer_id", "left"))
    g = j.groupBy(F.col("customer_state").alias("estado")).agg(
        F.count_distinct("customer_unique_id").alias("clientes_unicos"),
        F.count_distinct("order_id").alias("ordenes_totales"),
        F.sum("paid").alias("ingreso_total"))
    return g.orderBy(F.desc("clientes_unicos"), F.asc_nulls_first("estado")).limit(n)


def _monthly_item_revenue(t: Tables, delivered_only: bool) -> DataFrame:
    o = t.orders
    if delivered_only:
        o = o.where(F.col("order_status") == "delivered")
    j = item_totals_by_order(t).join(o.select("order_id", "order_purchase_timestamp"), "order_id")
    return j.groupBy(*purchase_month()).agg(
        F.sum("sum_price").alias("total_orden"),
        F.sum("sum_freight").alias("total_flete"),
        F.sum("sum_subtotal").alias("total"))


def q11_ytd_cumulative(t: Tables) -> DataFrame:
    """Delivered revenue per month with running totals that reset each year."""
    m = _monthly_item_revenue(t, delivered_only=True)
    ytd = Window.partitionBy("anio").orderBy("mes").rowsBetween(Window.unboundedPreceding, 0)
    return m.select(
        "anio", "mes",
        "total_orden", F.sum("total_orden").over(ytd).alias("total_orden_acumulado"),
        "total_flete", F.sum("total_flete").over(ytd).alias("total_flete_acumulado"),
        "total", F.sum("total").over(ytd).alias("total_acumulado"))


def q12_priciest_product_per_customer(t: Tables) -> DataFrame:
    """Products ranked 1 by (customer, product) max price within their customer; ties kept.

    A DENSE_RANK window with a filter on it: Spark cuts each task's share of a
    customer to its top rank before the exchange, so a hot customer shrinks
    before it meets in one task.
    """
    per_order = (t.order_items.groupBy("order_id", "product_id")
                 .agg(F.max("price").alias("precio")))
    cp = (per_order.join(t.orders.select("order_id", "customer_id"), "order_id")
          .groupBy("customer_id", "product_id").agg(F.max("precio").alias("precio")))
    rank = F.dense_rank().over(Window.partitionBy("customer_id").orderBy(F.desc("precio")))
    return (cp.withColumn("ranking", rank).where(F.col("ranking") == 1)
            .select(F.col("customer_id").alias("cliente"),
                    F.col("product_id").alias("producto_comprado"),
                    "precio", F.col("ranking").cast("bigint").alias("ranking"))
            .orderBy(F.desc("precio")))


def q13_mom_growth(t: Tables) -> DataFrame:
    """Month-over-month change of price+freight revenue between adjacent rows."""
    m = _monthly_item_revenue(t, delivered_only=False).select(
        "anio", "mes", F.col("total").alias("ingreso"))
    prev = F.lag("ingreso").over(Window.orderBy("anio", "mes"))
    m = m.withColumn("_prev", prev)
    diff = F.col("ingreso") - F.col("_prev")
    return (m.select(
        "anio", "mes", "ingreso",
        ratio(diff, "_prev", 2, num_scale=2, den_scale=2, factor=100).alias("variacion_porcentual"),
        F.when(diff > 0, F.lit(TREND_UP)).when(diff == 0, F.lit(TREND_FLAT))
        .when(diff < 0, F.lit(TREND_DOWN)).alias("tendencia"))
        .orderBy("anio", "mes"))


EDA = {
    "q01_orders_by_status": q01_orders_by_status,
    "q02_time_range": q02_time_range,
    "q03_orders_per_month": q03_orders_per_month,
    "q04_price_freight_stats": q04_price_freight_stats,
    "q05_payment_methods": q05_payment_methods,
    "q06_score_distribution": q06_score_distribution,
    "q07_top_categories_by_revenue": q07_top_categories_by_revenue,
    "q08_monthly_delivered_revenue": q08_monthly_delivered_revenue,
    "q09_dissatisfied_categories": q09_dissatisfied_categories,
    "q10_top_states": q10_top_states,
    "q11_ytd_cumulative": q11_ytd_cumulative,
    "q12_priciest_product_per_customer": q12_priciest_product_per_customer,
    "q13_mom_growth": q13_mom_growth,
}
