"""Semantic-layer measures M1-M15 as DataFrame functions.

A measure is "an aggregate evaluated in a filter context": every function takes
the tables plus optional ``by`` keys (the report's axes: column names or
expressions over the orders) and returns one row per group - a global value
when ``by`` is empty. Filters (slicers) are applied to the inputs with
``plans.context.filter_context``, so Catalyst pushes them to the scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (CREDIT_CARD, DELIVERED, NEGATIVE_SCORE_MAX, dec, ratio,
                               share_pct)
from ..sources.tables import Tables, shared_plan
from .algebra import evaluate, previous_month, timeline, year_to_date
from .common import order_logistics, review_stats_by_order
from .findings import order_mean_score
from .star import dim_calendar


Slicer = Sequence["str | Column"] | None


def _measure(df: DataFrame, t: Tables, by: Slicer, *aggs: Column,
             orders_only: bool = True) -> DataFrame:
    """Aggregate ``df`` (which has ``order_id``) in the filter context ``by``.

    ``by`` holds column names or expressions over the orders table, e.g.
    ``["order_status"]`` or ``[F.year("order_purchase_timestamp").alias("anio")]``.
    The keys are evaluated on the orders and joined on ``order_id`` under
    private names (so they never collide with the measure's own columns); with
    ``orders_only`` the join also restricts ``df`` to existing orders even when
    there are no keys.
    """
    by = list(by or [])
    if not by and not orders_only:
        return df.agg(*aggs)
    keys = t.orders.select("order_id", *by)
    names = keys.columns[1:]
    private = [f"__by{i}" for i in range(len(names))]
    joined = df.join(keys.toDF("order_id", *private), "order_id")
    g = joined.groupBy(*private).agg(*aggs)
    return g.withColumnsRenamed(dict(zip(private, names))) if names else g


def m01_score_per_order(t: Tables, by: Slicer = None) -> DataFrame:
    """Mean over orders of each order's mean score (orders without a score ignored)."""
    return _measure(order_mean_score(t), t, by,
                    ratio("sum(avg_review_score)", "count(avg_review_score)", 2, num_scale=6)
                    .alias("score_promedio_por_orden"))


def m02_late_rate(t: Tables, by: Slicer = None) -> DataFrame:
    """100 x distinct late orders / distinct orders with a delivery, 0 when none."""
    g = _measure(order_logistics(t), t, by,
                 F.expr("count(DISTINCT CASE WHEN late THEN order_id END) AS pedidos_con_retraso"),
                 F.expr("count(DISTINCT CASE WHEN delivery_days IS NOT NULL THEN order_id END) "
                        "AS pedidos_entregados"),
                 orders_only=False)
    return g.withColumn("tasa_retraso", F.coalesce(
        share_pct("pedidos_con_retraso", "pedidos_entregados"), F.lit(0).cast(dec(38, 2))))


def m03_mean_installments(t: Tables, by: Slicer = None) -> DataFrame:
    """Credit card only: per order the value-weighted installments (0 when the
    order's value is 0), then the plain mean over orders."""
    p = t.order_payments.where(F.col("payment_type") == CREDIT_CARD)
    per = p.groupBy("order_id").agg(
        F.sum(F.col("payment_installments") * F.col("payment_value")).alias("_w"),
        F.sum("payment_value").alias("_v"))
    per = per.select("order_id", F.coalesce(ratio("_w", "_v", 6, num_scale=2, den_scale=2),
                                            F.lit(0).cast(dec(38, 6))).alias("cuotas_orden"))
    return _measure(per, t, by, ratio("sum(cuotas_orden)", "count(cuotas_orden)", 2, num_scale=6)
                    .alias("cuotas_promedio"))


@shared_plan
def monthly_revenue_calendar(t: Tables) -> DataFrame:
    """Item revenue (price) per calendar month over the gap-free calendar;
    months without sales carry a NULL revenue."""
    months = dim_calendar(t).select(F.col("year").alias("anio"),
                                    F.col("month").alias("mes")).distinct()
    rev = (t.order_items.groupBy("order_id").agg(F.sum("price").alias("sp"))
           .join(t.orders.select("order_id", "order_purchase_timestamp"), "order_id")
           .groupBy(F.year("order_purchase_timestamp").alias("anio"),
                    F.month("order_purchase_timestamp").alias("mes"))
           .agg(F.sum("sp").alias("ingreso")))
    return months.join(rev, ["anio", "mes"], "left")


def m04_mom_growth(t: Tables, by: Sequence[str] | None = None) -> DataFrame:
    """(current - previous calendar month) / previous, 0 when the previous month
    is blank or zero; a blank current month counts as 0. ``by`` names axes of the
    algebra (e.g. ``["estado"]``): each of their values has its own gap-free months."""
    by = list(by or [])
    m = _revenue_months(t, by)
    m = previous_month(m, "ingreso", by, "ingreso_mes_anterior")
    cur0 = F.coalesce(F.col("ingreso"), F.lit(0))
    growth = ratio(cur0 - F.col("ingreso_mes_anterior"), "ingreso_mes_anterior", 4,
                   num_scale=2, den_scale=2)
    return m.select(*by, "anio", "mes", "ingreso", "ingreso_mes_anterior",
                    F.coalesce(growth, F.lit(0).cast(dec(38, 4))).alias("crecimiento_mom"))


def m05_revenue_ytd(t: Tables, by: Sequence[str] | None = None) -> DataFrame:
    """Calendar-year running revenue; months without sales carry the total forward.
    ``by`` as in ``m04_mom_growth``."""
    by = list(by or [])
    return year_to_date(_revenue_months(t, by), "ingreso", by, "ingreso_acumulado_ytd")


def _revenue_months(t: Tables, by: list[str]) -> DataFrame:
    if not by:
        return monthly_revenue_calendar(t)
    return timeline(t, "total_ingresos", by).withColumnRenamed("total_ingresos", "ingreso")


def m06_total_revenue(t: Tables, by: Slicer = None) -> DataFrame:
    """Sum of item price (no freight) over items of existing orders."""
    per = t.order_items.groupBy("order_id").agg(F.sum("price").alias("sp"))
    return _measure(per, t, by, F.expr("sum(sp) AS total_ingresos"))


def m07_total_orders(t: Tables, by: Slicer = None) -> DataFrame:
    return _measure(t.orders.select("order_id"), t, by,
                    F.expr("count(DISTINCT order_id) AS total_pedidos"), orders_only=False)


def m08_average_ticket(t: Tables, by: Slicer = None) -> DataFrame:
    """Sum of price / orders having at least one item."""
    per = t.order_items.groupBy("order_id").agg(F.sum("price").alias("sp"))
    g = _measure(per, t, by, F.expr("sum(sp) AS total_ingresos"),
                 F.expr("count(DISTINCT order_id) AS pedidos_con_items"))
    return g.withColumn("ticket_promedio",
                        ratio("total_ingresos", "pedidos_con_items", 2, num_scale=2))


def m09_dissatisfaction_rate(t: Tables, by: Slicer = None) -> DataFrame:
    """Share (%) of reviewed orders whose mean score is at most 2."""
    s = review_stats_by_order(t).where("n_scored > 0")
    g = _measure(s, t, by,
                 F.expr(f"count_if(sum_score <= n_scored * {NEGATIVE_SCORE_MAX}) "
                        "AS ordenes_insatisfechas"),
                 F.expr("count(1) AS ordenes_con_review"))
    return g.withColumn("tasa_insatisfaccion",
                        share_pct("ordenes_insatisfechas", "ordenes_con_review"))


def m10_delivery_rate(t: Tables, by: Slicer = None) -> DataFrame:
    """Share (%) of orders with status delivered."""
    g = _measure(t.orders.select("order_id", "order_status"), t, by,
                 F.expr(f"count_if(order_status = '{DELIVERED}') AS pedidos_entregados"),
                 F.expr("count(1) AS total_pedidos"), orders_only=False)
    return g.withColumn("tasa_entrega", share_pct("pedidos_entregados", "total_pedidos"))


def m11_logistics_days(t: Tables, by: Slicer = None) -> DataFrame:
    """Order-grain means of the transit-day columns; delay over late orders only."""
    o = order_logistics(t)

    def avg(c, cond=None):
        x = c if cond is None else f"CASE WHEN {cond} THEN {c} END"
        return ratio(f"sum({x})", f"count({x})", 2)

    return _measure(o, t, by,
                    avg("seller_to_courier_delivery_days").alias("dias_vendedor_courier"),
                    avg("courier_to_customer_delivery_days").alias("dias_courier_cliente"),
                    avg("delivery_days").alias("dias_entrega"),
                    avg("delay_days", "late").alias("dias_retraso"), orders_only=False)


def m12_payments(t: Tables, by: Slicer = None) -> DataFrame:
    """Total paid and mean paid per paying order."""
    per = t.order_payments.groupBy("order_id").agg(F.sum("payment_value").alias("pv"))
    g = _measure(per, t, by, F.expr("sum(pv) AS total_pagado"),
                 F.expr("count(1) AS ordenes_pagadas"))
    return g.withColumn("pago_promedio", ratio("total_pagado", "ordenes_pagadas", 2, num_scale=2))


def m13_courier_share_late(t: Tables, by: Slicer = None) -> DataFrame:
    """Courier share (%) of the late orders' transit time, from the H3 averages
    (delivered orders); ``by`` as in every measure."""
    o = order_logistics(t).where((F.col("order_status") == DELIVERED) & F.col("late"))

    def avg(c):
        return ratio(f"sum({c})", f"count({c})", 2)

    g = _measure(o.select("order_id", "seller_to_courier_delivery_days", "courier_to_customer_delivery_days"), t, by,
                 avg("seller_to_courier_delivery_days").alias("dias_vendedor_courier"),
                 avg("courier_to_customer_delivery_days").alias("dias_courier_cliente"),
                 F.count(F.lit(1)).alias("_n"), orders_only=False).where("_n > 0").drop("_n")
    s, c = F.col("dias_vendedor_courier"), F.col("dias_courier_cliente")
    return g.withColumns({"dias_totales": s + c,
                          "participacion_courier": share_pct(c, s + c, 2, num_scale=2, den_scale=2)})


def m14_group_gaps(t: Tables, by: Slicer = None) -> DataFrame:
    """Score gap of each finding group against its base group (H1 and H2). With ``by`` every
    axis value has its own groups and bases; groups without orders are not listed there."""
    from .findings import h1_score_by_lateness, h2_score_by_shipment_type
    from ..functions.exprs import ON_TIME_DELIVERY, SINGLE_SELLER

    by = list(by or [])
    h1, h2 = (h1_score_by_lateness(t), h2_score_by_shipment_type(t)) if not by else _group_scores(t, by)
    names = [c for c in h1.columns if c not in ("tipo_entrega", "score_promedio")]
    h1 = h1.select(
        *names, F.lit("H1").alias("hallazgo"), F.col("tipo_entrega").alias("grupo"), "score_promedio",
        (F.col("tipo_entrega") == ON_TIME_DELIVERY).alias("_base"))
    h2 = h2.select(
        *names, F.lit("H2").alias("hallazgo"), F.col("tipo_logistica").alias("grupo"), "score_promedio",
        (F.col("tipo_logistica") == SINGLE_SELLER).alias("_base"))
    u = h1.unionByName(h2)
    base = F.max(F.when(F.col("_base"), F.col("score_promedio"))).over(
        Window.partitionBy(*names, "hallazgo"))
    return u.select(*names, "hallazgo", "grupo", "score_promedio", base.alias("score_base"),
                    (F.col("score_promedio") - base).alias("diferencia"))


def _group_scores(t: Tables, by: list) -> tuple[DataFrame, DataFrame]:
    """H1 (order means) and H2 (review rows) by axes, both from order-grain rows."""
    from ..functions.exprs import LATE_DELIVERY, ON_TIME_DELIVERY, SINGLE_SELLER, SPLIT_SHIPMENT

    keys = t.orders.select("order_id", *by)
    sellers = t.order_items.groupBy("order_id").agg(F.min("seller_id").alias("_lo"), F.max("seller_id").alias("_hi"))
    rows = (keys.join(order_logistics(t).select("order_id", "late"), "order_id")
            .join(review_stats_by_order(t).select("order_id", "sum_score", "n_scored"), "order_id", "left")
            .join(sellers, "order_id", "left").withColumn("_mean", ratio("sum_score", "n_scored", 6)))
    names = keys.columns[1:]
    h1 = rows.groupBy(*names, F.when(F.col("late"), LATE_DELIVERY).otherwise(ON_TIME_DELIVERY).alias("tipo_entrega")).agg(
        ratio("sum(_mean)", "count(_mean)", 2, num_scale=6).alias("score_promedio"))
    h2 = rows.where("_lo IS NOT NULL").groupBy(
        *names, F.when(F.col("_lo") == F.col("_hi"), SINGLE_SELLER).otherwise(SPLIT_SHIPMENT).alias("tipo_logistica")).agg(
        ratio("sum(sum_score)", "sum(n_scored)", 2).alias("score_promedio"))
    return h1, h2


def m14_group_gaps_by_year(t: Tables) -> DataFrame:
    return m14_group_gaps(t, [F.year("order_purchase_timestamp").alias("anio")])


def m15_commission(t: Tables, rate: Decimal = Decimal("0.10"), by: Slicer = None) -> DataFrame:
    """What-if: platform commission = total item revenue x rate."""
    r = F.lit(rate).cast(dec(5, 4))
    return m06_total_revenue(t, by).withColumns(
        {"tasa_comision": r, "comision": F.col("total_ingresos") * r})


# The registered instance of the algebra.
OVERVIEW = ["total_ingresos", "total_pedidos", "ticket_promedio", "score_promedio", "tasa_insatisfaccion", "tasa_entrega"]
OVERVIEW_SETS = [["estado", "anio", "mes"], ["estado"], ["anio", "mes"], []]


def m_overview_by_state_and_month(t: Tables) -> DataFrame:
    """Six measures by state and month, by state, by month and in total, from one scan of each table."""
    return evaluate(t, OVERVIEW, ["estado", "anio", "mes"], OVERVIEW_SETS)


def m_logistics_and_payments_by_status(t: Tables) -> DataFrame:
    """Logistics and payment measures by order status and quarter."""
    return evaluate(t, ["tasa_retraso", "dias_entrega", "dias_retraso", "total_pagado", "pago_promedio", "cuotas_promedio"],
                    ["estado_de_orden", "anio", "trimestre"], [["estado_de_orden", "anio", "trimestre"], ["anio"]])


def m04_mom_growth_by_state(t: Tables) -> DataFrame:
    return m04_mom_growth(t, ["estado"])


def m05_revenue_ytd_by_state(t: Tables) -> DataFrame:
    return m05_revenue_ytd(t, ["estado"])


def m13_courier_share_by_year(t: Tables) -> DataFrame:
    return m13_courier_share_late(t, [F.year("order_purchase_timestamp").alias("anio")])


MEASURES = {
    "m01_score_per_order": m01_score_per_order,
    "m02_late_rate": m02_late_rate,
    "m03_mean_installments": m03_mean_installments,
    "m04_mom_growth": m04_mom_growth,
    "m05_revenue_ytd": m05_revenue_ytd,
    "m06_total_revenue": m06_total_revenue,
    "m07_total_orders": m07_total_orders,
    "m08_average_ticket": m08_average_ticket,
    "m09_dissatisfaction_rate": m09_dissatisfaction_rate,
    "m10_delivery_rate": m10_delivery_rate,
    "m11_logistics_days": m11_logistics_days,
    "m12_payments": m12_payments,
    "m13_courier_share_late": m13_courier_share_late,
    "m14_group_gaps": m14_group_gaps,
    "m15_commission": m15_commission,
    "m_overview_by_state_and_month": m_overview_by_state_and_month,
    "m_logistics_and_payments_by_status": m_logistics_and_payments_by_status,
    "m04_mom_growth_by_state": m04_mom_growth_by_state,
    "m05_revenue_ytd_by_state": m05_revenue_ytd_by_state,
    "m13_courier_share_by_year": m13_courier_share_by_year,
    "m14_group_gaps_by_year": m14_group_gaps_by_year,
}
