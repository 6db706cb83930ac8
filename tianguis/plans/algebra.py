"""Measures as an algebra: sums of additive order-grain components, rolled up over any axes.

A component is an expression over one order's row whose sum has a meaning at any grain
(revenue, number of late orders, sum of transit days). A measure is an expression over
summed components. ``evaluate`` takes any set of measures and axes:

1. the tables the components need are collapsed to order grain and joined on ``order_id``,
   each scanned once, whatever the number of measures;
2. one aggregate sums the components by all axes (map-side first, so a hot value of an axis
   is a row per task);
3. grouping sets roll that small result up; since components add up, no raw row is read again.

Axes are expressions over the order row (its columns and its customer's) by name. Orders
are unique by ``order_id`` (the key report checks it).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import CREDIT_CARD, DELIVERED, NEGATIVE_SCORE_MAX, ratio, share_pct
from ..sources.tables import Tables
from .common import item_totals_by_order, order_logistics, review_stats_by_order


@dataclass(frozen=True)
class Component:
    sql: str             # over the order row; null adds nothing
    source: str = "orders"
    orphans: bool = False  # child rows whose order is missing count too


@dataclass(frozen=True)
class Measure:
    uses: tuple[str, ...]
    value: object        # Column or SQL text over the summed components


def _when(condition: str, value: str = "1") -> str:
    return f"CASE WHEN {condition} THEN {value} END"


_MEAN = "CAST(try_divide(CAST(sum_score AS DECIMAL(24,0)), CAST(n_scored AS DECIMAL(20,0))) AS DECIMAL(38,6))"
_CUOTAS = ("coalesce(CAST(try_divide(CAST(cc_w AS DECIMAL(24,2)), CAST(cc_v AS DECIMAL(20,2))) AS DECIMAL(38,6)), "
           "CAST(0 AS DECIMAL(38,6)))")
_LOW = f"n_scored > 0 AND sum_score <= n_scored * {NEGATIVE_SCORE_MAX}"

COMPONENTS: dict[str, Component] = {
    "c_orders": Component("1"),
    "c_delivered": Component(_when(f"order_status = '{DELIVERED}'")),
    "c_late": Component(_when("late")),
    "c_dated": Component(_when("delivery_days IS NOT NULL")),
    "c_days": Component("delivery_days"),
    "c_seller_days": Component("seller_to_courier_delivery_days"),
    "c_seller_n": Component(_when("seller_to_courier_delivery_days IS NOT NULL")),
    "c_courier_days": Component("courier_to_customer_delivery_days"),
    "c_courier_n": Component(_when("courier_to_customer_delivery_days IS NOT NULL")),
    "c_delay_days": Component(_when("late", "delay_days")),
    "c_delay_n": Component(_when("late AND delay_days IS NOT NULL")),
    "c_revenue": Component("sum_price", "items"),
    "c_with_items": Component(_when("n_items IS NOT NULL"), "items"),
    "c_score": Component(_MEAN, "reviews"),
    "c_score_n": Component(_when("n_scored > 0"), "reviews"),
    "c_low": Component(_when(_LOW), "reviews"),
    "c_paid": Component(_when("is_order", "pv"), "payments"),
    "c_paying": Component(_when("is_order AND pay_rows IS NOT NULL"), "payments"),
    "c_cuotas": Component(_when("is_order AND cc_rows > 0", _CUOTAS), "payments"),
    "c_cuotas_n": Component(_when("is_order AND cc_rows > 0"), "payments"),
    "c_card_rows": Component("cc_rows", "payments", orphans=True),
    "c_pay_rows": Component("pay_rows", "payments", orphans=True),
}


def _rate(part: str, whole: str) -> Measure:
    return Measure((part, whole), share_pct(part, whole))


def _mean(total: str, n: str, scale: int = 0) -> Measure:
    return Measure((total, n), ratio(total, n, 2, num_scale=scale))


def measures() -> dict[str, Measure]:
    """The declared measures, by their published names."""
    return {
        "total_ingresos": Measure(("c_revenue",), "c_revenue"),
        "total_pedidos": Measure(("c_orders",), "coalesce(c_orders, 0)"),
        "ticket_promedio": _mean("c_revenue", "c_with_items", 2),
        "score_promedio": _mean("c_score", "c_score_n", 6),
        "tasa_insatisfaccion": Measure(("c_low", "c_score_n"), share_pct("coalesce(c_low, 0)", "c_score_n")),
        "tasa_entrega": Measure(("c_delivered", "c_orders"), share_pct("coalesce(c_delivered, 0)", "c_orders")),
        "tasa_retraso": Measure(("c_late", "c_dated"), "coalesce(CAST(try_divide(CAST(coalesce(c_late, 0) * 100 AS DECIMAL(24,0)), "
                                "CAST(c_dated AS DECIMAL(20,0))) AS DECIMAL(38,2)), CAST(0 AS DECIMAL(38,2)))"),
        "dias_vendedor_courier": _mean("c_seller_days", "c_seller_n"),
        "dias_courier_cliente": _mean("c_courier_days", "c_courier_n"),
        "dias_entrega": _mean("c_days", "c_dated"),
        "dias_retraso": _mean("c_delay_days", "c_delay_n"),
        "total_pagado": Measure(("c_paid",), "c_paid"),
        "cuotas_promedio": _mean("c_cuotas", "c_cuotas_n", 6),
        "pago_promedio": _mean("c_paid", "c_paying", 2),
        "participacion_tarjeta": Measure(("c_card_rows", "c_pay_rows"), share_pct("coalesce(c_card_rows, 0)", "c_pay_rows")),
    }


AXES = {
    "anio": "year(order_purchase_timestamp)",
    "trimestre": "quarter(order_purchase_timestamp)",
    "mes": "month(order_purchase_timestamp)",
    "estado": "customer_state",
    "estado_de_orden": "order_status",
}
_CUSTOMER_COLUMNS = ("customer_state", "customer_city", "customer_zip_code_prefix", "customer_unique_id")


def _payments_by_order(t: Tables) -> DataFrame:
    card = F.col("payment_type") == CREDIT_CARD
    return t.order_payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("pv"), F.count(F.lit(1)).alias("pay_rows"), F.count_if(card).alias("cc_rows"),
        F.sum(F.when(card, F.col("payment_installments") * F.col("payment_value"))).alias("cc_w"),
        F.sum(F.when(card, F.col("payment_value"))).alias("cc_v"))


_CHILDREN = {"items": item_totals_by_order, "reviews": review_stats_by_order, "payments": _payments_by_order}


def order_rows(t: Tables, uses: Sequence[str], axes: Mapping[str, str]) -> DataFrame:
    """One row per order with what the components and axes read; rows of orphaned children
    (no order) where a component counts them."""
    needed = {COMPONENTS[c].source for c in uses}
    orphans = {COMPONENTS[c].source for c in uses if COMPONENTS[c].orphans}
    df = order_logistics(t).withColumn("is_order", F.lit(True))
    for source, build in _CHILDREN.items():
        if source in needed:
            df = df.join(build(t), "order_id", "full" if source in orphans else "left")
    if any(c in sql for sql in axes.values() for c in _CUSTOMER_COLUMNS):
        df = df.join(t.customers.select("customer_id", *_CUSTOMER_COLUMNS), "customer_id", "left")
    return df


def evaluate(t: Tables, names: Sequence[str], axes: Mapping[str, str] | Sequence[str] = (),
             sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """The measures ``names`` by ``axes`` (names of AXES, or name -> SQL over the order row).

    ``sets`` lists grouping sets of the axes; the result then has ``nivel``, the axes of
    each row joined by commas, as a null axis value is not the same as a rolled-up axis."""
    axes = dict(axes) if isinstance(axes, Mapping) else {a: AXES[a] for a in axes}
    known = measures()
    uses = list(dict.fromkeys(c for n in names for c in known[n].uses))
    rows = order_rows(t, uses, axes).select(
        *[F.expr(sql).alias(a) for a, sql in axes.items()], *[F.expr(COMPONENTS[c].sql).alias(c) for c in uses])
    sums = [F.sum(c).alias(c) for c in uses]
    finest = rows.groupBy(*axes).agg(*sums)
    out = list(axes)
    if sets is not None:
        level = F.array_join(F.array(*[F.when(F.grouping(a) == 0, F.lit(a)) for a in axes]), ",") if axes else F.lit("")
        finest = finest.groupingSets([[F.col(a) for a in s] for s in sets], *axes).agg(*sums, level.alias("nivel"))
        out.append("nivel")
    return finest.select(*out, *[(F.expr(known[n].value) if isinstance(known[n].value, str) else known[n].value).alias(n) for n in names])


def kpi_strip(t: Tables, names: Sequence[str]) -> DataFrame:
    """Long format of measures without axes: one (kpi, valor) row each, from one aggregate."""
    agg = evaluate(t, names)
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("kpi"), F.col(n).cast("decimal(38,6)").alias("valor")) for n in names])).alias("k")).select("k.*")


def timeline(t: Tables, name: str, axes: Mapping[str, str] | Sequence[str] = ()) -> DataFrame:
    """A measure by month along ``axes``, gap-free: every combination of axis values that
    occurs has each month from the first to the last of all orders, null where it has no orders.

    The frame is as large as the result; each combination makes its own months from the
    two bounds, so none waits for another."""
    axes = dict(axes) if isinstance(axes, Mapping) else {a: AXES[a] for a in axes}
    by = list(axes)
    month = {"anio": AXES["anio"], "mes": AXES["mes"]}
    cells = evaluate(t, [name], axes | month).where("anio IS NOT NULL").withColumn("_m", F.make_date("anio", "mes", F.lit(1)))
    span = t.orders.agg(F.trunc(F.min("order_purchase_timestamp"), "month").alias("_lo"), F.trunc(F.max("order_purchase_timestamp"), "month").alias("_hi"))
    # the bounds are one row: scalar subqueries, no join
    months = F.sequence(span.select("_lo").scalar(), span.select("_hi").scalar(), F.expr("INTERVAL 1 MONTH"))
    heads = cells.select(*[F.col(a).alias(f"_{a}") for a in by]).distinct() if by else span.where("_lo IS NOT NULL").select()
    frame = heads.select("*", F.explode(months).alias("_month"))
    on = F.col("_m") == F.col("_month")
    for a in by:
        on = on & F.col(a).eqNullSafe(F.col(f"_{a}"))
    j = frame.join(cells.drop("anio", "mes"), on, "left")
    return j.select(*[F.col(f"_{a}").alias(a) for a in by], F.year("_month").alias("anio"), F.month("_month").alias("mes"), name)


def year_to_date(df: DataFrame, value: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Running sum within (axis values, year) of a ``timeline``; blank months carry it forward."""
    w = Window.partitionBy(*by, "anio").orderBy("mes").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name or f"{value}_ytd", F.sum(value).over(w))


def previous_month(df: DataFrame, value: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The value of the calendar month before, per axis values of a ``timeline``."""
    w = Window.partitionBy(*by).orderBy("anio", "mes") if by else Window.orderBy("anio", "mes")
    return df.withColumn(name or f"{value}_anterior", F.lag(value).over(w))
