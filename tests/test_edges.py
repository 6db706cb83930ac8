"""Hand-made edge rows (FIXTURES.md section 2) through the star schema, the
exploratory queries, the findings and the measures; expected values worked
out by hand."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tests_support import money, ts
from tianguis.functions.exprs import NO_SELLER, SINGLE_SELLER, SPLIT_SHIPMENT
from tianguis.plans import eda, findings, measures, star

D = Decimal


@pytest.fixture()
def t(make_tables):
    return make_tables(
        customers=[("c1", "u1", "01037", "sao paulo", "SP"),
                   ("c2", "u2", "20000", "rio", "RJ"),
                   ("c3", "u1", "01037", "sao paulo", "SP"),
                   ("c4", "u4", "69000", "manaus", "AM")],
        orders=[
            # on the estimated date but a later hour: on time, 0 delay days
            ("o1", "c1", "delivered", ts("2018-01-10 23:59:00"), ts("2018-01-11 00:30:00"),
             ts("2018-01-12 10:00:00"), ts("2018-01-20 15:00:00"), ts("2018-01-20 00:00:00")),
            # late by 5 days
            ("o2", "c2", "delivered", ts("2018-01-15 23:59:00"), ts("2018-01-16 01:00:00"),
             ts("2018-01-17 09:00:00"), ts("2018-01-25 00:01:00"), ts("2018-01-20 00:00:00")),
            # delivered status without a delivery date
            ("o3", "c1", "delivered", ts("2018-02-01 10:00:00"), ts("2018-02-01 11:00:00"),
             None, None, ts("2018-02-20 00:00:00")),
            # canceled, both delivery dates present
            ("o4", "c3", "canceled", ts("2018-02-05 10:00:00"), ts("2018-02-05 11:00:00"),
             ts("2018-02-06 10:00:00"), ts("2018-02-10 10:00:00"), ts("2018-02-25 00:00:00")),
            # no items, no payment, no review
            ("o5", "c4", "shipped", ts("2018-03-01 10:00:00"), ts("2018-03-01 11:00:00"),
             ts("2018-03-02 10:00:00"), None, ts("2018-03-20 00:00:00")),
        ],
        products=[("p1", "beleza", 10, None, None, 100, None, None, None),
                  ("p2", None, 10, None, None, 100, None, None, None),
                  ("p3", "pc_gamer", 10, None, None, 100, None, None, None)],
        category_translation=[("beleza", "health_beauty"), ("sin_uso", "unused")],
        sellers=[("s1", "01000", "sao paulo", "SP"), ("s2", "20000", "rio", "RJ"),
                 ("s3", "30000", "bh", "MG")],
        order_items=[
            ("o1", 1, "p1", "s1", ts("2018-01-12 00:00:00"), money(100), money(10)),
            ("o1", 2, "p2", "s2", ts("2018-01-12 00:00:00"), money(50), money(5)),
            ("o2", 1, "p1", "s1", ts("2018-01-17 00:00:00"), money(30), money(3)),
            ("o2", 2, "p3", "s1", ts("2018-01-17 00:00:00"), money(30), money(3)),
            ("o3", 1, "p2", "s2", ts("2018-02-02 00:00:00"), money(80), money(8)),
            ("o4", 1, "p3", "s3", ts("2018-02-06 00:00:00"), money(20), money(2)),
        ],
        order_payments=[("o1", 1, "credit_card", 2, money(100)),
                        ("o1", 2, "voucher", 1, money(30)),
                        ("o1", 3, "voucher", 1, money(35)),
                        ("o2", 1, "credit_card", 0, money(66)),
                        ("o3", 1, "credit_card", None, money(88)),
                        ("o4", 1, "boleto", 1, money(22))],
        order_reviews=[("r1", "o1", 2, None, None, None, None),
                       ("r2", "o1", 3, None, None, None, None),
                       ("r3", "o2", 1, None, None, None, None),
                       ("r4", "o3", 5, None, None, None, None),
                       ("r5", "o4", 4, None, None, None, None)],
    )


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda x: tuple((v is None, str(v)) for v in x))


def test_facts_keep_orders_without_children(t):
    items = star.fact_order_items(t)
    assert items.count() == 7
    o5 = items.where("order_id = 'o5'").collect()
    assert len(o5) == 1 and o5[0]["order_item_id"] is None and o5[0]["price"] is None
    assert star.fact_order_payments(t).count() == 7
    assert star.fact_order_reviews(t).count() == 6


def test_item_fact_delivery_columns(t):
    f = {r["order_id"]: r for r in star.fact_order_items(t).where("order_item_id = 1 or order_id = 'o5'").collect()}
    assert (f["o1"]["is_late"], f["o1"]["delay_days"], f["o1"]["delivery_days"]) == ("No", 0, 10)
    assert (f["o2"]["is_late"], f["o2"]["delay_days"], f["o2"]["delivery_days"]) == ("Sí", 5, 10)
    assert (f["o3"]["is_late"], f["o3"]["delay_days"], f["o3"]["delivery_days"]) == ("No", 0, None)
    assert f["o1"]["subtotal"] == D("110.00")


def test_review_fact_shipment_type(t):
    got = dict(rows(star.fact_order_reviews(t).select("order_id", "tipo_logistica").distinct(),
                    "order_id", "tipo_logistica"))
    assert got == {"o1": SPLIT_SHIPMENT, "o2": SINGLE_SELLER, "o3": SINGLE_SELLER,
                   "o4": SINGLE_SELLER, "o5": NO_SELLER}


def test_dim_product_keeps_uncategorised(t):
    d = {r["product_id"]: r["product_category_name_english"] for r in star.dim_product(t).collect()}
    assert d == {"p1": "health_beauty", "p2": None, "p3": None}


def test_dim_calendar_is_gap_free(t):
    cal = star.dim_calendar(t)
    assert cal.count() == 51  # 2018-01-10 .. 2018-03-01
    first = cal.orderBy("date").first()
    assert (first["year"], first["quarter"], first["month_name"], first["day_name"]) == \
        (2018, 1, "January", "Wednesday")


def test_h1_on_time_includes_undelivered(t):
    got = dict(rows(findings.h1_score_by_lateness(t), "tipo_entrega", "score_promedio"))
    assert got == {"Entregas con Retraso": D("1.00"), "Entregas sin Retraso": D("3.83")}


def test_h2_review_grain(t):
    got = rows(findings.h2_score_by_shipment_type(t), "tipo_logistica", "volumen_ordenes",
               "score_promedio")
    assert got == [(SPLIT_SHIPMENT, 2, D("2.50")), (SINGLE_SELLER, 3, D("3.33"))]


def test_h3_delivered_orders(t):
    got = rows(findings.h3_transit_days_by_lateness(t), "is_late", "avg_seller_to_courier",
               "avg_courier_to_customer")
    assert got == [("No", D("1.00"), D("8.00")), ("Sí", D("1.00"), D("8.00"))]


def test_h4_having_boundary(t):
    got = rows(findings.h4_sellers_by_late_rate(t, min_orders=2), "seller_id", "total_pedidos",
               "pedidos_con_retraso", "tasa_retraso", "dias_promedio_retraso")
    assert got == [("s1", 2, 1, D("50.00"), D("5.00")), ("s2", 2, 0, D("0.00"), None)]
    assert findings.h4_sellers_by_late_rate(t, min_orders=3).count() == 0


def test_h5_zero_and_null_installments_in_last_range(t):
    got = dict(rows(findings.h5_ticket_by_installments(t), "rango_cuotas", "ticket_promedio"))
    assert got == {"2-3 cuotas": D("100.000000"), "11+ cuotas": D("77.000000")}


def test_b3_state_without_deliveries_is_null(t):
    got = dict(rows(findings.b3_late_rate_by_state(t), "customer_state", "tasa_retraso"))
    assert got == {"SP": D("0.0000"), "RJ": D("1.0000"), "AM": None}


def test_q06_half_up(t):
    got = dict(rows(eda.q06_score_distribution(t), "puntuacion", "total_ordenes"))
    assert got == {1: 1, 3: 1, 4: 1, 5: 1}


def test_q08_counts_items_and_canceled_with_dates(t):
    got = rows(eda.q08_monthly_delivered_revenue(t), "anio", "mes", "pedidos", "total_ingresos")
    assert got == [(2018, 1, 4, D("210.00")), (2018, 2, 2, D("100.00"))]


def test_q09_full_outer_and_null_group(t):
    got = rows(eda.q09_dissatisfied_categories(t, min_reviews=1), "categoria_en",
               "avg_review_score", "reviews_totales", "reviews_negativos", "pct_reviews_negativos")
    assert set(got) == {
        ("health_beauty", D("2.00"), 3, 2, D("66.67")),
        (None, D("3.00"), 5, 2, D("40.00")),
        ("unused", None, 1, 0, D("0.00")),
    }
    # the default HAVING >= 50 removes all of them
    assert eda.q09_dissatisfied_categories(t).count() == 0


def test_q12_keeps_ties(t):
    got = rows(eda.q12_priciest_product_per_customer(t), "cliente", "producto_comprado", "precio")
    assert got == [("c1", "p1", D("100.00")), ("c2", "p1", D("30.00")), ("c2", "p3", D("30.00")),
                   ("c3", "p3", D("20.00"))]


def test_q13_first_row_null_and_trend(t):
    got = rows(eda.q13_mom_growth(t), "anio", "mes", "ingreso", "variacion_porcentual", "tendencia")
    assert got == [(2018, 1, D("231.00"), None, None),
                   (2018, 2, D("110.00"), D("-52.38"), "decremento")]


def test_m03_weighted_installments(t):
    assert measures.m03_mean_installments(t).first()[0] == D("0.67")


def test_m04_gap_free_calendar_months(t):
    got = rows(measures.m04_mom_growth(t), "anio", "mes", "crecimiento_mom")
    assert got == [(2018, 1, D("0.0000")), (2018, 2, D("-0.5238")), (2018, 3, D("-1.0000"))]


def test_m05_ytd_carries_forward(t):
    got = rows(measures.m05_revenue_ytd(t), "mes", "ingreso", "ingreso_acumulado_ytd")
    assert got == [(1, D("210.00"), D("210.00")), (2, D("100.00"), D("310.00")),
                   (3, None, D("310.00"))]


def test_m08_ticket_over_orders_with_items(t):
    r = measures.m08_average_ticket(t).first()
    assert (r["total_ingresos"], r["pedidos_con_items"], r["ticket_promedio"]) == \
        (D("310.00"), 4, D("77.50"))


def test_filter_context_slices_every_table(t):
    from pyspark.sql import functions as F
    from tianguis.plans.context import filter_context
    sp = filter_context(t, customers=F.col("customer_state") == "SP")
    # SP customers c1, c3 own orders o1, o3, o4
    assert sorted(r[0] for r in sp.orders.select("order_id").collect()) == ["o1", "o3", "o4"]
    assert measures.m06_total_revenue(sp).first()[0] == D("250.00")      # 100 + 50 + 80 + 20
    assert sp.order_payments.count() == 5 and sp.order_reviews.count() == 4
    beleza = filter_context(t, products=F.col("product_category_name") == "beleza")
    # a product slicer reaches the items alone ...
    assert measures.m06_total_revenue(beleza).first()[0] == D("130.00")  # o1 p1 100 + o2 p1 30
    assert measures.m07_total_orders(beleza).first()[0] == 5
    assert beleza.order_payments.count() == t.order_payments.count()
    # ... unless both directions are asked for: then only orders that hold such an item
    both = filter_context(t, products=F.col("product_category_name") == "beleza", both_directions=True)
    assert measures.m06_total_revenue(both).first()[0] == D("130.00")
    assert measures.m07_total_orders(both).first()[0] == 2


def test_kpi_strips_by_hand(t):
    from tianguis.plans import dashboard
    kpi = lambda df: {r["kpi"]: float(r["valor"]) for r in df.collect()}
    assert all(isinstance(r["valor"], D) for r in dashboard.v01_kpis_overview(t).collect())
    assert kpi(dashboard.v01_kpis_overview(t)) == {
        "total_ingresos": 310.0, "total_pedidos": 5.0, "ticket_promedio": 77.5,
        "score_promedio": 3.13,          # (2.5 + 1 + 5 + 4) / 4 = 3.125, half-up
        "tasa_insatisfaccion": 25.0,     # o2 of the four reviewed orders
        "tasa_entrega": 60.0}            # o1, o2, o3 of five
    assert kpi(dashboard.v13_kpis_payments(t)) == {
        "total_pagado": 341.0, "cuotas_promedio": 0.67, "pago_promedio": 85.25,
        "participacion_tarjeta": 50.0}   # 3 of 6 payment rows
    assert kpi(dashboard.v09_kpis_logistics(t)) == {
        "dias_vendedor_courier": 1.0, "dias_courier_cliente": 6.67, "dias_entrega": 8.33,
        "dias_retraso": 5.0, "tasa_retraso": 33.33}


def test_measures_accept_expression_and_name_slicers(t):
    from pyspark.sql import functions as F
    by_month = [F.year("order_purchase_timestamp").alias("anio"),
                F.month("order_purchase_timestamp").alias("mes")]
    got = rows(measures.m08_average_ticket(t, by=by_month), "anio", "mes", "ticket_promedio")
    assert got == [(2018, 1, D("105.00")), (2018, 2, D("50.00"))]
    got = rows(measures.m02_late_rate(t, by=["order_status"]), "order_status", "tasa_retraso")
    assert got == [("canceled", D("0.00")), ("delivered", D("50.00")), ("shipped", D("0.00"))]
    # a key whose name the measure also uses internally does not collide
    got = rows(measures.m10_delivery_rate(t, by=["order_status"]), "order_status", "tasa_entrega")
    assert got == [("canceled", D("0.00")), ("delivered", D("100.00")), ("shipped", D("0.00"))]
