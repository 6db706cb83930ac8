"""Invariants over the driver tables (sf0.001) and of the rounding helper."""

from __future__ import annotations

import os
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests_support import SF_SMALL
from tianguis.functions.exprs import ratio
from tianguis.plans import eda, measures, star
from tianguis.registry import tables_for

needs_data = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables absent")


@pytest.fixture(scope="module")
def t(spark):
    return tables_for(spark, SF_SMALL)


@needs_data
def test_late_iff_positive_delay(t):
    f = star.fact_order_items(t)
    bad = f.where((F.col("is_late") == "Sí") != (F.col("delay_days") > 0)).count()
    assert bad == 0


@needs_data
def test_fact_rows_are_children_plus_childless_orders(t):
    for fact, child in ((star.fact_order_items, t.order_items),
                        (star.fact_order_payments, t.order_payments),
                        (star.fact_order_reviews, t.order_reviews)):
        childless = t.orders.join(child.select("order_id").distinct(), "order_id", "left_anti")
        assert fact(t).count() == child.count() + childless.count()


@needs_data
def test_revenue_is_preserved_by_the_fact(t):
    a = star.fact_order_items(t).agg(F.sum("price")).first()[0]
    b = t.order_items.agg(F.sum("price")).first()[0]
    assert a == b


@needs_data
def test_percentages_sum_to_100(t):
    for df, col in ((eda.q01_orders_by_status(t), "porcentaje"),
                    (eda.q06_score_distribution(t), "porcentaje"),
                    (eda.q05_payment_methods(t), "porcentaje")):
        total = df.agg(F.sum(col)).first()[0]
        assert abs(total - Decimal(100)) <= Decimal("0.05")


@needs_data
def test_ytd_december_equals_year_sum(t):
    ytd = eda.q11_ytd_cumulative(t)
    by_year = {r["anio"]: r["s"] for r in ytd.groupBy("anio").agg(F.sum("total_orden").alias("s")).collect()}
    last = ytd.groupBy("anio").agg(F.max("mes").alias("mes")).join(ytd, ["anio", "mes"])
    for r in last.collect():
        assert r["total_orden_acumulado"] == by_year[r["anio"]]


@needs_data
def test_measures_agree_with_reports(t):
    m6 = measures.m06_total_revenue(t).first()[0]
    q11_all = eda.q08_monthly_delivered_revenue(t)  # delivered subset can only be smaller
    assert q11_all.agg(F.sum("total_ingresos")).first()[0] <= m6
    assert measures.m07_total_orders(t).first()[0] == t.orders.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(1, 10**9)),
                min_size=1, max_size=20),
       st.integers(0, 6))
def test_ratio_matches_decimal_half_up(spark, pairs, scale):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(ratio("n", "d", scale)).collect()]
    q = Decimal(1).scaleb(-scale)
    for (n, d), g in zip(pairs, got):
        want = (Decimal(abs(n)) / Decimal(d)).quantize(q, rounding=ROUND_HALF_UP)
        want = want if n >= 0 else -want
        assert g == want, (n, d, scale, g, want)
