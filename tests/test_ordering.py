"""Row order of the reports that promise one (the oracle compares multisets only)."""

from __future__ import annotations

import pytest
from tests_support import SF_SMALL

from tianguis.registry import builders, tables_for


def collected(spark, name):
    return builders()[name](tables_for(spark, SF_SMALL)).collect()


@pytest.mark.parametrize(("name", "column", "down"), [
    ("q09_dissatisfied_categories", "avg_review_score", False), ("h4_sellers_by_late_rate", "tasa_retraso", True),
    ("v12_worst_sellers", "tasa_retraso", True), ("v11_late_rate_by_state", "tasa_retraso", True),
    ("v08_category_detail", "tasa_ineficiencia", True), ("v03_revenue_by_category", "ingreso", True),
    ("q12_priciest_product_per_customer", "precio", True), ("b5_payment_type_distribution", "total_ordenes", True)])
def test_rows_come_sorted(spark, name, column, down):
    values = [r[column] for r in collected(spark, name) if r[column] is not None]
    assert values == sorted(values, reverse=down)


def test_months_come_in_order(spark):
    rows = [(r["anio"], r["mes"]) for r in collected(spark, "q03_orders_per_month")]
    assert rows and rows == sorted(rows)


def test_rank_window_is_cut_before_its_exchange(spark):
    plan = builders()["q12_priciest_product_per_customer"](tables_for(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and all(r["ranking"] == 1 for r in collected(spark, "q12_priciest_product_per_customer"))


def test_semi_join_side_is_distinct(spark):
    plan = builders()["p14_customers_with_late_orders"](tables_for(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Aggregate [customer_id" in plan
