"""The star schema is also usable from SQL: named views, then ``spark.sql``."""

from __future__ import annotations

import os

import pytest

from tests_support import SF_SMALL
from tianguis.plans import findings, star
from tianguis.registry import tables_for

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables absent")


def test_views_answer_like_builders(spark):
    t = tables_for(spark, SF_SMALL)
    star.register_star(spark, t)
    t.register_views(prefix="base_")
    via_sql = spark.sql("""
        WITH per_order AS (
          SELECT order_id,
                 max(is_late = 'Sí') AS late,
                 max(seller_to_courier_delivery_days) AS s2c,
                 max(courier_to_customer_delivery_days) AS c2c
          FROM analytics_fact_order_items
          WHERE order_status = 'delivered'
          GROUP BY order_id)
        SELECT CASE WHEN late THEN 'Sí' ELSE 'No' END AS is_late,
               CAST(sum(s2c) / count(s2c) AS DECIMAL(38, 2)) AS avg_seller_to_courier,
               CAST(sum(c2c) / count(c2c) AS DECIMAL(38, 2)) AS avg_courier_to_customer
        FROM per_order GROUP BY late""")
    via_df = findings.h3_transit_days_by_lateness(t)
    assert sorted(map(tuple, via_sql.collect())) == sorted(map(tuple, via_df.collect()))
    n = spark.sql("SELECT count(*) FROM base_orders").first()[0]
    assert n == t.orders.count()
