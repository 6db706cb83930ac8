"""Measure algebra, time measures along axes, distinct counts from bitmaps, calendar slicer."""

from __future__ import annotations

import random
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tests_support import SF_SMALL, money, tiny_tables, ts

from tianguis.operators.distinct import bitmaps, dense_ids, rolled_up
from tianguis.plans import algebra, dashboard, measures
from tianguis.plans.context import filter_context, sliced_mart
from tianguis.plans.mart_reports import revenue_by_state
from tianguis.registry import tables_for
from tianguis.sources import mart


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def small(spark):
    return tables_for(spark, SF_SMALL)


@pytest.mark.parametrize(("name", "old", "column"), [
    ("total_ingresos", measures.m06_total_revenue, "total_ingresos"), ("tasa_retraso", measures.m02_late_rate, "tasa_retraso"),
    ("ticket_promedio", measures.m08_average_ticket, "ticket_promedio"), ("score_promedio", measures.m01_score_per_order, "score_promedio_por_orden"),
    ("tasa_insatisfaccion", measures.m09_dissatisfaction_rate, "tasa_insatisfaccion"), ("tasa_entrega", measures.m10_delivery_rate, "tasa_entrega"),
    ("cuotas_promedio", measures.m03_mean_installments, "cuotas_promedio"), ("pago_promedio", measures.m12_payments, "pago_promedio"),
    ("dias_entrega", measures.m11_logistics_days, "dias_entrega"), ("dias_retraso", measures.m11_logistics_days, "dias_retraso")])
def test_measure_equals_its_own_function_along_an_axis(small, name, old, column):
    one = {r["estado_de_orden"]: r[name] for r in algebra.evaluate(small, [name], ["estado_de_orden"]).collect()}
    other = {r["order_status"]: r[column] for r in old(small, by=["order_status"]).collect()}
    assert {k: one[k] for k in other} == other


def test_each_table_is_scanned_once(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = algebra.evaluate(small, list(algebra.measures()))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # orders are read for themselves, for the derived payments and for the derived reviews
    assert plan.count("Relation [") == 4 and plan.count("l_extendedprice") and plan.count("Expand") == 0


def test_grouping_sets_tell_null_from_total(make_tables):
    t = tiny_tables(make_tables)
    stray = make_tables(orders=[("o7", "nobody", "delivered", ts("2018-01-10 10:00:00"), None, None, None, None)]).orders
    t = replace(t, orders=t.orders.unionByName(stray))
    out = {(r["nivel"], r["estado"]): (r["total_pedidos"], r["total_ingresos"]) for r in
           algebra.evaluate(t, ["total_pedidos", "total_ingresos"], ["estado"], [["estado"], []]).collect()}
    assert out == {("estado", "SP"): (2, Decimal("10.00")), ("estado", None): (1, None), ("", None): (3, Decimal("10.00"))}


def test_orphaned_payments_count_in_the_card_share_only(make_tables):
    t = tiny_tables(make_tables)
    t = replace(t, order_payments=t.order_payments.unionByName(
        make_tables(order_payments=[("gone", 1, "boleto", 1, money(5)), ("gone", 2, "credit_card", 1, money(5)), ("o2", 1, "boleto", 1, money(4))]).order_payments))
    kpis = {r["kpi"]: r["valor"] for r in dashboard.v13_kpis_payments(t).collect()}
    assert kpis["total_pagado"] == 15 and kpis["pago_promedio"] == Decimal("7.5") and kpis["participacion_tarjeta"] == 50


def test_empty_model(make_tables):
    t = make_tables()
    kpis = {r["kpi"]: r["valor"] for r in dashboard.v01_kpis_overview(t).collect()}
    assert kpis["total_pedidos"] == 0 and kpis["total_ingresos"] is None
    assert measures.m05_revenue_ytd(t, ["estado"]).collect() == []


def test_time_measures_by_state_fill_missing_months(make_tables):
    t = make_tables(
        customers=[("c1", "u1", "1", "x", "SP"), ("c2", "u2", "1", "x", "RJ")],
        orders=[(f"o{i}", c, "delivered", ts(d), None, None, None, None) for i, (c, d) in enumerate(
            [("c1", "2017-11-05 00:00:00"), ("c1", "2018-01-05 00:00:00"), ("c2", "2018-02-05 00:00:00")])],
        order_items=[("o0", 1, "p", "s", None, money(10), None), ("o1", 1, "p", "s", None, money(20), None), ("o2", 1, "p", "s", None, money(5), None)])
    ytd = {(r["estado"], r["anio"], r["mes"]): r["ingreso_acumulado_ytd"] for r in measures.m05_revenue_ytd(t, ["estado"]).collect()}
    assert len(ytd) == 8 and ytd["SP", 2017, 12] == 10 and ytd["SP", 2018, 2] == 20 and ytd["RJ", 2018, 1] is None and ytd["RJ", 2018, 2] == 5
    mom = {(r["estado"], r["anio"], r["mes"]): (r["ingreso_mes_anterior"], r["crecimiento_mom"]) for r in measures.m04_mom_growth(t, ["estado"]).collect()}
    assert mom["SP", 2017, 12] == (10, -1) and mom["SP", 2018, 1] == (None, 0) and mom["SP", 2018, 2] == (20, -1) and mom["RJ", 2018, 2] == (None, 0)


def test_bitmaps_equal_distinct_counts(spark):
    rng = random.Random(4)
    data = [(2000 + rng.randrange(3), rng.randrange(1, 13), rng.choice([None, *[f"k{i}" for i in range(400)]])) for _ in range(5000)]
    df = spark.createDataFrame(data, "y int, m int, k string")
    ids = dense_ids(df, "k", keys_a_part=37)
    got = [r["id"] for r in ids.collect()]
    assert len(set(got)) == len(got) == 400 and max(got) < 900
    stored = bitmaps(df.join(ids.withColumnRenamed("key", "k"), "k", "left"), ["y", "m"], {"k": "id"})
    up = {(r["y"], r["q"]): r["n"] for r in rolled_up(stored, {"y": "y", "q": "ceil(m / 3)"}).collect()}
    plain = {(r["y"], r["q"]): r["n"] for r in df.groupBy("y", F.expr("ceil(m / 3)").alias("q")).agg(F.count_distinct("k").alias("n")).collect()}
    assert up == plain


def test_later_keys_follow_the_known_ones(spark):
    first = dense_ids(spark.createDataFrame([("a",), ("b",)], "k string"), "k").cache()
    both = {r["key"]: r["id"] for r in dense_ids(spark.createDataFrame([("b",), ("c",), ("d",), (None,)], "k string"), "k", known=first).collect()}
    assert {k: both[k] for k in "ab"} == {r["key"]: r["id"] for r in first.collect()} and sorted(both.values()) == [0, 1, 2, 3]


def test_calendar_slicer_prunes_folders_and_equals_the_model(spark, small, tmp_path):
    mart.publish(spark, small, str(tmp_path), buckets=0)
    days = F.expr("quarter = 2 AND day_of_week >= 6")
    m = sliced_mart(mart.open_mart(spark, str(tmp_path)), dates=days)
    plan = m["fact_order_items"]._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters")[1].split("]")[0]
    sliced = filter_context(small, dates=days)
    j = sliced.order_items.join(sliced.orders, "order_id").join(sliced.customers, "customer_id")
    want = j.groupBy("customer_state").agg(F.count(F.lit(1)).alias("items"), F.sum("price").alias("ingreso"))
    assert rows(revenue_by_state(m)) == rows(want) and want.count() > 0
    sp = sliced_mart(mart.open_mart(spark, str(tmp_path)), dates=days, customers=F.col("customer_state") == "NATION_1")
    assert [r["customer_state"] for r in revenue_by_state(sp).collect()] in ([], ["NATION_1"])


def test_ids_meet_before_their_bitmap_is_made(spark):
    """No exchange of partial bitmaps: a block's ids are in one task when its bitmap is made."""
    df = spark.range(1000).select((F.col("id") % 3).alias("y"), (F.col("id") * 40_000).alias("id"))
    lines = bitmaps(df, ["y"], {"k": "id"})._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [k for k, line in enumerate(lines) if "bitmap_construct_agg" in line]
    assert len(at) == 2 and not any("Exchange" in line for line in lines[at[0]:at[1]])
