"""The versioned mart: what a publish writes, keeps and shows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from tests_support import money, tiny_tables, ts

from tianguis.operators import joins
from tianguis.plans import mart_reports
from tianguis.plans.star import STAR_BUILDERS
from tianguis.sources import mart


def files(root, name):
    out = set()
    for folder, _, names in os.walk(os.path.join(root, name)):
        out |= {os.path.relpath(os.path.join(folder, n), root) for n in names if n.endswith(".parquet")}
    return out


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture()
def published(spark, make_tables):
    t = tiny_tables(make_tables)
    root = tempfile.mkdtemp(prefix="tianguis-mart-")
    assert mart.publish(spark, t, root, buckets=2) == 1
    return t, root


def february(t, make_tables):
    """February once more, with an item for its order and a new order."""
    items = make_tables(order_items=[("o2", 1, "p1", "s1", ts("2018-02-12 00:00:00"), money(7), money(1))]).order_items
    more = make_tables(orders=[("o3", "c1", "delivered", ts("2018-02-11 10:00:00"), None, None, None, ts("2018-02-20 00:00:00"))]).orders
    return replace(t, order_items=t.order_items.unionByName(items), orders=t.orders.unionByName(more))


def test_all_tables_come_back(spark, published):
    t, root = published
    m = mart.open_mart(spark, root)
    assert set(m) == set(STAR_BUILDERS)
    for name, build in STAR_BUILDERS.items():
        assert rows(m[name].drop(*mart.MONTH)) == rows(build(t)), name


def test_refreshing_a_month_writes_that_month_only(spark, published, make_tables):
    t, root = published
    old = mart.open_mart(spark, root)
    before = {n: files(root, n) for n in mart.FACTS}
    t2 = february(t, make_tables)
    assert mart.publish(spark, t2, root, months=[(2018, 2)], buckets=2) == 2
    for name in mart.FACTS:
        after = files(root, name)
        assert before[name] <= after
        assert after - before[name] and all("purchase_year=2018/purchase_month=2/" in f for f in after - before[name])
    new = mart.open_mart(spark, root)
    for name, build in STAR_BUILDERS.items():
        assert rows(new[name].drop(*mart.MONTH)) == rows(build(t2)), name
        assert rows(old[name].drop(*mart.MONTH)) == rows(build(t)), name  # a reader of the version before keeps it


def test_a_month_that_became_empty_goes(spark, published):
    t, root = published
    t2 = replace(t, orders=t.orders.where("order_id <> 'o2'"))
    mart.publish(spark, t2, root, months=[(2018, 2)], buckets=2)
    assert rows(mart.open_mart(spark, root)["fact_order_items"].drop(*mart.MONTH)) == rows(STAR_BUILDERS["fact_order_items"](t2))


def test_a_failed_publish_changes_nothing(spark, published):
    t, root = published
    broken = replace(t, order_reviews=t.order_reviews.withColumn("review_score", F.raise_error(F.lit("no")).cast("int")))
    with pytest.raises(Exception, match="no"):
        mart.publish(spark, broken, root, buckets=2)
    assert mart.versions(spark, root) == [1]
    assert rows(mart.open_mart(spark, root)["fact_order_reviews"].drop(*mart.MONTH)) == rows(STAR_BUILDERS["fact_order_reviews"](t))
    assert mart.publish(spark, t, root, buckets=2) == 2


def test_views_serve_another_session_and_follow_versions(spark, published, make_tables):
    t, root = published
    views = mart.register(spark, root, "tianguis_views")
    assert len(views) == 7
    other = spark.newSession()
    assert other.sql("SELECT count(*) FROM tianguis_views.fact_order_items").first()[0] == 2
    other.conf.set("spark.sql.caseSensitive", "true")
    assert [other.table(v).columns for v in views] == [spark.table(v).columns for v in views]
    mart.publish(spark, february(t, make_tables), root, months=[(2018, 2)], buckets=2)
    assert other.sql("SELECT count(*) FROM tianguis_views.fact_order_items").first()[0] == 2  # until it is registered
    mart.register(spark, root, "tianguis_views")
    assert other.sql("SELECT count(*) FROM tianguis_views.fact_order_items").first()[0] == 3


def test_expired_versions_leave_the_kept_ones_whole(spark, published, make_tables):
    t, root = published
    t2 = february(t, make_tables)
    mart.publish(spark, t2, root, months=[(2018, 2)], buckets=2)
    mart.publish(spark, t2, root, months=[(2018, 2)], buckets=2)
    assert mart.expire(spark, root, keep=1) == [1, 2] and mart.versions(spark, root) == [3]
    spark.catalog.clearCache()
    assert rows(mart.open_mart(spark, root)["fact_order_items"].drop(*mart.MONTH)) == rows(STAR_BUILDERS["fact_order_items"](t2))
    loads = {f.split("load=")[1][:32] for f in files(root, "fact_order_items")}
    assert len(loads) == 2  # January's from the first publish, February's from the last


def test_orders_without_a_date_have_a_month_of_their_own(spark, make_tables):
    t = tiny_tables(make_tables)
    t = replace(t, orders=t.orders.unionByName(make_tables(orders=[("o9", "c1", "created", None, None, None, None, None)]).orders))
    root = tempfile.mkdtemp(prefix="tianguis-mart-")
    mart.publish(spark, t, root, months=[(0, 0), (2018, 1)], buckets=0)
    got = mart.open_mart(spark, root)["fact_order_items"]
    assert {(r["order_id"], r["purchase_year"], r["purchase_month"]) for r in got.collect()} == {("o1", 2018, 1), ("o9", 0, 0)}


def test_order_grain_needs_no_exchange_of_facts(spark, published):
    t, root = published
    m = mart.open_mart(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = m["fact_order_items"].groupBy("order_id").agg(F.sum("price").alias("p"))
        joined = items.join(m["fact_order_reviews"].select("order_id", "review_score"), "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        loose = STAR_BUILDERS["fact_order_items"](t).groupBy("order_id").agg(F.sum("price").alias("p")).join(
            STAR_BUILDERS["fact_order_reviews"](t).select("order_id", "review_score"), "order_id")
        assert rows(joined) == rows(loose)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_uneven_buckets_are_seen(spark):
    hot = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("order_id"))
    assert not mart.even_buckets(hot, 16)
    assert mart.even_buckets(spark.range(40_000).select(F.col("id").cast("string").alias("order_id")), 16)


def test_buckets_follow_the_rows(spark, make_tables, monkeypatch):
    more = make_tables(orders=[(f"p{k}", "c1", "delivered", ts("2018-01-11 10:00:00"), None, None, None, None) for k in range(7)]).orders
    t = tiny_tables(make_tables)
    t = replace(t, orders=t.orders.unionByName(more))
    assert mart.fitting_buckets(t) == 2
    monkeypatch.setattr(mart, "ROWS_A_BUCKET", 2)
    assert mart.fitting_buckets(t) == -(-t.orders.count() // 2) > 2
    monkeypatch.setattr(mart_reports, "load_tables", lambda spark, sf_dir: t)
    root = mart_reports.mart_root(spark, f"own-rows-{uuid.uuid4().hex}")
    assert {r["buckets"] for r in mart.manifest(spark, root) if r["name"] in mart.FACTS} == {mart.fitting_buckets(t)}
    assert rows(mart.open_mart(spark, root)["fact_order_items"].drop(*mart.MONTH)) == rows(STAR_BUILDERS["fact_order_items"](t))


def test_rows_are_dealt_into_buckets_before_the_joins(spark, make_tables):
    t = tiny_tables(make_tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in mart.FACTS:
            df = mart._fact(name, mart._dealt(t, 8))
            plan = df._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in plan.splitlines() if "Exchange " in line]
            assert moved and all(re.search(r"hashpartitioning\(order_id#\d+, 8\)", line) for line in moved), plan
            assert rows(df.drop(*mart.MONTH)) == rows(STAR_BUILDERS[name](t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_a_refresh_exchanges_the_named_orders_rows_only(spark, make_tables, monkeypatch, few):
    monkeypatch.setattr(joins, "BROADCAST_KEYS", few)
    t = tiny_tables(make_tables)
    stray = make_tables(order_items=[(None, 1, "p1", "s1", None, money(7), money(1)), ("nowhere", 1, "p1", "s1", None, money(7), money(1))]).order_items
    t = replace(t, order_items=t.order_items.unionByName(stray), orders=t.orders.unionByName(t.orders.where("order_id = 'o1'")))
    own = mart._of_orders(replace(t, orders=t.orders.where("order_id = 'o1'")))
    for child in mart.CHILDREN.values():
        assert rows(getattr(own, child)) == rows(getattr(t, child).where("order_id = 'o1'")), child
