"""A hot key (two thirds of the child rows on one order) must be split by AQE
in the facts' join shape, where a plain LEFT OUTER join cannot be split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tianguis.operators.joins import keep_parents_join

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _plan(df) -> str:
    rows = df.collect()  # executes this very plan, so the final AQE plan is visible
    return str(len(rows)) + "\n" + df._jdf.queryExecution().executedPlan().toString()


def test_hot_order_is_split(spark, skew_conf):
    items = spark.range(300000).select(
        F.when(F.col("id") < 200000, F.lit("hot"))
        .otherwise((F.col("id") % 5000).cast("string")).alias("order_id"),
        F.col("id").alias("item"))
    orders = (spark.range(6000).select(F.col("id").cast("string").alias("order_id"))
              .unionByName(spark.range(1).select(F.lit("hot").alias("order_id"))))
    j = keep_parents_join(orders, items, "order_id")
    plan = _plan(j)
    assert plan.startswith("301000\n")      # 300000 items + 1000 orders without items
    assert "SortMergeJoin(skew=true)" in plan
    plain = _plan(orders.join(items, "order_id", "left"))
    assert "skew=true" not in plain
