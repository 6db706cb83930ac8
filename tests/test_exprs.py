"""Expression semantics: day counting, lateness, buckets and exact rounding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tests_support import ts
from tianguis.functions import exprs as X


def _one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_day_diff_counts_midnights(spark):
    rows = [(ts("2018-01-15 23:59:00"), ts("2018-01-16 00:01:00")),
            (ts("2018-01-15 00:00:00"), ts("2018-01-15 23:59:00")),
            (None, ts("2018-01-16 00:01:00"))]
    got = _one(spark, rows, "a timestamp_ntz, b timestamp_ntz", X.day_diff("a", "b"))
    assert got == [1, 0, None]


def test_late_uses_dates_delay_uses_timestamps(spark):
    rows = [
        # delivered on the estimated day, later hour: on time, 0 days of delay
        (ts("2018-01-20 15:00:00"), ts("2018-01-20 00:00:00")),
        # one day late
        (ts("2018-01-21 08:00:00"), ts("2018-01-20 00:00:00")),
        # undelivered
        (None, ts("2018-01-20 00:00:00")),
    ]
    df = spark.createDataFrame(rows, "d timestamp_ntz, e timestamp_ntz")
    got = df.select(X.yes_no(X.is_late("d", "e")), X.delay_days("d", "e")).collect()
    assert [tuple(r) for r in got] == [(X.NO, 0), (X.YES, 1), (X.NO, 0)]


def test_installment_range_edges(spark):
    vals = [0, None, 1, 2, 3, 4, 6, 7, 10, 11, 13]
    got = _one(spark, [(v,) for v in vals], "n int", X.installment_range("n"))
    assert got == ["11+ cuotas", "11+ cuotas", "1 cuota (contado)", "2-3 cuotas", "2-3 cuotas",
                   "4-6 cuotas", "4-6 cuotas", "7-10 cuotas", "7-10 cuotas", "11+ cuotas",
                   "11+ cuotas"]


def test_logistics_type(spark):
    got = _one(spark, [(1,), (2,), (0,), (None,)], "n long", X.logistics_type("n"))
    assert got == [X.SINGLE_SELLER, X.SPLIT_SHIPMENT, X.NO_SELLER, X.NO_SELLER]


def test_ratio_rounds_half_up_once(spark):
    rows = [(5, 2), (1, 3), (2, 3), (-5, 2), (1, 0), (None, 4)]
    df = spark.createDataFrame(rows, "n long, d long")
    r0 = [r[0] for r in df.select(X.ratio("n", "d", 0)).collect()]
    assert r0 == [Decimal(3), Decimal(0), Decimal(1), Decimal(-3), None, None]
    r2 = [r[0] for r in df.select(X.ratio("n", "d", 2)).collect()]
    assert r2[:3] == [Decimal("2.50"), Decimal("0.33"), Decimal("0.67")]


def test_ratio_no_double_rounding(spark):
    # 1.004999... must not become 1.01 through an intermediate rounding
    df = spark.createDataFrame([(Decimal("100.49"), 100)], "s decimal(20,2), n long")
    got = df.select(X.ratio("s", "n", 2, num_scale=2)).first()[0]
    assert got == Decimal("1.00")


def test_share_pct(spark):
    df = spark.createDataFrame([(1, 3)], "a long, b long")
    assert df.select(X.share_pct("a", "b")).first()[0] == Decimal("33.33")


def test_avg_exact_ignores_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert df.agg(X.avg_exact("x", 2)).first()[0] == Decimal("1.50")
    assert df.select(F.lit(1)).count() == 3
