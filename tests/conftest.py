from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tianguis.session import local_session  # noqa: E402
from tianguis.sources import schemas as S  # noqa: E402
from tianguis.sources.tables import Tables  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="tianguis-tests")
    yield s
    s.stop()


@pytest.fixture()
def make_tables(spark):
    """Build a ``Tables`` bundle from row lists (missing tables are empty)."""

    def build(**rows) -> Tables:
        frames = {}
        for name in ("customers", "orders", "products", "sellers", "order_items",
                     "order_payments", "order_reviews", "category_translation"):
            frames[name] = spark.createDataFrame(rows.get(name, []), S.SCHEMAS[name])
        return Tables(**frames)

    return build
