"""The bundle of base relations every builder takes."""

from __future__ import annotations

import functools
import weakref
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    customers: DataFrame
    orders: DataFrame
    products: DataFrame
    sellers: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    category_translation: DataFrame
    geolocation: DataFrame | None = None

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)
                if getattr(self, f.name) is not None}

    def register_views(self, prefix: str = "") -> None:
        """Expose every relation to ``spark.sql`` (session-scoped temp views)."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(f"{prefix}{name}")


_SHARED: "weakref.WeakKeyDictionary[Tables, dict]" = weakref.WeakKeyDictionary()


def shared_plan(fn):
    """Memoise a ``Tables -> DataFrame`` builder per ``Tables`` bundle.

    Only the lazy plan object is reused (DataFrames are immutable); nothing is
    cached in memory and every action still reads the sources. Sub-plans used
    by many reports (order-grain aggregates, facts, dimensions) are then
    defined once, which saves the driver the JVM round trips of rebuilding
    their expressions for every report.
    """
    @functools.wraps(fn)
    def wrapper(t: Tables, *args, **kwargs):
        if args or kwargs:
            return fn(t, *args, **kwargs)
        memo = _SHARED.setdefault(t, {})
        key = fn.__module__ + "." + fn.__qualname__
        if key not in memo:
            memo[key] = fn(t)
        return memo[key]
    return wrapper
