"""What several test modules share: the small tables' path, literals, a minimal complete model."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

SF_SMALL = "/root/testdata/sf0.001"


def ts(s: str | None):
    return None if s is None else dt.datetime.fromisoformat(s)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def tiny_tables(make_tables):
    """Two orders, one of them without items."""
    return make_tables(
        customers=[("c1", "u1", "01037", "sao paulo", "SP")],
        orders=[("o1", "c1", "delivered", ts("2018-01-10 10:00:00"), ts("2018-01-10 11:00:00"),
                 ts("2018-01-11 10:00:00"), ts("2018-01-15 10:00:00"), ts("2018-01-20 00:00:00")),
                ("o2", "c1", "canceled", ts("2018-02-10 10:00:00"), None, None, None,
                 ts("2018-02-20 00:00:00"))],
        products=[("p1", "beleza", 10, None, None, 100, None, None, None)],
        category_translation=[("beleza", "health_beauty")],
        sellers=[("s1", "01000", "sao paulo", "SP")],
        order_items=[("o1", 1, "p1", "s1", ts("2018-01-12 00:00:00"), money(10), money(1))],
        order_payments=[("o1", 1, "credit_card", 1, money(11))],
        order_reviews=[("r1", "o1", 5, None, None, None, None)],
    )
