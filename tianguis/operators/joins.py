"""Join shapes used by the star-schema builders.

``keep_parents_join`` is ``parent LEFT JOIN child`` for a parent that is unique
on the key (orders) and a child that may be heavily skewed on it (one order may
carry a third of all items). A plain left outer join cannot have its skewed
*right* side split by AQE, so it is rewritten as

    child INNER JOIN parent            -- skewed child on the splittable left side
    UNION ALL
    parent LEFT ANTI JOIN keys(child)  -- parents without children, NULL child columns

``keys(child)`` is a distinct projection: the partial aggregate collapses a hot
key to one row per map task before the shuffle. Both branches shuffle the same
NULL-free parent the same way, so Spark reuses that exchange; parents with a
NULL key (which can never match) are appended as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_KEYS = 1_000_000  # keys that are sent to all tasks up to this many, joined by shuffle beyond


def key_side(keys: DataFrame) -> DataFrame:
    """``keys`` (one column) as the right side of a semi or anti join: broadcast where few, so that the
    rows on the left are not exchanged for it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keep_parents_join(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Rows of ``parent LEFT JOIN child USING (key)``; parent columns first."""
    child_cols = [c for c in child.columns if c != key]
    nulls = [F.lit(None).cast(child.schema[c].dataType).alias(c) for c in child_cols]
    cols = parent.columns + child_cols
    # Both branches read the same filtered parent, so its shuffle is reused.
    keyed = parent.where(F.col(key).isNotNull())
    matched = child.join(keyed, key, "inner")
    orphans = keyed.join(child.select(key).distinct(), key, "left_anti")
    unkeyed = parent.where(F.col(key).isNull())  # never match; kept as in a left join
    return (matched.select(*cols)
            .unionByName(orphans.select("*", *nulls).select(*cols))
            .unionByName(unkeyed.select("*", *nulls).select(*cols)))
