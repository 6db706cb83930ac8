"""Cleaning steps (projections, never in-place updates).

* ``strip_quotes``   - remove literal double quotes left by a quote-unaware load.
* ``replace_commas`` - rewrite embedded commas of a text column (``,`` -> `` -``).
* ``insert_missing`` - append literal rows whose key is absent (idempotent insert).
* ``rtrim_cr``       - drop a trailing carriage return kept by mixed line endings.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The text columns the load cleans of literal quotes, per table.
QUOTED_COLUMNS = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix",
                  "customer_city", "customer_state"],
    "orders": ["order_id", "customer_id"],
    "products": ["product_id"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city"],
    "order_items": ["order_id", "product_id", "seller_id"],
    "order_payments": ["order_id"],
}
COMMA_REPLACEMENT = " -"


def strip_quotes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.replace(F.col(c), F.lit('"'), F.lit("")) for c in columns})


def replace_commas(df: DataFrame, column: str, replacement: str = COMMA_REPLACEMENT) -> DataFrame:
    return df.withColumn(column, F.replace(F.col(column), F.lit(","), F.lit(replacement)))


def rtrim_cr(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.regexp_replace(F.col(c), "\r$", "") for c in columns})


def insert_missing(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``base`` plus the ``rows`` whose key is not in ``base`` yet.

    The anti join makes a rerun a no-op, like an insert guarded by its primary key.
    """
    new = rows.join(base.select(*key), key, "left_anti")
    return base.unionByName(new)


def clean_table(name: str, df: DataFrame) -> DataFrame:
    """Apply the per-table quote stripping of the load script."""
    cols = [c for c in QUOTED_COLUMNS.get(name, []) if c in df.columns]
    return strip_quotes(df, cols) if cols else df
