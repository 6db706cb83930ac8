"""Distinct counts that roll up: exact bitmaps over dense ids.

A distinct count of a month cannot be added to that of the next, a bitmap of the ids can
be united with it. Keys get dense numbers once (``dense_ids``); per period and block of
32,768 numbers one bitmap of 4 KB says which occur (``bitmaps``). Any coarser period is the
union of its months' bitmaps (``rolled_up``), without reading a raw row again, and the
bitmaps of a new month are simply added to those stored.

Numbers are dealt without a global order: keys are hashed into ``parts`` parts, numbered
within their part and interleaved, so no task sees more than a part; the ids lie close
together as parts come out even. Keys added later get numbers above the largest known, so
stored bitmaps stay valid. Null keys have no number and are not counted, as in COUNT(DISTINCT).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS_A_PART = 1_000_000


def dense_ids(keys: DataFrame, key: str, known: DataFrame | None = None, keys_a_part: int = KEYS_A_PART) -> DataFrame:
    """(key, id): numbers from 0 for the distinct non-null values of ``key``; with ``known``
    (a result of this function) those keep their numbers and new keys follow after them."""
    new = keys.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    first = 0
    if known is not None:
        new = new.join(known.select("key"), "key", "left_anti")
        top = known.agg(F.max("id").alias("m")).first()["m"]
        first = 0 if top is None else top + 1
    parts = max(1, -(-new.count() // keys_a_part))
    dealt = new.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    fresh = dealt.select("key", (F.lit(first) + place.cast("long") * parts + F.col("part")).alias("id"))
    return fresh if known is None else known.select("key", "id").unionByName(fresh)


def bitmaps(rows: DataFrame, period: list[str], ids: Mapping[str, str]) -> DataFrame:
    """(period columns, what, block, bits) of ``rows``: one bitmap for each period and block of ids, for
    every entry ``what -> id column``.

    Distinct ids meet in their block's task before the bitmap is made: a task that sees some
    of many blocks would otherwise send a bitmap of 4 KB for each of them."""
    longs = rows.select(*period, F.explode(F.array(*[F.struct(F.lit(what).alias("what"), F.col(c).alias("id")) for what, c in ids.items()])).alias("x"))
    seen = longs.select(*period, "x.what", "x.id").where("id IS NOT NULL").distinct()
    group = [*period, "what", "block"]
    return seen.withColumn("block", F.bitmap_bucket_number("id")).repartition(*group).groupBy(*group).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def rolled_up(stored: DataFrame, by: Mapping[str, Column | str]) -> DataFrame:
    """(axes of ``by``, what, n): distinct ids of each coarser period ``by`` (name -> expression over the stored period)."""
    axes = [(F.expr(c) if isinstance(c, str) else c).alias(a) for a, c in by.items()]
    united = stored.groupBy(*axes, "what", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy(*by, "what").agg(F.sum(F.bitmap_count("bits")).alias("n"))
