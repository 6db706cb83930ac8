"""The published star schema as a versioned store (S8) with catalog views (S7).

A publish writes only what it refreshes: the facts of the named purchase months (all
months by default) and the dimensions, each into a folder of its own load. What belongs
together is then written as one small manifest, the last step of a publish:

    <root>/<table>/load=<id>/[purchase_year=Y/purchase_month=M/]part-*.parquet
    <root>/_versions/version=<n>/part-*.parquet      (table, month, folder, buckets)

A version lists, for every fact and month, the folder of the load that wrote it last. A
reader opens one version and keeps it: files are never changed, so a publish neither
disturbs readers nor leaves anything half done - one that fails (or is retried after a
lost executor) has no manifest, and the version before stays the newest.

Facts are partitioned by purchase year and month and, within a month, bucketed and sorted
by ``order_id``: order-grain aggregates and joins of facts on the order read co-located
buckets and need no exchange. A bucket is read by one task, so their number should follow
the rows (``fitting_buckets``), and they are only used where they come out even
(``even_buckets``): facts with an order that holds a large share of all rows are laid out
by range instead, many files a month. Results are the same. Where there are at least as many
buckets as the session's shuffle partitions, the base relations are dealt into the buckets
before they are joined, and the wide facts are not exchanged again.

``register`` declares a version's tables in the session catalog and points the views
``<database>.<table>``, with their columns fixed, at them in one statement each: a reader by
name sees the old version or the new one, never nothing.

Orders without a purchase date are kept in month (0, 0). A publish of some months expects
``Tables`` that hold these months whole; an order that changed its month needs both.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import key_side
from ..plans.star import STAR_BUILDERS
from ..session import shared_dir
from .tables import Tables

CHILDREN = {"fact_order_items": "order_items", "fact_order_payments": "order_payments", "fact_order_reviews": "order_reviews"}
FACTS = tuple(CHILDREN)
KEY = "order_id"
MONTH = ["purchase_year", "purchase_month"]
MANIFEST = "_versions"
_MANIFEST_SCHEMA = "name string, purchase_year int, purchase_month int, path string, buckets int"
EVEN = 4  # a bucket may hold so many times the mean
ROWS_A_BUCKET = 1_000_000  # of the largest fact, all months together


def _fact(name: str, t: Tables) -> DataFrame:
    return STAR_BUILDERS[name](t).withColumns({
        "purchase_year": F.coalesce(F.year("purchase_date"), F.lit(0)),
        "purchase_month": F.coalesce(F.month("purchase_date"), F.lit(0))})


def in_months(column: str, months: Iterable[tuple[int, int]]):
    """Condition: the instant lies in one of the (year, month) pairs; ranges, so that it reaches the scan.
    (0, 0) stands for no date."""
    arms = []
    for y, m in months:
        if (y, m) == (0, 0):
            arms.append(f"{column} IS NULL")
            continue
        to = (y + m // 12, m % 12 + 1)
        arms.append(f"({column} >= TIMESTAMP_NTZ '{y:04d}-{m:02d}-01 00:00:00' AND {column} < TIMESTAMP_NTZ '{to[0]:04d}-{to[1]:02d}-01 00:00:00')")
    return F.expr(" OR ".join(arms) if arms else "false")


def even_buckets(df: DataFrame, buckets: int) -> bool:
    """Whether hashing by order spreads the rows: no bucket has over EVEN times the mean."""
    per = df.groupBy(F.pmod(F.hash(KEY), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    r = per.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    return not r["rows"] or r["most"] * buckets <= EVEN * r["rows"] or r["rows"] < 1000 * buckets


def fitting_buckets(t: Tables, least: int = 2) -> int:
    """Buckets for ``publish``, ``least`` or more: as many as keep a bucket of all months near ROWS_A_BUCKET rows."""
    rows = max(getattr(t, name).count() for name in ("orders", *CHILDREN.values()))
    return max(least, -(-rows // ROWS_A_BUCKET))


def _of_orders(t: Tables) -> Tables:
    """``t`` with only those items, payments and reviews whose order it has."""
    ids = key_side(t.orders.select(KEY).distinct())
    return replace(t, **{child: getattr(t, child).join(ids, KEY, "left_semi") for child in CHILDREN.values()})


def _dealt(t: Tables, buckets: int) -> Tables:
    """``t`` with the relations of the facts exchanged once by order, a partition for each bucket."""
    return replace(t, **{name: getattr(t, name).repartition(buckets, KEY) for name in ("orders", *CHILDREN.values())})


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, in order."""
    try:
        found = spark.read.schema(f"{_MANIFEST_SCHEMA}, version long").parquet(os.path.join(root, MANIFEST))
    except AnalysisException as ex:
        if "PATH_NOT_FOUND" in str(ex):
            return []
        raise
    return sorted(r["version"] for r in found.select("version").distinct().collect())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> list[Row]:
    """What a version (default: the newest) consists of; a row for each dimension and each fact's month."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return []
        version = known[-1]
    return spark.read.schema(_MANIFEST_SCHEMA).parquet(os.path.join(root, MANIFEST, f"version={version}")).collect()


def _write_fact(spark: SparkSession, df: DataFrame, path: str, buckets: int, dealt: bool) -> None:
    if not buckets:
        keys = [*MONTH, KEY]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy(*MONTH).parquet(path)
        return
    # bucketed files are written through a table of this load's own, in the store's folder; dropping
    # the external table leaves the files
    database = "tianguis_loads"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{shared_dir(spark, database + '.db')}'")
    table = f"{database}.load_{uuid.uuid4().hex}"
    placed = df if dealt else df.hint("rebalance", buckets, KEY)
    (placed.write.format("parquet").partitionBy(*MONTH).bucketBy(buckets, KEY).sortBy(KEY)
     .option("path", path).saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")


def publish(spark: SparkSession, t: Tables, root: str | None = None, months: Sequence[tuple[int, int]] | None = None,
            buckets: int = 16) -> int:
    """Write the facts of ``months`` (default: all) and the dimensions as a new version; returns its number.

    Months of the version before that are not named keep their files; a named month without
    orders is taken out. ``buckets`` per month, 0 for a layout by range."""
    root = root or shared_dir(spark, "mart")
    known = versions(spark, root)
    before = manifest(spark, root, known[-1]) if known else []
    part = t if months is None else _of_orders(replace(t, orders=t.orders.where(in_months("order_purchase_timestamp", months))))
    # with fewer buckets than shuffle partitions a join would spread each bucket over many tasks, and files
    deal = buckets >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    load = uuid.uuid4().hex
    rows = []
    for name, build in STAR_BUILDERS.items():
        path = os.path.join(root, name, f"load={load}")
        if name not in FACTS:
            build(t).write.parquet(path)
            rows.append((name, None, None, path, 0))
            continue
        # a fact has an order's child rows, or one; counted before the join, which needs no exchange
        keys = getattr(part, CHILDREN[name]).select(KEY).unionByName(part.orders.select(KEY))
        n = buckets if buckets and even_buckets(keys, buckets) else 0
        df = _fact(name, _dealt(part, n) if n and deal else part)
        _write_fact(spark, df, path, n, deal)
        written = spark.read.schema(df.schema).parquet(path).select(*MONTH).distinct().collect()  # folder names only
        rows += [(name, r["purchase_year"], r["purchase_month"], _month_path(path, r), n) for r in written]
        if months is not None:
            touched = set(months)
            rows += [(name, r["purchase_year"], r["purchase_month"], r["path"], r["buckets"]) for r in before
                     if r["name"] == name and (r["purchase_year"], r["purchase_month"]) not in touched]
    version = (known[-1] if known else 0) + 1
    # one file, renamed into place by its commit; an existing folder means that another publish was first
    spark.createDataFrame(rows, _MANIFEST_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(
        os.path.join(root, MANIFEST, f"version={version}"))
    return version


def _month_path(path: str, r: Row) -> str:
    return os.path.join(path, f"purchase_year={r['purchase_year']}", f"purchase_month={r['purchase_month']}")


def database_of(root: str) -> str:
    return "mart_" + hashlib.sha256(root.encode()).hexdigest()[:10]


def register(spark: SparkSession, root: str, database: str | None = None, version: int | None = None) -> list[str]:
    """Declare a version's tables (``<table>__v<n>``) and turn the views ``<database>.<table>`` to
    them; returns the views' names. Views outlive the session that made them, as far as the
    catalog does, and any session of it reads them."""
    version = version if version is not None else versions(spark, root)[-1]
    database = database or database_of(root)
    rows = manifest(spark, root, version)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{shared_dir(spark, database + '.db')}'")
    names = []
    for name in STAR_BUILDERS:
        parts = [r for r in rows if r["name"] == name]
        if not parts:
            continue
        table = f"`{database}`.`{name}__v{version}`"
        if not spark.catalog.tableExists(f"{database}.{name}__v{version}"):
            _declare(spark, table, name, parts, os.path.join(root, name, "none"))
        columns = ", ".join(f"`{c}`" for c in spark.table(table).columns)
        spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` ({columns}) AS SELECT {columns} FROM {table}")
        names.append(f"{database}.{name}")
    return names


def _declare(spark: SparkSession, table: str, name: str, parts: list[Row], nowhere: str) -> None:
    schema = spark.read.parquet(parts[0]["path"]).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in MONTH)
    if name not in FACTS:
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{parts[0]['path']}'")
        return
    n = {r["buckets"] for r in parts}
    layout = f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {min(n)} BUCKETS" if len(n) == 1 and min(n) else ""
    spark.sql(f"CREATE TABLE {table} ({columns}, purchase_year INT, purchase_month INT) USING parquet "
              f"PARTITIONED BY (purchase_year, purchase_month) {layout} LOCATION '{nowhere}'")
    spark.sql(f"ALTER TABLE {table} ADD " + " ".join(
        f"PARTITION (purchase_year = {r['purchase_year']}, purchase_month = {r['purchase_month']}) LOCATION '{r['path']}'" for r in parts))


def open_mart(spark: SparkSession, root: str, version: int | None = None, database: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version (default: the newest) as DataFrames; stays on it whatever is published later."""
    version = version if version is not None else versions(spark, root)[-1]
    database = database or database_of(root)
    register(spark, root, database, version)
    return {name: spark.table(f"{database}.{name}__v{version}") for name in STAR_BUILDERS
            if spark.catalog.tableExists(f"{database}.{name}__v{version}")}


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove versions but the newest ``keep``, and the loads' folders only they used. Readers of
    the removed versions lose their files."""
    known = versions(spark, root)
    gone, kept = known[:-keep], known[-keep:]
    used = {r["path"].split("/load=")[0] + "/load=" + r["path"].split("/load=")[1].split("/")[0]
            for v in kept for r in manifest(spark, root, v)}
    old = {r["path"].split("/load=")[0] + "/load=" + r["path"].split("/load=")[1].split("/")[0]
           for v in gone for r in manifest(spark, root, v)}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in sorted(old - used) + [os.path.join(root, MANIFEST, f"version={v}") for v in gone]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return gone
