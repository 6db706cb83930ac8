"""Stored tables with copy-on-write changes: UPDATE, INSERT and INSERT ... SELECT (C1, S2, S5).

A stored table is a folder of Parquet files that are never changed, and of versions that list
the files of the table:

    <root>/data/load=<id>/part-*.parquet
    <root>/_versions/version=<n>/part-*.parquet      (file, operation)

A change writes new files, then its version, as the last step. ``update`` finds the files
that hold a changed row (``_metadata.file_path``) and rewrites only those; ``insert`` adds
files. Readers of a version are not disturbed; a change that fails, or whose tasks are
retried, leaves no version. Changes can be replayed: an update that changes no row and an
insert whose keys are all there make no version, and an insert without a key carries the
name of its operation, which is refused a second time.

The lists of files go through the driver, as Spark's readers take paths.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "file string, operation string"


def _folder(root: str, version: int) -> str:
    return os.path.join(root, "_versions", f"version={version}")


def versions(spark: SparkSession, root: str) -> list[int]:
    try:
        found = spark.read.schema(f"{_SCHEMA}, version long").parquet(os.path.join(root, "_versions"))
    except AnalysisException as ex:
        if "PATH_NOT_FOUND" in str(ex):
            return []
        raise
    return sorted(r["version"] for r in found.select("version").distinct().collect())


def _listed(spark: SparkSession, root: str, version: int | None) -> tuple[int, list[str], set[str]]:
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no stored table at {root}")
    version = known[-1] if version is None else version
    rows = spark.read.schema(_SCHEMA).parquet(_folder(root, version)).collect()
    return version, [r["file"] for r in rows if r["file"]], {r["operation"] for r in rows if r["operation"]}


def _commit(spark: SparkSession, root: str, version: int, files: Sequence[str], operations: set[str]) -> int:
    # a row of nulls first: a table without files has a version too
    rows = [(None, None)] + [(f, None) for f in files] + [(None, o) for o in sorted(operations)]
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("errorifexists").parquet(_folder(root, version))
    return version


def _write(df: DataFrame, root: str) -> list[str]:
    """Write rows as files of a load of their own; the files that hold any."""
    path = os.path.join(root, "data", f"load={uuid.uuid4().hex}")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return [r["file"] for r in back.select(F.col("_metadata.file_path").alias("file")).distinct().collect()]


def create(df: DataFrame, root: str) -> int:
    """Store ``df`` as version 1 of a table."""
    path = os.path.join(root, "data", "schema")
    df.limit(0).write.parquet(path)
    return _commit(df.sparkSession, root, 1, _write(df, root), set())


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table at a version (default: the newest)."""
    _, files, _ = _listed(spark, root, version)
    schema = spark.read.parquet(os.path.join(root, "data", "schema")).schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def update(spark: SparkSession, root: str, values: Mapping[str, Column], where: Column | None = None) -> int:
    """``UPDATE t SET column = value, ... WHERE ...``; returns the version that holds the result.

    Only files with a row whose value differs are rewritten; where there is none, the
    version stays."""
    version, files, operations = _listed(spark, root, None)
    table = read(spark, root, version)
    touched = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    differs = F.lit(False)
    new = {}
    for column, value in values.items():
        value = value.cast(table.schema[column].dataType)
        differs = differs | ~F.col(column).eqNullSafe(value)
        new[column] = F.when(touched, value).otherwise(F.col(column))
    hit = [r["file"] for r in table.where(touched & differs).select(F.col("_metadata.file_path").alias("file")).distinct().collect()]
    if not hit:
        return version
    changed = set(hit)
    written = _write(spark.read.schema(table.schema).parquet(*hit).withColumns(new), root)
    return _commit(spark, root, version + 1, [f for f in files if f not in changed] + written, operations)


def insert(rows: DataFrame, root: str, columns: Sequence[str] | None = None, key: Sequence[str] | None = None,
           operation: str | None = None) -> int:
    """``INSERT INTO t (columns) SELECT columns FROM rows``, cast to the table's types, columns not
    named being null; returns the version that holds the result.

    With ``key`` only rows whose key is not there yet are inserted (one of those that share a
    new key). Without it the ``operation`` must be named, and a second run of it does nothing."""
    spark = rows.sparkSession
    version, files, operations = _listed(spark, root, None)
    if (key is None) == (operation is None):
        raise ValueError("an insert needs either a key or the name of its operation")
    if operation in operations:
        return version
    table = read(spark, root, version)
    columns = list(columns or table.columns)
    new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in table.schema])
    if key is not None:
        new = new.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti").select(*table.columns)
    written = _write(new, root)
    if not written and operation is None:
        return version
    return _commit(spark, root, version + 1, files + written, operations | ({operation} if operation else set()))
