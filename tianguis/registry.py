"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every registered query reads the driver tables of ``sf_dir`` through the
adapter and runs over whole tables. ``publish`` only normalises output types
for the cross-engine check (integers -> BIGINT, decimals -> DOUBLE after their
single exact rounding); it never changes a value beyond that cast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .plans.dashboard import DASHBOARD
from .plans.eda import EDA
from .plans.mart_reports import MART_REPORTS
from .plans.measures import MEASURES
from .plans.quality_reports import MODEL_REPORTS, RAW_REPORTS
from .plans.findings import FINDINGS
from .plans.star import STAR_BUILDERS
from .sources.adapter import load_tables
from .sources.tables import Tables

_INTS = (T.ByteType, T.ShortType, T.IntegerType)


def publish(df: DataFrame) -> DataFrame:
    """Integers -> BIGINT, decimals -> DOUBLE (after their one exact rounding)."""
    cols = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, _INTS):
            cols.append(f"CAST({name} AS BIGINT) AS {name}")
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(f"CAST({name} AS DOUBLE) AS {name}")
        else:
            cols.append(name)
    return df.selectExpr(*cols)


_TABLES: dict[tuple[object, str], Tables] = {}


def _session_key(spark: SparkSession) -> object:
    """Identity of a live session: a restarted session never reuses cached plans."""
    sid = getattr(spark, "session_id", None)  # Spark Connect
    if sid:
        return ("connect", sid)
    return ("classic", spark.sparkContext.applicationId, id(spark))


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """The adapted relations of ``sf_dir``, defined once per session.

    Only the lazy plans are reused (file listing and schema resolution happen
    once); no data is cached, every query still scans the parquet files.
    """
    key = (_session_key(spark), sf_dir)
    if key not in _TABLES:
        _TABLES[key] = load_tables(spark, sf_dir)
    return _TABLES[key]


def _table_query(builder: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return publish(builder(tables_for(spark, sf_dir)))
    run.__name__ = getattr(builder, "__name__", "query")
    run.__doc__ = builder.__doc__
    return run


def _raw_query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return publish(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def builders() -> dict[str, Callable[[Tables], DataFrame]]:
    out: dict[str, Callable[[Tables], DataFrame]] = {}
    out.update(STAR_BUILDERS)
    out.update(EDA)
    out.update(FINDINGS)
    out.update(MEASURES)
    out.update(DASHBOARD)
    out.update(MODEL_REPORTS)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _table_query(b) for name, b in builders().items()}
    for name, fn in (RAW_REPORTS | MART_REPORTS).items():
        out[name] = _raw_query(fn)
    return out


def oracle_sql() -> dict[str, str]:
    from .oracle.queries import all_sql
    return all_sql()
