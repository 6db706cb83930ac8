"""Load the marketplace CSV files with declared schemas (never inferred).

* ``read_csv_table``  - header CSV, UTF-8, RFC-4180 quoting (``"a, b"`` keeps
  its comma, ``""`` is an escaped quote), empty field -> NULL, malformed rows
  kept in a ``_corrupt`` column instead of failing the load (PERMISSIVE).
* ``raw_compat=True`` - quote-unaware comma split like a plain bulk loader:
  quotes stay in the values (clean them with ``strip_quotes``) and rows whose
  embedded commas shift fields are caught by the quarantine.
* ``multiline=True``  - long free-text files whose quoted fields hold newlines
  (the review comments); a trailing ``\\r`` from mixed line endings is trimmed.
* ``split=True``      - the same files read by byte ranges, so that a large one is many tasks.
* ``load_landing``    - all tables of a landing folder -> typed Parquet staging
  tables -> (clean ``Tables``, quarantined rows per table, checks of the load).

Counts, text widths and number rules of a load are observed while the staging table
is written (``DataFrame.observe``): every file is parsed once, and no check scans again.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import QUOTED_COLUMNS, clean_table, replace_commas, rtrim_cr
from .schemas import NUMERIC_LIMITS, SCHEMAS, SOURCE_FILES, VARCHAR_LIMITS
from .tables import Tables

CORRUPT = "_corrupt"
MULTILINE_TABLES = {"order_reviews"}


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])


def read_csv_table(spark: SparkSession, path: str, name: str, raw_compat: bool = False,
                   multiline: bool | None = None, split: bool = False) -> DataFrame:
    """Typed read of one table's CSV (a file, or a folder of files that are read in
    parallel); adds the ``_corrupt`` column. ``split`` reads multi-line files by byte
    ranges (``sources.multiline``), so that a large one is not a single task."""
    schema = SCHEMAS[name]
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if split and not raw_compat:
        from .multiline import read_records
        return rtrim_cr(read_records(spark, path, schema, CORRUPT), strings)
    multiline = (name in MULTILINE_TABLES) if multiline is None else multiline
    reader = (spark.read.schema(_with_corrupt(schema))
              .option("header", True)
              .option("encoding", "UTF-8")
              .option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT)
              .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
              .option("multiLine", multiline))
    if raw_compat:
        reader = reader.option("quote", "\u0000")
    else:
        reader = reader.option("quote", '"').option("escape", '"')
    df = reader.csv(path)
    return rtrim_cr(df, strings) if strings else df


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows without ``_corrupt``, malformed rows).

    Malformed rows keep their partially parsed columns next to the raw line.
    Spark refuses scans that reference only the corrupt-record column, so the
    quarantine is meant to be written (or collected) whole, not counted alone.
    """
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull())
    return good, bad


@dataclass(frozen=True)
class Landing:
    """A load: clean tables, malformed rows, and the checks observed while parsing:
    ``row_counts`` (tabla, registros, cuarentena), ``domain_report`` (tabla, columna, limite,
    valores_excedidos) and ``numeric_report`` (tabla, columna, digitos, decimales, fuera_de_rango,
    exceso_decimales), as the reports of ``operators.quality`` give them by a scan each."""
    tables: Tables
    quarantine: dict[str, DataFrame]
    checks: dict[str, DataFrame]


def observed_metrics(name: str, widths: dict, rules: dict) -> list[Column]:
    """What is observed of a table's well-formed rows, as cleaning will leave them."""
    def cleaned(c: str) -> str:
        quoted = f"replace(`{c}`, '\"', '')" if c in QUOTED_COLUMNS.get(name, []) else f"`{c}`"
        return f"replace({quoted}, ',', ' -')" if c == "geolocation_city" else quoted

    good = f"{CORRUPT} IS NULL"
    out = [f"count_if({good}) AS good", f"count_if(NOT {good}) AS bad"]
    out += [f"count_if({good} AND length({cleaned(c)}) > {n}) AS `w_{c}`" for c, n in widths.get(name, {}).items() if n is not None]
    for c, (p, s) in rules.get(name, {}).items():
        x = f"CAST(`{c}` AS DECIMAL(24, 6))"
        out += [f"count_if({good} AND abs({x}) >= {10 ** (p - s)}) AS `r_{c}`", f"count_if({good} AND {x} <> round({x}, {s})) AS `s_{c}`"]
    return [F.expr(e) for e in out]


def _checks(spark: SparkSession, seen: dict[str, dict], widths: dict, rules: dict) -> dict[str, DataFrame]:
    """The observed numbers as reports; a row for each table or declared column."""
    counts = [(n, m["good"], m["bad"]) for n, m in seen.items()]
    domain = [(n, c, w, m[f"w_{c}"]) for n, m in seen.items() for c, w in widths.get(n, {}).items() if w is not None]
    numeric = [(n, c, *r, m[f"r_{c}"], m[f"s_{c}"]) for n, m in seen.items() for c, r in rules.get(n, {}).items()]
    return {
        "row_counts": spark.createDataFrame(counts, "tabla string, registros long, cuarentena long"),
        "domain_report": spark.createDataFrame(domain, "tabla string, columna string, limite int, valores_excedidos long"),
        "numeric_report": spark.createDataFrame(
            numeric, "tabla string, columna string, digitos int, decimales int, fuera_de_rango long, exceso_decimales long")}


def stage(spark: SparkSession, parsed: DataFrame, path: str, metrics: list[Column] | None = None) -> tuple[DataFrame, dict]:
    """Write the parsed rows (with ``_corrupt``) once as a typed Parquet staging
    table and read it back, with the ``metrics`` observed on the way: later queries get a
    columnar source, any column subset is allowed (a count no longer prunes to the
    corrupt-record column alone), and the lineage back to the CSV parse is cut. The write
    has no shuffle, so a task that is run again is still observed once."""
    if not metrics:
        parsed.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path), {}
    seen = Observation()
    parsed.observe(seen, *metrics).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), seen.get


def _present(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own readers find the path, in whatever store it names."""
    try:
        spark.read.format("binaryFile").load(path).select("path").isEmpty()
        return True
    except AnalysisException as ex:
        if "PATH_NOT_FOUND" in str(ex):
            return False
        raise


def load_landing(spark: SparkSession, folder: str, files: dict[str, str] | None = None,
                 raw_compat: bool = False, staging: str | None = None, split: bool = False,
                 widths: dict | None = None, rules: dict | None = None) -> Landing:
    """Load every table file found in ``folder`` and apply the load-time cleaning:
    literal quotes stripped from id/text columns, geolocation city commas
    rewritten. ``folder`` may be any path or URI that Spark reads; a table is a
    file of its name, or a folder of files. Missing optional files (geolocation)
    are skipped. ``split`` reads multi-line tables by byte ranges. ``widths`` and ``rules``
    are the declared text widths and (digits, decimals) that the checks hold values against.

    Parsed rows are staged as Parquet in a folder of this load's own under
    ``staging`` (default: the shared folder named by ``spark.checkpoint.dir``), so
    an earlier load keeps its rows."""
    import uuid

    from ..session import shared_dir
    files = files or SOURCE_FILES
    widths, rules = VARCHAR_LIMITS if widths is None else widths, NUMERIC_LIMITS if rules is None else rules
    staging = os.path.join(staging or shared_dir(spark, "staging"), uuid.uuid4().hex)
    clean, quarantine, seen = {}, {}, {}
    for name, fname in files.items():
        path = os.path.join(folder, fname)
        if not _present(spark, path):
            continue
        parsed = read_csv_table(spark, path, name, raw_compat=raw_compat, split=split and name in MULTILINE_TABLES)
        staged, seen[name] = stage(spark, parsed, os.path.join(staging, name), observed_metrics(name, widths, rules))
        good, bad = split_quarantine(staged)
        good = clean_table(name, good)
        if name == "geolocation":
            good = replace_commas(good, "geolocation_city")
        clean[name] = good
        quarantine[name] = bad
    missing = [n for n in Tables.__dataclass_fields__ if n != "geolocation" and n not in clean]
    if missing:
        raise FileNotFoundError(f"landing folder {folder} lacks tables: {missing}")
    return Landing(Tables(**clean), quarantine, _checks(spark, seen, widths, rules))


def stage_and_insert(staging: DataFrame, target_columns: list[str], schema: T.StructType,
                     target: DataFrame | None = None) -> DataFrame:
    """``INSERT INTO t (cols) SELECT cols FROM staging`` with casts to the target types:
    the rows of ``target`` (if given) and the new ones, columns not named being null."""
    types = {f.name: f.dataType for f in schema.fields}
    new = staging.select(*[F.col(c).cast(types[c]).alias(c) for c in target_columns])
    return new if target is None else target.unionByName(new, allowMissingColumns=True)
