"""Batch job: load -> quarantine -> data-quality reports -> mart -> reports.

    spark-submit -m tianguis.jobs --landing s3://bucket/landing/2026-12-03 --out s3://bucket/out
    python -m tianguis.jobs --sf-dir /root/testdata/sf0.01 --out /tmp/run-x --reports q01_orders_by_status

Reports are Parquet folders written in overwrite mode, so re-running the job (or a
retried stage after an executor loss) converges to the same result; the mart gets a new
version (``--months`` refreshes only these purchase months), which readers see when it is whole.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from .operators.quality import (domain_report, expected_counts, fk_report, numeric_report,
                                pk_report, row_counts)
from .registry import builders
from .sources import mart as mart_store
from .sources.schemas import FOREIGN_KEYS, NUMERIC_LIMITS, PRIMARY_KEYS, VARCHAR_LIMITS
from .sources.tables import Tables


def write_quality(t: Tables, out: str, checks: dict[str, DataFrame] | None = None,
                  expected: dict[str, int] | None = None) -> None:
    """Keys and references by their reports; counts, widths and number rules as the load
    observed them (``checks``), or by a scan each where there was no load."""
    tabs = t.as_dict()
    checks = checks or {"row_counts": row_counts(tabs), "domain_report": domain_report(tabs, VARCHAR_LIMITS),
                        "numeric_report": numeric_report(tabs, {n: r for n, r in NUMERIC_LIMITS.items() if r})}
    reports = checks | {"pk_report": pk_report(tabs, PRIMARY_KEYS), "fk_report": fk_report(tabs, FOREIGN_KEYS)}
    if expected:
        reports["expected_counts"] = expected_counts(checks["row_counts"].select("tabla", "registros"), expected)
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(os.path.join(out, "quality", name))


def write_reports(t: Tables, out: str, names: list[str] | None = None) -> list[str]:
    """Write each report with its exact types (money and ratios stay DECIMAL;
    the DOUBLE normalisation of ``registry.publish`` is for the engine check only)."""
    registry = builders()
    names = names or list(registry)
    for name in names:
        registry[name](t).write.mode("overwrite").parquet(os.path.join(out, "reports", name))
    return names


def run(spark: SparkSession, out: str, landing: str | None = None, sf_dir: str | None = None,
        reports: list[str] | None = None, mart: bool = True, publish: str | None = None,
        months: list[tuple[int, int]] | None = None,
        expected: dict[str, int] | None = None) -> None:
    checks = None
    if landing:
        from .sources.csv_ingest import load_landing
        land = load_landing(spark, landing, staging=os.path.join(out, "staging"), split=True)
        t, checks = land.tables, land.checks
        for name, bad in land.quarantine.items():
            bad.write.mode("overwrite").parquet(os.path.join(out, "quarantine", name))
    elif sf_dir:
        from .sources.adapter import load_tables
        t = load_tables(spark, sf_dir)
    else:
        raise ValueError("give --landing or --sf-dir")
    write_quality(t, out, checks, expected)
    if mart:
        root = os.path.join(out, "mart")
        version = mart_store.publish(spark, t, root=root, months=months)
        if publish:
            mart_store.register(spark, root, database=publish, version=version)
    write_reports(t, out, reports)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="tianguis.jobs")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--landing", help="folder with the table CSV files")
    src.add_argument("--sf-dir", help="folder with the driver parquet tables")
    ap.add_argument("--out", required=True, help="shared output folder")
    ap.add_argument("--reports", nargs="*", help="report names (default: all)")
    ap.add_argument("--no-mart", action="store_true")
    ap.add_argument("--publish", metavar="DATABASE",
                    help="point views of this catalog database at the new version of the mart")
    ap.add_argument("--months", nargs="*", metavar="YYYY-MM",
                    help="refresh only these purchase months of the mart (0000-00: orders without a date)")
    ap.add_argument("--expected", nargs="*", metavar="TABLE=ROWS", help="expected row counts of the load")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("tianguis").getOrCreate()
    run(spark, a.out, landing=a.landing, sf_dir=a.sf_dir, reports=a.reports, mart=not a.no_mart,
        publish=a.publish, months=[tuple(map(int, m.split("-"))) for m in a.months] if a.months else None,
        expected={k: int(v) for k, v in (x.split("=") for x in a.expected)} if a.expected else None)


if __name__ == "__main__":
    main()
