"""Data-quality checks (keys, references, domains, counts) as distributed reports.

Every check is an aggregate whose output is bounded by the number of tables,
columns or violating keys - never by the data volume - and every one
pre-aggregates before it shuffles: key multiplicities are counted with partial
aggregation, so a hot key collapses to one row per map task before any join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pk_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their multiplicity ``n``."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def pk_report(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per table: rows, duplicated key values and rows with a NULL key part."""
    parts = []
    for name, key in keys.items():
        if name not in tables:
            continue
        counted = tables[name].groupBy(*key).agg(F.expr("count(1) AS n"))
        any_null = " OR ".join(f"`{k}` IS NULL" for k in key)
        # a select holding only aggregates and literals is one global aggregate
        parts.append(counted.selectExpr(
            f"'{name}' AS tabla", f"'{', '.join(key)}' AS clave",
            "coalesce(sum(n), 0) AS filas",
            "count_if(n > 1) AS claves_duplicadas",
            f"coalesce(sum(CASE WHEN {any_null} THEN n ELSE 0 END), 0) AS claves_nulas"))
    return _union(parts)


def orphan_rows(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent, counted per key first."""
    per_key = (child.selectExpr(f"`{child_col}` AS _k").where("_k IS NOT NULL")
               .groupBy("_k").agg(F.expr("count(1) AS n")))
    keys = parent.selectExpr(f"`{parent_col}` AS _k").distinct()
    return per_key.join(keys, "_k", "left_anti")


def fk_report(tables: Mapping[str, DataFrame],
              edges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Per foreign-key edge: child rows referencing a missing parent."""
    parts = []
    for child, ccol, parent, pcol in edges:
        if child not in tables or parent not in tables:
            continue
        o = orphan_rows(tables[child], ccol, tables[parent], pcol)
        parts.append(o.selectExpr(f"'{child}' AS hijo", f"'{ccol}' AS columna",
                                  f"'{parent}' AS padre",
                                  "CAST(coalesce(sum(n), 0) AS BIGINT) AS filas_huerfanas"))
    return _union(parts)


def domain_report(tables: Mapping[str, DataFrame],
                  limits: Mapping[str, Mapping[str, int | None]]) -> DataFrame:
    """Per text column with a declared width: values longer than the width."""
    parts = []
    for name, cols in limits.items():
        if name not in tables:
            continue
        df = tables[name]
        bounded = [(c, n) for c, n in cols.items() if n is not None and c in df.columns]
        if not bounded:
            continue
        # one pass per table; the per-column counts are unpivoted with stack()
        agg = df.selectExpr(*[f"count_if(length(`{c}`) > {n}) AS `{c}`" for c, n in bounded])
        stack = ", ".join(f"'{c}', {n}, `{c}`" for c, n in bounded)
        parts.append(agg.selectExpr(
            f"'{name}' AS tabla",
            f"stack({len(bounded)}, {stack}) AS (columna, limite, valores_excedidos)"))
    return _union(parts)


def numeric_report(tables: Mapping[str, DataFrame],
                   rules: Mapping[str, Mapping[str, tuple[int, int]]]) -> DataFrame:
    """Per number column with a declared DECIMAL(p, s) (INT: s = 0): values too large for
    it and values with more decimals than it keeps. One pass per table."""
    parts = []
    for name, cols in rules.items():
        if name not in tables:
            continue
        exact = {c: f"CAST(`{c}` AS DECIMAL(24, 6))" for c in cols}
        agg = tables[name].selectExpr(
            *[f"count_if(abs({exact[c]}) >= {10 ** (p - s)}) AS `{c}_r`" for c, (p, s) in cols.items()],
            *[f"count_if({exact[c]} <> round({exact[c]}, {s})) AS `{c}_s`" for c, (p, s) in cols.items()])
        stack = ", ".join(f"'{c}', {p}, {s}, `{c}_r`, `{c}_s`" for c, (p, s) in cols.items())
        parts.append(agg.selectExpr(
            f"'{name}' AS tabla",
            f"stack({len(cols)}, {stack}) AS (columna, digitos, decimales, fuera_de_rango, exceso_decimales)"))
    return _union(parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``SELECT 'name', COUNT(*) ... UNION ALL`` over all tables."""
    return _union([df.selectExpr(f"'{name}' AS tabla", "count(1) AS registros")
                   for name, df in tables.items()])


def row_count_check(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Row counts next to the expected counts of the load verification box."""
    return expected_counts(row_counts(tables), expected)


def expected_counts(counts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """(tabla, registros) of a report or a load next to the expected counts."""
    exp = counts.sparkSession.createDataFrame(
        [(k, int(v)) for k, v in expected.items()], "tabla string, esperado long")
    return (counts.join(exp, "tabla", "full")
            .withColumn("coincide", F.coalesce(F.col("registros") == F.col("esperado"), F.lit(False))))


def untranslated_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Categories used by products but absent from the translation table."""
    cats = (products.select("product_category_name")
            .where(F.col("product_category_name").isNotNull()).distinct())
    return cats.join(translation.select("product_category_name"), "product_category_name",
                     "left_anti")


def comma_report(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose text holds embedded commas (the rows a comma-split load breaks)."""
    c = F.col(column)
    return (df.where(F.contains(c, F.lit(",")))
            .select(key, (F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))))
                    .alias("n_comas")))
