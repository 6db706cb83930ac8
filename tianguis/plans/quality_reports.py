"""Registered cleaning and data-quality reports (C1-C9) and the features the
report lists without an instance (P14 semi join, W5 ROW_NUMBER/COUNT OVER,
F9 GREATEST).

C1, C2, C4 and C5a run on raw driver tables that carry the relevant defects
(literal quotes in ``events.props``, commas in ``documents.text``, repeated
line keys in ``lineitem``); the others run on the adapted marketplace model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import replace_commas, strip_quotes
from ..operators.quality import (comma_report, domain_report, fk_report, numeric_report,
                                 pk_report, pk_violations, row_count_check, row_counts,
                                 untranslated_categories)
from ..sources import stored
from ..sources.adapter import load_tables, order_payments, read_driver
from ..sources.csv_ingest import load_landing, read_csv_table, split_quarantine, stage
from ..sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, SOURCE_FILES, VARCHAR_LIMITS
from ..sources.sinks import write_csv
from ..session import shared_dir
from ..sources.tables import Tables
from .common import order_logistics
from .measures import monthly_revenue_calendar


def c1_strip_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_driver(spark, sf_dir, "events").select("event_id", "props")
    return strip_quotes(ev, ["props"])


def c2_replace_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_driver(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_commas(docs, "text")


def c4_offending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_driver(spark, sf_dir, "documents")
    return comma_report(docs, "doc_id", "text")


def c5a_pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_driver(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("line_number"))
    return pk_violations(li, ["order_id", "line_number"])


def c5_pk_report(t: Tables) -> DataFrame:
    return pk_report(t.as_dict(), PRIMARY_KEYS)


def c5b_fk_orphans(t: Tables) -> DataFrame:
    return fk_report(t.as_dict(), FOREIGN_KEYS)


def c5b_label_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that do find orphans: documents without a label row and the reverse."""
    t = {n: read_driver(spark, sf_dir, n) for n in ("documents", "labels", "pages")}
    return fk_report(t, LABEL_EDGES)


def c6_text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: read_driver(spark, sf_dir, n) for n in RAW_WIDTHS}
    return domain_report(t, RAW_WIDTHS)


def c6_numeric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DECIMAL(p, s) and INT rules on raw numbers; the narrow ones find values."""
    t = {n: read_driver(spark, sf_dir, n) for n in NUMERIC_RULES}
    return numeric_report(t, NUMERIC_RULES)


def c7_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts next to the expected ones; a missing or surplus row shows."""
    t = {n: read_driver(spark, sf_dir, n) for n in EXPECTED_COUNTS}
    return row_count_check(t, EXPECTED_COUNTS)


def s1_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments written as header CSV into the shared folder and loaded again with the
    declared schema: the sink and the bulk load in one query."""
    import uuid

    schema = SCHEMAS["order_payments"]
    path = shared_dir(spark, f"csv/order_payments-{uuid.uuid4().hex}")
    write_csv(order_payments(read_driver(spark, sf_dir, "orders")).select(*schema.names), path)
    return read_csv_table(spark, path, "order_payments").drop("_corrupt")


def s1b_raw_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers loaded without regard to quotes: rows whose city holds a comma go to quarantine
    with their raw line, the others lose their literal quotes."""
    import uuid

    key = F.col("s_suppkey")
    city = F.when(key % SELLERS_WITH_COMMA == 0, F.concat(F.lower("s_name"), F.lit(", norte"))).otherwise(F.lower("s_name"))
    rows = read_driver(spark, sf_dir, "supplier").select(
        key.cast("string").alias("seller_id"), F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"),
        city.alias("seller_city"), F.lit("XX").alias("seller_state"))
    root = shared_dir(spark, f"csv/sellers-{uuid.uuid4().hex}")
    write_csv(rows, f"{root}/in", quote_all=True)
    staged, _ = stage(spark, read_csv_table(spark, f"{root}/in", "sellers", raw_compat=True), f"{root}/staged")
    good, bad = split_quarantine(staged)
    good = strip_quotes(good, ["seller_id", "seller_city"])
    return (good.select(F.lit("tabla").alias("destino"), F.col("seller_id").alias("clave"), "seller_city")
            .unionByName(bad.select(F.lit("cuarentena").alias("destino"), F.col("_corrupt").alias("clave"),
                                    F.lit(None).cast("string").alias("seller_city"))))


def s2_multiline_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, quotes and commas as a review file: read by byte ranges into a staging
    relation, its seven columns inserted into a stored table, twice by the same name."""
    import uuid

    docs = read_driver(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("order_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("review_score"),
        F.col("lang").alias("review_comment_title"), F.col("text").alias("review_comment_message"),
        F.lit("2020-01-01 00:00:00").alias("review_creation_date"), F.lit(None).cast("string").alias("review_answer_timestamp"))
    root = shared_dir(spark, f"csv/reviews-{uuid.uuid4().hex}")
    write_csv(docs, f"{root}/in")
    schema = SCHEMAS["order_reviews"]
    good, _ = split_quarantine(read_csv_table(spark, f"{root}/in", "order_reviews", split=True))
    stored.create(spark.createDataFrame([], schema), f"{root}/table")
    for _ in range(2):
        stored.insert(good, f"{root}/table", schema.names, operation="reviews")
    return stored.read(spark, f"{root}/table").select(
        "review_id", "order_id", "review_score", "review_comment_title", F.length("review_comment_message").alias("largo"),
        F.md5("review_comment_message").alias("md5"))


def c1_stored_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal quotes stripped in a stored table by copy-on-write; the second run finds nothing to do."""
    import uuid

    root = shared_dir(spark, f"stored/events-{uuid.uuid4().hex}")
    stored.create(read_driver(spark, sf_dir, "events").select("event_id", "props"), root)
    for _ in range(2):
        stored.update(spark, root, {"props": F.replace(F.col("props"), F.lit('"'), F.lit(""))})
    return stored.read(spark, root)


def c6_load_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, widths and number rules of a landing load, observed while its files are parsed."""
    import uuid

    root = shared_dir(spark, f"landing-{uuid.uuid4().hex}")
    for name, df in load_tables(spark, sf_dir).as_dict().items():
        write_csv(df.select(*SCHEMAS[name].names), f"{root}/{SOURCE_FILES[name]}")
    checks = load_landing(spark, root, staging=f"{root}/staging", split=True, widths=LOAD_WIDTHS, rules=LOAD_RULES).checks
    counts = checks["row_counts"].selectExpr(
        "tabla", "stack(2, 'registros', registros, 'cuarentena', cuarentena) AS (regla, valor)").withColumn("columna", F.lit(""))
    widths = checks["domain_report"].selectExpr("tabla", "'ancho' AS regla", "columna", "valores_excedidos AS valor")
    numbers = checks["numeric_report"].selectExpr(
        "tabla", "columna", "stack(2, 'rango', fuera_de_rango, 'decimales', exceso_decimales) AS (regla, valor)")
    return counts.unionByName(widths).unionByName(numbers)


def c6_domain_violations(t: Tables) -> DataFrame:
    return domain_report(t.as_dict(), VARCHAR_LIMITS)


def c7_row_counts(t: Tables) -> DataFrame:
    return row_counts(t.as_dict())


def c8_untranslated(t: Tables) -> DataFrame:
    return untranslated_categories(t.products, t.category_translation)


def c9_orders_without_items(t: Tables) -> DataFrame:
    """Incomplete orders the star schema keeps (LEFT JOIN) instead of dropping."""
    keys = t.order_items.select("order_id").distinct()
    return t.orders.select("order_id", "order_status").join(keys, "order_id", "left_anti")


def p14_customers_with_late_orders(t: Tables) -> DataFrame:
    """``WHERE customer_id IN (SELECT customer_id FROM orders WHERE late)`` as a
    left semi join. The subquery side is made distinct first (partial aggregates): a
    semi join's right side is never split, so it must not carry a hot customer's rows."""
    late = order_logistics(t).where(F.col("late")).select("customer_id").distinct()
    return t.customers.join(late, "customer_id", "left_semi")


def w5_month_rank(t: Tables) -> DataFrame:
    """ROW_NUMBER and COUNT() OVER: months ranked by revenue inside each year.
    Windows run on calendar-month rows, so every partition holds at most 12 rows."""
    m = monthly_revenue_calendar(t)
    w = Window.partitionBy("anio").orderBy(F.desc_nulls_last("ingreso"), "mes")
    return m.select("anio", "mes", "ingreso",
                    F.row_number().over(w).alias("posicion"),
                    F.count(F.lit(1)).over(Window.partitionBy("anio")).alias("meses_en_anio"))


def f9_latest_milestone(t: Tables) -> DataFrame:
    """GREATEST of the order milestones (NULL milestones are skipped)."""
    o = t.orders
    return o.select("order_id", F.greatest("order_purchase_timestamp", "order_approved_at",
                                           "order_delivered_carrier_date",
                                           "order_delivered_customer_date")
                    .alias("ultimo_hito"))


# The slicer selection of the registered P15 instance.
SLICER_STATES = ["NATION_1", "NATION_7", "NATION_13"]


def p15_state_slicer(t: Tables) -> DataFrame:
    from .dashboard import v11_late_rate_by_state
    return v11_late_rate_by_state(t, states=SLICER_STATES)


def p15_kpis_state_slicer(t: Tables) -> DataFrame:
    """The overview KPI strip (V1) under the state slicer: the filter on the
    customer dimension reaches orders, items and reviews (filter context)."""
    from .context import filter_context
    from .dashboard import v01_kpis_overview
    return v01_kpis_overview(filter_context(t, customers=F.col("customer_state").isin(SLICER_STATES)))


def p15_category_slicer(t: Tables) -> DataFrame:
    """A product slicer reaches the item fact alone: revenue shrinks, payments do not."""
    from .context import filter_context
    from .measures import m06_total_revenue, m12_payments
    s = filter_context(t, products=F.col("product_category_name") == SLICER_CATEGORY)
    both = m06_total_revenue(s).unionByName(m12_payments(s).drop("pago_promedio"), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# Instances on the raw tables that have something to find.
SLICER_CATEGORY = "brand#13"
LABEL_EDGES = [("documents", "doc_id", "labels", "doc_id"), ("labels", "doc_id", "documents", "doc_id"),
               ("pages", "page_id", "labels", "doc_id")]
RAW_WIDTHS = {"documents": {"text": 4000, "lang": 2}, "benchmark": {"text": 200}, "conversations": {"role": 4, "text": 255}}
NUMERIC_RULES = {"lineitem": {"l_extendedprice": (6, 2), "l_quantity": (1, 0), "l_discount": (3, 1)},
                 "orders": {"o_totalprice": (10, 2), "o_orderkey": (4, 0)}}
SELLERS_WITH_COMMA = 7
LOAD_WIDTHS = {"customers": {"customer_city": 9, "customer_state": 8}, "orders": {"order_status": 9}, "sellers": {"seller_zip_code_prefix": 4}}
LOAD_RULES = {"order_items": {"price": (6, 2), "freight_value": (10, 1), "order_item_id": (1, 0)}, "order_payments": {"payment_value": (7, 2)}}
EXPECTED_COUNTS = {"region": 5, "nation": 25, "supplier": 100, "customer": 1000, "benchmark": 40}

RAW_REPORTS = {
    "s1b_raw_split": s1b_raw_split,
    "s2_multiline_insert": s2_multiline_insert,
    "c1_stored_update": c1_stored_update,
    "c6_load_checks": c6_load_checks,
    "c5b_label_orphans": c5b_label_orphans,
    "c6_text_widths": c6_text_widths,
    "c6_numeric_rules": c6_numeric_rules,
    "c7_expected_counts": c7_expected_counts,
    "s1_csv_round_trip": s1_csv_round_trip,
    "c1_strip_quotes": c1_strip_quotes,
    "c2_replace_commas": c2_replace_commas,
    "c4_offending_rows": c4_offending_rows,
    "c5a_pk_violations": c5a_pk_violations,
}

MODEL_REPORTS = {
    "c5_pk_report": c5_pk_report,
    "c5b_fk_orphans": c5b_fk_orphans,
    "c6_domain_violations": c6_domain_violations,
    "c7_row_counts": c7_row_counts,
    "c8_untranslated": c8_untranslated,
    "c9_orders_without_items": c9_orders_without_items,
    "p14_customers_with_late_orders": p14_customers_with_late_orders,
    "p15_state_slicer": p15_state_slicer,
    "p15_kpis_state_slicer": p15_kpis_state_slicer,
    "p15_category_slicer": p15_category_slicer,
    "w5_month_rank": w5_month_rank,
    "f9_latest_milestone": f9_latest_milestone,
}
