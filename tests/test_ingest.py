"""CSV loading: quoting, embedded newlines, CRLF, doubled quotes, malformed
rows, leading zeros; the literal insert; the incremental loader; the mart."""

from __future__ import annotations

import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from tianguis.operators.clean import insert_missing, replace_commas, strip_quotes
from tianguis.sources.schemas import SOURCE_FILES
from tianguis.sources.csv_ingest import load_landing, read_csv_table, split_quarantine
from tianguis.sources.schemas import CATEGORY_TRANSLATION

SELLERS = (
    "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    "s1,01037,sao paulo,SP\n"
    's2,20000,"rio de janeiro, rio de janeiro, brasil",RJ\n'
    "s3,30000,belo horizonte,MG,EXTRA,FIELDS\n"
)


def _write(folder: str, name: str, text: str, newline: str = "\n") -> str:
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text.replace("\n", newline))
    return path


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="tianguis-test-", dir="/tmp")


def test_quoted_commas_zip_zero_and_quarantine(spark):
    d = _scratch()
    df = read_csv_table(spark, _write(d, "sellers.csv", SELLERS), "sellers")
    good, bad = split_quarantine(df)
    g = {r["seller_id"]: r for r in good.collect()}
    assert g["s1"]["seller_zip_code_prefix"] == "01037"          # stays a string
    assert g["s2"]["seller_city"] == "rio de janeiro, rio de janeiro, brasil"
    assert "s3" not in g and len(bad.collect()) == 1             # over-long row quarantined
    assert replace_commas(good, "seller_city").where("seller_id = 's2'").first()["seller_city"] \
        == "rio de janeiro - rio de janeiro - brasil"


def test_raw_compat_keeps_quotes_then_strip(spark):
    d = _scratch()
    text = 'seller_id,seller_zip_code_prefix,seller_city,seller_state\n"s1","01037","sp",SP\n'
    df = read_csv_table(spark, _write(d, "sellers.csv", text), "sellers", raw_compat=True)
    r = df.first()
    assert r["seller_id"] == '"s1"'
    r2 = strip_quotes(df, ["seller_id", "seller_zip_code_prefix", "seller_city"]).first()
    assert (r2["seller_id"], r2["seller_zip_code_prefix"]) == ("s1", "01037")


def test_multiline_reviews_crlf_and_doubled_quotes(spark):
    d = _scratch()
    long = "x" * 300
    text = ("review_id,order_id,review_score,review_comment_title,review_comment_message,"
            "review_creation_date,review_answer_timestamp\n"
            'r1,o1,5,,"line one\nline two, with comma",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
            f'r2,o2,1,"say ""hi""",{long},2018-03-10 00:00:00,2018-03-11 03:05:13\n')
    df = read_csv_table(spark, _write(d, "order_reviews.csv", text, newline="\r\n"),
                        "order_reviews")
    good, bad = split_quarantine(df)
    assert len(bad.collect()) == 0
    got = {r["review_id"]: r for r in good.collect()}
    assert got["r1"]["review_comment_message"] == "line one\nline two, with comma"
    assert got["r1"]["review_comment_title"] is None             # empty field -> NULL
    assert got["r2"]["review_comment_title"] == 'say "hi"'
    assert len(got["r2"]["review_comment_message"]) == 300
    assert got["r2"]["review_answer_timestamp"].hour == 3


def test_insert_missing_is_idempotent(spark):
    base = spark.createDataFrame([("a", "A")], CATEGORY_TRANSLATION)
    rows = spark.createDataFrame([("a", "A2"), ("pc_gamer", "pc_gamer")], CATEGORY_TRANSLATION)
    once = insert_missing(base, rows, ["product_category_name"])
    twice = insert_missing(once, rows, ["product_category_name"])
    assert sorted(tuple(r) for r in twice.collect()) == [("a", "A"), ("pc_gamer", "pc_gamer")]


def _landing(folder: str) -> None:
    _write(folder, "customers.csv", "customer_id,customer_unique_id,customer_zip_code_prefix,"
           "customer_city,customer_state\nc1,u1,01037,sao paulo,SP\n")
    _write(folder, "orders.csv", "order_id,customer_id,order_status,order_purchase_timestamp,"
           "order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,"
           "order_estimated_delivery_date\n"
           "o1,c1,delivered,2018-01-10 23:59:00,2018-01-11 00:30:00,2018-01-12 10:00:00,"
           "2018-01-20 15:00:00,2018-01-20 00:00:00\n")
    _write(folder, "products.csv", "product_id,product_category_name,product_name_lenght,"
           "product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,"
           "product_height_cm,product_width_cm\np1,beleza,10,100,1,500,10,10,10\n")
    _write(folder, "sellers.csv", SELLERS)
    _write(folder, "order_items.csv", "order_id,order_item_id,product_id,seller_id,"
           "shipping_limit_date,price,freight_value\no1,1,p1,s1,2018-01-12 00:00:00,58.90,13.29\n")
    _write(folder, "order_payments.csv", "order_id,payment_sequential,payment_type,"
           "payment_installments,payment_value\no1,1,credit_card,2,72.19\n")
    _write(folder, "order_reviews.csv", "review_id,order_id,review_score,review_comment_title,"
           "review_comment_message,review_creation_date,review_answer_timestamp\n"
           "r1,o1,4,,,2018-01-21 00:00:00,\n")
    _write(folder, "category_translation.csv",
           "product_category_name,product_category_name_english\nbeleza,health_beauty\n")
    _write(folder, "geolocation.csv",
           "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,"
           "geolocation_state\n"
           '01037,-23.54562128115268,-46.63929204800168,"rio de janeiro, rio de janeiro, brasil",RJ\n'
           "01046,-23.546081127035535,-46.64482029837157,sao paulo,SP\n")


def test_load_landing_builds_tables(spark):
    d = _scratch()
    _landing(d)
    land = load_landing(spark, d)
    t = land.tables
    assert t.order_items.first()["price"] == Decimal("58.90")
    assert len(land.quarantine["sellers"].collect()) == 1
    geo = {r["geolocation_zip_code_prefix"]: r for r in t.geolocation.collect()}
    assert geo["01037"]["geolocation_city"] == "rio de janeiro - rio de janeiro - brasil"
    assert geo["01046"]["geolocation_lat"] == -23.546081127035535
    from tianguis.plans.findings import h3_transit_days_by_lateness
    assert h3_transit_days_by_lateness(t).count() == 1


def test_landing_by_uri_folder_tables_and_two_loads(spark):
    d = _scratch()
    _landing(d)
    first = load_landing(spark, "file://" + d)
    n = first.tables.order_items.count()
    folder = os.path.join(d, "parts")
    os.makedirs(folder)
    _write(folder, "a.csv", SELLERS)
    files = {**SOURCE_FILES, "sellers": "parts"}
    second = load_landing(spark, d, files=files)
    assert {r["seller_id"] for r in second.tables.sellers.collect()} == {"s1", "s2"}
    assert first.tables.order_items.count() == n == second.tables.order_items.count()


def test_review_with_a_newline_loads(spark):
    d = _scratch()
    _write(d, "r.csv", "review_id,order_id,review_score,review_comment_title,review_comment_message,"
           "review_creation_date,review_answer_timestamp\n"
           'r1,o1,5,,"two\nlines",2020-01-01 00:00:00,\n')
    good, bad = split_quarantine(read_csv_table(spark, os.path.join(d, "r.csv"), "order_reviews").cache())
    assert [r["review_comment_message"] for r in good.collect()] == ["two\nlines"] and not bad.collect()


def test_csv_sink_keeps_zip_prefixes(spark, make_tables):
    from tianguis.sources.sinks import write_csv
    from tests_support import tiny_tables
    t = tiny_tables(make_tables)
    root = _scratch()
    write_csv(t.sellers, os.path.join(root, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(root, "csv"))
    assert back.count() == t.sellers.count()
    assert back.where(F.col("seller_zip_code_prefix") == "01000").count() == 1


def test_unparseable_typed_value_is_quarantined(spark):
    d = _scratch()
    text = ("order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
            "o1,1,credit_card,2,72.19\n"
            "o2,1,credit_card,two,10.00\n")
    good, bad = split_quarantine(read_csv_table(spark, _write(d, "p.csv", text), "order_payments"))
    assert [r["order_id"] for r in good.collect()] == ["o1"]
    assert [r["order_id"] for r in bad.collect()] == ["o2"]


def test_staging_insert_casts_to_target(spark):
    from tianguis.sources.csv_ingest import stage_and_insert
    from tianguis.sources.schemas import ORDER_REVIEWS
    staging = spark.createDataFrame(
        [("r1", "o1", "5", "t", "m", "2018-01-18 00:00:00", "2018-01-18 21:46:59", "extra")],
        "review_id string, order_id string, review_score string, review_comment_title string, "
        "review_comment_message string, review_creation_date string, "
        "review_answer_timestamp string, other string")
    out = stage_and_insert(staging, [f.name for f in ORDER_REVIEWS.fields], ORDER_REVIEWS)
    assert out.schema == ORDER_REVIEWS
    assert out.first()["review_score"] == 5


def test_row_count_check_against_expected(spark, make_tables):
    from tianguis.operators.quality import row_count_check
    from tests_support import tiny_tables
    t = tiny_tables(make_tables)
    rep = {r["tabla"]: r for r in row_count_check(
        t.as_dict(), {"orders": 2, "order_items": 5, "geolocation": 10}).collect()}
    assert rep["orders"]["coincide"] and not rep["order_items"]["coincide"]
    assert rep["geolocation"]["registros"] is None and not rep["geolocation"]["coincide"]


def test_batch_job_writes_outputs(spark):
    from tianguis.jobs import run
    d = _scratch()
    os.makedirs(os.path.join(d, "landing"))
    _landing(os.path.join(d, "landing"))
    out = os.path.join(d, "out")
    run(spark, out, landing=os.path.join(d, "landing"),
        reports=["h3_transit_days_by_lateness", "q01_orders_by_status"])
    assert spark.read.parquet(os.path.join(out, "reports", "q01_orders_by_status")).count() == 1
    assert spark.read.parquet(os.path.join(out, "quality", "row_counts")).count() == 9  # incl. geolocation
    assert spark.read.parquet(os.path.join(out, "mart", "fact_order_items")).count() == 1
    assert os.path.isdir(os.path.join(out, "quarantine", "sellers"))


def test_observed_checks_equal_the_reports(spark):
    from tianguis.operators.quality import domain_report, expected_counts, numeric_report, row_counts
    d = _scratch()
    _landing(d)
    with open(os.path.join(d, "order_payments.csv"), "a") as f:
        f.write("o9,1,credit_card,2,1234.56\no9,2,credit_card,two,1.00\no9,3,a_long_kind_of_payment,1,5.00\n")
    widths = {"order_payments": {"payment_type": 11, "order_id": None}, "customers": {"customer_id": 1, "customer_city": 3}}
    rules = {"order_payments": {"payment_value": (5, 2), "payment_installments": (1, 0)}, "order_items": {"price": (10, 0)}}
    land = load_landing(spark, d, staging=_scratch(), widths=widths, rules=rules)
    t = land.tables.as_dict()

    def rows(df, *cols):
        return sorted(map(str, df.select(*cols).collect()))

    assert rows(land.checks["row_counts"], "tabla", "registros") == rows(row_counts(t), "tabla", "registros")
    bad = {r["tabla"]: r["cuarentena"] for r in land.checks["row_counts"].collect()}
    assert bad["order_payments"] == 1 and all(bad[n] == len(q.collect()) for n, q in land.quarantine.items())
    cols = domain_report(t, widths).columns
    assert rows(land.checks["domain_report"], *cols) == rows(domain_report(t, widths), *cols)
    found = {r["columna"]: r for r in land.checks["numeric_report"].collect()}
    want = {r["columna"]: r for r in numeric_report(t, rules).collect()}
    assert found.keys() == want.keys() and all(found[c].asDict() == want[c].asDict() for c in want)
    assert found["payment_value"]["fuera_de_rango"] == 1
    rep = {r["tabla"]: r["coincide"] for r in expected_counts(land.checks["row_counts"].select("tabla", "registros"), {"customers": 1, "orders": 99}).collect()}
    assert not rep["orders"]


def test_job_takes_expected_counts_and_months(spark):
    from tianguis import jobs
    from tianguis.sources import mart
    d = _scratch()
    os.makedirs(os.path.join(d, "landing"))
    _landing(os.path.join(d, "landing"))
    out = os.path.join(d, "out")
    jobs.run(spark, out, landing=os.path.join(d, "landing"), reports=["q02_time_range"], expected={"orders": 1}, publish="tianguis_job")
    first = mart.manifest(spark, os.path.join(out, "mart"))
    jobs.run(spark, out, landing=os.path.join(d, "landing"), reports=["q02_time_range"], months=[(1999, 1)], publish="tianguis_job")
    second = mart.manifest(spark, os.path.join(out, "mart"))
    assert mart.versions(spark, os.path.join(out, "mart")) == [1, 2]
    assert {r["path"] for r in first if r["purchase_year"]} == {r["path"] for r in second if r["purchase_year"]}
    assert spark.read.parquet(os.path.join(out, "quality", "expected_counts")).where("tabla = 'orders'").count() == 1
    assert spark.read.parquet(os.path.join(out, "quality", "numeric_report")).count() > 5
    assert spark.table("tianguis_job.fact_order_items").count() == 1
