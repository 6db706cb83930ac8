"""Stored tables and large multi-line files."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tianguis.operators.clean import QUOTED_COLUMNS
from tianguis.sources import multiline, stored
from tianguis.sources.csv_ingest import read_csv_table
from tianguis.sources.schemas import CATEGORY_TRANSLATION, ORDER_REVIEWS, ORDERS


def names(root):
    return {f for folder, _, files in os.walk(root) for f in files if f.endswith(".parquet") and "_versions" not in folder}


def listed(spark, root):
    return set(stored._listed(spark, root, None)[1])


@pytest.fixture()
def orders(spark, tmp_path):
    """Four files; only the second and the fourth hold quotes."""
    rows = [(f'"o{i}"' if i in (7, 17) else f"o{i}", f"c{i}", "delivered", *[None] * 5) for i in range(20)]
    df = spark.createDataFrame(rows, ORDERS).repartitionByRange(4, F.regexp_extract("order_id", r"(\d+)", 1).cast("int"))
    stored.create(df, str(tmp_path))
    return str(tmp_path)


def strip(spark, root):
    return stored.update(spark, root, {c: F.replace(F.col(c), F.lit('"'), F.lit("")) for c in QUOTED_COLUMNS["orders"]})


def test_update_rewrites_only_files_with_changed_rows(spark, orders):
    before = listed(spark, orders)
    assert strip(spark, orders) == 2
    after = listed(spark, orders)
    assert len(before) == 4 and len(before & after) == 2
    assert sorted(r["order_id"] for r in stored.read(spark, orders).collect()) == sorted(f"o{i}" for i in range(20))
    assert stored.read(spark, orders, 1).where("order_id LIKE '\"%'").count() == 2  # the version before stays
    files = names(orders)
    assert strip(spark, orders) == 2 and names(orders) == files  # the second run changes nothing


def test_update_with_a_condition(spark, orders):
    assert stored.update(spark, orders, {"order_status": F.lit("canceled")}, F.col("customer_id").isin("c3", "c4")) == 2
    assert {r["customer_id"] for r in stored.read(spark, orders).where("order_status = 'canceled'").collect()} == {"c3", "c4"}
    assert stored.update(spark, orders, {"order_status": F.lit(None)}, F.col("customer_id") == "nobody") == 2


def test_failed_update_leaves_the_version(spark, orders):
    with pytest.raises(Exception, match="no"):
        stored.update(spark, orders, {"order_status": F.raise_error(F.lit("no"))})
    assert stored.versions(spark, orders) == [1] and stored.read(spark, orders).count() == 20


def test_literal_insert_by_key_is_replay_safe(spark, tmp_path):
    root = str(tmp_path)
    stored.create(spark.createDataFrame([("beleza", "beauty"), ("pcs", "PCS")], CATEGORY_TRANSLATION), root)
    before = listed(spark, root)
    rows = spark.createDataFrame([("pcs", "other"), ("pc_gamer", "pc_gamer"), ("pc_gamer", "pc_gamer")], CATEGORY_TRANSLATION)
    assert stored.insert(rows, root, key=["product_category_name"]) == 2
    assert before < listed(spark, root)
    assert stored.insert(rows, root, key=["product_category_name"]) == 2
    assert sorted(map(tuple, stored.read(spark, root).collect())) == [("beleza", "beauty"), ("pc_gamer", "pc_gamer"), ("pcs", "PCS")]


def test_insert_select_by_operation(spark, tmp_path):
    root = str(tmp_path)
    stored.create(spark.createDataFrame([], ORDER_REVIEWS), root)
    assert stored.read(spark, root).count() == 0
    staging = spark.createDataFrame([("r1", "o1", "5", "x"), ("r1", "o1", "5", "x")], "review_id string, order_id string, review_score string, other string")
    for _ in range(2):
        assert stored.insert(staging, root, ["review_id", "order_id", "review_score"], operation="load 1") == 2
    out = stored.read(spark, root)
    assert out.schema == ORDER_REVIEWS and [r["review_score"] for r in out.collect()] == [5, 5]
    assert stored.insert(staging, root, ["review_id"], operation="load 2") == 3 and stored.read(spark, root).count() == 4
    with pytest.raises(ValueError, match="key"):
        stored.insert(staging, root, ["review_id"])


def review_file(path, seed, end, n=120):
    rng = random.Random(seed)
    words = ["bom", 'muito "bom"', "a, b", "duas\nlinhas", "", "x" * 90, "três\n\nlinhas", "fim\n"]

    def field(s):
        return '"' + s.replace('"', '""') + '"' if s and (rng.random() < 0.3 or any(c in s for c in '",\n')) else s

    lines = [",".join(ORDER_REVIEWS.names)]
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
        if end == "\r\n":
            text = text.replace("\n", "\r\n")
        score = rng.choice(["5", "1", "bad"] if i % 50 == 7 else ["5", "1"])
        lines.append(",".join(field(x) for x in (f"r{i}", f"o{i}", score, rng.choice(["", "t"]), text, "2020-01-01 00:00:00", "")))
    if seed == 1:
        lines.insert(50, "")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(end.join(lines) + (end if seed % 2 else ""))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(("seed", "end", "size"), [(0, "\n", "1k"), (1, "\n", "300b"), (2, "\r\n", "700b"), (3, "\r\n", "90b"), (4, "\n", "10m")])
def test_split_file_gives_the_rows_of_the_multiline_read(spark, tmp_path, seed, end, size):
    path = str(tmp_path / "reviews.csv")
    review_file(path, seed, end)
    whole = rows(read_csv_table(spark, path, "order_reviews").cache())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], size), spark.conf.set(keys[1], "0")
    try:
        split = read_csv_table(spark, path, "order_reviews", split=True)
        assert size == "10m" or multiline._lines(spark, path).rdd.getNumPartitions() > 8
        assert rows(split.cache()) == whole and len(whole) == 120
    finally:
        for k in keys:
            spark.conf.unset(k) if old[k] is None else spark.conf.set(k, old[k])


def test_split_read_of_a_folder_and_of_nothing(spark, tmp_path):
    for k in range(3):
        review_file(str(tmp_path / f"part{k}.csv"), k, "\n", 40)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text(",".join(ORDER_REVIEWS.names) + "\n")
    assert read_csv_table(spark, str(tmp_path), "order_reviews", split=True).cache().count() == 120
