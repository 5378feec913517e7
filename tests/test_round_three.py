"""Values beside nulls, null keys, sheets and scans."""

import pytest
from pyspark.sql import functions as F

from haulspark.functions import scans
from haulspark.operators import planning, sheets, upkeep
from haulspark.operators.grouped import walk_groups

BIG = 2**53 + 1


def test_whole_numbers_beside_nulls_are_kept(spark):
    rows = spark.createDataFrame([(1, 2, BIG, 1.5, "a"), (1, 1, None, None, None), (BIG, 1, 7, 2.0, "b")], "k long, seq int, stop long, x double, s string")
    out = walk_groups(rows, "k", ["seq"], lambda k, r: [(k, s, x, t) for s, x, t in zip(r["stop"], r["x"], r["s"], strict=True)], "k long, stop long, x double, s string")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, None, None, None), (1, BIG, 1.5, "a"), (BIG, 7, 2.0, "b")], key=str)
    vehicles = spark.createDataFrame([(1, 5, BIG + 1), (1, 6, None)], "depot int, vehicle_id long, preferred long")
    drivers = spark.createDataFrame([(1, BIG), (1, BIG + 1)], "depot int, driver_id long")
    assert {tuple(r) for r in planning.assign_drivers(vehicles, drivers, "depot").collect()} == {(5, BIG + 1), (6, BIG)}


@pytest.mark.parametrize("update", [True, False])
def test_null_keys_conflict_with_nothing(spark, update):
    target = spark.createDataFrame([(1, "a", 0), (None, "a", 0), (2, None, 0)], "k long, j string, v int")
    rows = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (1, "a", 3), (1, "a", 4), (2, None, 5), (3, "b", 6)], "k long, j string, v int")
    got = sorted((tuple(r) for r in upkeep.upsert(target, rows, ["k", "j"], [-F.col("v")], update).collect()), key=str)
    assert got == sorted([(1, "a", 4 if update else 0), (None, "a", 0), (2, None, 0), (None, "a", 1), (None, "a", 2), (2, None, 5), (3, "b", 6)], key=str)


@pytest.mark.parametrize(("text", "want"), [("15,744,00", 15744.0), ("1,234,567", 1234567.0), ("21.326.48", 21326.48), ("1.234", 1234.0), ("9,96", 9.96), ("1 2.5", 12.5), ("", None), ("x", None), (None, None), ("1.2,345", 12.345)])
def test_hand_numbers(spark, text, want):
    assert spark.range(1).select(sheets.hand_number(F.lit(text).cast("string")).alias("v")).first().v == want


@pytest.mark.parametrize(("text", "want"), [("CA 4471 KX / B 63 RTX", ["CA-4471-KX", "B-63-RTX"]), ("b-100-plm b 100 plm", ["B-100-PLM"]), ("TM 40 KG", []), ("B 1 ABC", []), ("", [])])
def test_plates_in_their_order(spark, text, want):
    assert spark.range(1).select(sheets.plate_tokens(F.lit(text)).alias("v")).first().v == want


def test_cleaning_is_done_once_and_for_all(spark):
    texts = ["TP0-O0&5813 « x »\n\n\n\nend", "Expediţie", "Expediţie", "a\tb  c\t d", "​", "-----\n===\na", "....", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").withColumn("one", scans.clean_scan(F.col("t"))).withColumn("two", scans.clean_scan(F.col("one")))
    rows = df.orderBy("id").collect()
    assert all(r.one == r.two for r in rows) and rows[1].one == rows[2].one and [r.one for r in rows[3:]] == ["a\tb c\td", "", "a", "", None, ""]


def test_sheets_without_lines(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "1. a\n2. b"), (4, "1. TPO-0000001\n1. TPO-0000002\n2. x\n3. gol\n4. n/a")], "id long, text string")
    assert sheets.numbered_sheets(df, "id", "2026-10-19").count() == 0
