"""Loads, fetch plans, streets, memory, feedback, notices, territories and reading on small tables of odd rows."""

import pytest
from pyspark.sql import functions as F

from haulspark.operators import feedback, loads, matrices, memory, notices, planning, reading, streets


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


BOX = "plan_id long, item_id long, x double, y double, z double, l double, w double, h double, weight_kg double, stop_seq int, stackable boolean, most_above_kg double"
HOLD = "plan_id long, hold_l double, hold_w double, hold_h double, payload_kg double, front_x double, rear_x double, front_most_kg double, rear_most_kg double"


def test_what_is_wrong_with_a_load(spark):
    boxes = [
        (1, 1, 0.0, 0.0, 0.0, 2.0, 1.0, 1.0, 100.0, 1, False, 50.0), (1, 2, 0.0, 0.0, 1.0, 2.0, 1.0, 1.0, 80.0, 2, True, None), (1, 3, 1.9, 0.5, 0.0, 2.0, 1.0, 1.0, 10.0, 3, True, None), (1, 4, 5.0, 1.8, 0.0, 2.0, 1.0, 3.0, None, None, None, None),
        (1, 5, 8.0, 0.0, 1.5, 1.0, 1.0, 0.5, 5.0, 1, True, None), (1, 6, None, 0.0, 0.0, 1.0, 1.0, 1.0, 9000.0, 1, True, None), (2, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 5.0, 1, True, None), (3, 1, -0.5, 0.0, 0.0, 1.0, 1.0, 1.0, 900.0, 1, True, None),
    ]
    holds = [(1, 10.0, 2.4, 2.6, 150.0, 1.0, 8.0, 1e6, 1e6), (2, 10.0, 2.4, 2.6, 150.0, 1.0, 8.0, 1e6, 1e6), (3, 10.0, 2.4, 2.6, 500.0, 1.0, 8.0, 500.0, 1e6)]
    found = loads.load_findings(spark.createDataFrame(boxes, BOX), spark.createDataFrame(holds, HOLD))
    told = {tuple(r) for r in found.select("plan_id", "code", "severity", "item_id", "other_id", "over_by").collect()}
    assert told == {
        (1, "collision", "error", 1, 3, None), (1, "not_stackable", "error", 2, 1, None), (1, "stack_weight_exceeded", "error", 2, 1, 30), (1, "out_of_bounds_width", "error", 4, None, 400), (1, "out_of_bounds_height", "error", 4, None, 400),
        (1, "unsupported_stack", "error", 5, None, None), (1, "unloading_order", "warning", 1, 3, None), (1, "unloading_order", "warning", 2, 3, None), (1, "payload_exceeded", "error", None, None, 45), (3, "out_of_bounds_length", "error", 1, None, 500), (3, "payload_exceeded", "error", None, None, 400),
        (3, "axle_overloaded_front", "error", None, None, 529),
    }
    none = spark.createDataFrame([], BOX)
    assert loads.load_findings(none, spark.createDataFrame(holds, HOLD)).count() == 0 and loads.section_fill(none, spark.createDataFrame(holds, HOLD)).count() == 18 and loads.side_balance(none, spark.createDataFrame(holds[:1], HOLD)).first().total_kg == 0


def test_a_new_point_costs_two_thin_rectangles(spark):
    points = spark.createDataFrame([(1, i, f"n{i}" if i < 9 else None) for i in range(10)] + [(2, 0, "n0"), (2, 1, "n1"), (3, 0, None), (4, 0, "a"), (4, 1, "a")], "matrix_id int, idx int, node_key string")
    cache = spark.createDataFrame([(f"n{i}", f"n{j}", "2030-01-01 00:00:00" if (i, j) != (3, 5) else "2020-01-01 00:00:00") for i in range(9) for j in range(9) if i != j], "from_key string, to_key string, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    got = {(r.matrix_id, r.fetch_no): (r.hits, r.misses, r.rows, r.cols) for r in matrices.fetch_plan(points, cache, "2026-01-01").collect()}
    nine = ",".join(map(str, range(9)))
    assert got == {(1, 1): (71, 19, "9", nine + ",9"), (1, 2): (71, 19, nine, "9"), (1, 3): (71, 19, "3", "5"), (2, None): (2, 0, None, None), (3, 1): (0, 0, "0", "0"), (4, None): (2, 0, None, None)}


def test_streets_by_name(spark):
    known = spark.createDataFrame([(1, "x", "Bulevardul Dacia", "ZA:p"), (2, "x", "Strada Dacia", ""), (3, "x", "Strada Baba Novac", "ZB:f"), (4, "x", "Intrarea Baba Novac", "ZB:f"), (5, "x", "Bulevardul General Gheorghe Magheru", "ZA:f"), (6, "x", "Bulevardul 1 Decembrie 1918", None), (7, "y", "Calea Victoriei", "")], "street_id long, city string, name string, zones string")
    asked = [(1, "x", "bd. Dacia"), (2, "x", "Dacia"), (3, "x", "baba novac"), (4, "x", "b-dul Magheru"), (5, "x", "Bulevardul 1 Decembrie 1918"), (6, "x", "Calea Victoriei"), (7, "y", "Calea Victoriei, nr. 12A"), (8, "x", ""), (9, "x", None), (10, "x", "Bd. Dacia 5"), (11, "x", "novac baba"), (12, "x", "1 decembrie 1918 7")]
    got = {r.id: (r.status, r.street_id, r.candidates, r.house_number) for r in streets.lookup_streets(spark.createDataFrame(asked, "id long, city string, text string"), known).collect()}
    assert got == {
        1: ("exact", 1, 1, None), 2: ("ambiguous", None, 2, None), 3: ("without-type", 3, 2, None), 4: ("without-type", 5, 1, None), 5: ("exact", 6, 1, None), 6: ("unknown", None, 0, None), 7: ("exact", 7, 1, "12A"), 8: ("unknown", None, 0, None), 9: ("unknown", None, 0, None),
        10: ("exact", 1, 1, "5"), 11: ("without-type", 3, 2, None), 12: ("without-type", 6, 1, "7"),
    }


SIGHTING = "doc_id long, role string, postcode string, match_key string, locality string, street_name string, display string, source string, at timestamp"


def test_parts_remembered_in_turn_are_the_whole(spark):
    told = [(i // 2, "delivery" if i % 3 else "origin", f"0{i % 4}0000" if i % 11 else None, f"k{i % 5}", "Arad" if i % 7 else None, "Lunga", "Str. Lunga nr. 1, Arad" if i % 13 else " ", "corrected" if i % 17 == 0 else "parsed", f"2026-01-{1 + i // 4:02d} 00:00:00") for i in range(100)]
    sightings = spark.createDataFrame(told, SIGHTING.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
    start = (spark.createDataFrame([], memory.ADDRESS), spark.createDataFrame([], "id string, doc_id long"))
    whole = memory.remember(*start, sightings)
    early = F.col("at") < F.lit("2026-01-12").cast("timestamp")
    parts = memory.remember(*memory.remember(*start, sightings.where(early)), sightings.where(~early))
    again = memory.remember(*whole, sightings)
    assert rows(memory.known_addresses(*whole)) == rows(memory.known_addresses(*parts)) == rows(memory.known_addresses(*again)) != []


@pytest.mark.parametrize(("display", "good"), [("Str. Republicii nr. 1F, Bolintin-Deal", True), ("Str. Pantelimon Construct Srl nr. 5OS", False), ("Șosea Curtea Domneasca, Nr.z5-Aleo", False), ("Calea Bucuresti nr. 2A, Balote,ti", False), ("Depozit", True)])
def test_legs_that_read_like_addresses(spark, display, good):
    assert spark.range(1).select(memory.plausible_leg(F.lit(display)).alias("v")).first().v is good


def test_feedback_of_few_documents_suggests_nothing(spark):
    change = [("tpo", None, "x"), ("notes", "a", "b")]
    events = spark.createDataFrame([(1, 1, "ana", change), (9, 2, None, change), (1, 3, "ana", [("plate", "a", None)])], "document_id long, event_id long, operator string, changes array<struct<field:string,old_value:string,new_value:string>>")
    few = spark.createDataFrame([(1, "auto", ["r"]), (2, None, None)], "id long, routing string, failed_rules array<string>")
    one = feedback.overview(events, few).first()
    assert (one.total, one.touched, one.touched_outside, one.corrections, one.corrections_outside, one.touch_rate, one.corrections_per_touched) == (2, 1, 1, 2, 1, 0.5, 2.0)
    assert feedback.suggestions(events, few).count() == 0 and feedback.overview(events.limit(0), few.limit(0)).first().touch_rate is None
    assert rows(feedback.by_field(events, few).select("field", "examples")) == [("plate", "a > "), ("tpo", " > x")]


def test_notices_are_kept_for_five_minutes(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    now = 1_800_000_000
    assert [notices.kept(spark, f"notices-{id(calls)}", s, build).count() for s in (now, now + 299, now + 300)] == [1, 1, 2] and len(calls) == 2


def test_one_depot_of_all_rows_is_balanced_and_whole(spark):
    places = spark.range(3000).select(F.lit(7).alias("depot"), F.col("id").alias("location_id"), (44 + F.col("id") * 37 % 1000 / 300 * F.when(F.col("id") % 3 == 0, 0.1).otherwise(1.0)).alias("lat"), (25 + F.col("id") * 91 % 1000 / 300).alias("lon"), (1 + F.col("id") % 5).cast("double").alias("weight"))
    out = planning.territories(places.unionByName(places.limit(0)), "depot", 5, rounds=24)
    report = planning.balance_report(out, "depot").collect()
    assert out.select("location_id").distinct().count() == out.count() == 3000 and len(report) == 5 and all(r.balanced for r in report)


def test_pages_without_anything(spark):
    out = reading.read_fields(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), "id", "2026-10-19")
    assert out.count() == 2 * len(reading.FIELDS) and out.where("value is not null").count() == 0


@pytest.mark.parametrize(("needs", "has", "want"), [(["ADR", "adr", "Frig"], ["FRIG"], ["ADR"]), (None, ["x"], []), (["a", None, "B"], None, ["a", "B"]), ([], [], [])])
def test_needs_keep_their_first_spelling(spark, needs, has, want):
    from haulspark.operators.matching import missing_requirements

    row = spark.createDataFrame([(needs, has)], "needs array<string>, has array<string>")
    assert row.select(missing_requirements(F.col("needs"), F.col("has")).alias("v")).first().v == want
