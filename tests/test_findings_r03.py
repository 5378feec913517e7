"""What the findings of round 3 named: areas to the last digit, and steps whose work grew faster than their rows."""

import math
import re

import pandas as pd
from pyspark.sql import functions as F

from haulspark.functions import geo, scans
from haulspark.functions.text import resolved_date
from haulspark.operators import backfill, grouped, joins, loads, planning, reading, sheets, streets
from haulspark.plans import kpi_queries, load_queries
from haulspark.sources import tables
from haulspark.streaming import telematics

SMALL = "/root/testdata/sf0.001"


def test_area_keeps_its_digits_far_from_the_equator(spark):
    """A rectangle of 0.015 by 0.003 degrees at 44 north; products of metres from the equator lost the last digit."""
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in [(26.0, 44.0), (26.015, 44.0), (26.015, 44.003), (26.0, 44.003), (26.0, 44.0)]])
    mx = geo.METRES_LON * math.cos(math.radians((44.0 * 3 + 44.003 * 2) / 5))
    got = spark.range(1).select(geo.ring_metrics(ring)["area"]).first()[0]
    assert abs(got - 0.015 * mx * 0.003 * geo.METRES_LAT) < 1e-6


def test_rewriting_works_its_text_out_once(spark):
    """Eight rewritings in a row; each used its text twice, so the first was worked out 128 times a row."""
    text = F.concat(F.lit("a1 b22 "), F.col("id").cast("string"))
    for _ in range(8):
        text = scans.rewritten(text, "[0-9]+", lambda d: F.concat(d, F.lit("x")))
    assert str(text).count("regexp_extract_all") == 8
    assert spark.range(8).select(text).collect()[7][0] == f"a1{'x' * 8} b22{'x' * 8} 7{'x' * 8}"


def test_hand_written_values_are_worked_out_once(spark):
    text = F.lit("marker")
    assert str(sheets.hand_number(text)).count("marker") == 1 and str(sheets.packaging_word(text)).count("marker") == 1


def test_sheets_of_one_file_are_dealt_over_all_cores(spark):
    docs = spark.range(50).coalesce(1).select("id", F.lit("1. TPO-0000001\n2. 11.08.2026\n6. nisip").alias("text"))
    out = sheets.numbered_sheets(docs, "id", "2026-10-19")
    assert out.rdd.getNumPartitions() >= 4 and out.count() == 150


def test_parts_of_a_printed_date_are_worked_out_once(spark):
    """Each part of a date is a pattern search over its line; years stood in hundreds of places."""
    told = str(resolved_date(F.lit("day_part").try_cast("int"), F.lit("month_part").try_cast("int"), F.lit("year_part").try_cast("int"), F.lit("2026-10-19").cast("date")))
    assert [told.count(part) for part in ("day_part", "month_part", "year_part")] == [1, 1, 1]


def test_pages_of_one_file_are_dealt_over_all_cores(spark):
    docs = spark.range(50).coalesce(1).select("id", F.lit("TPO-0000001").alias("text"))
    out = reading.read_fields(docs, "id", "2026-10-19")
    assert out.rdd.getNumPartitions() >= 4 and out.where("value = 'TPO-0000001'").count() == 50


def test_names_are_compared_once_a_text_and_give_what_all_pairs_give(spark):
    """240 rows that ask for 6 texts under 3 keys, one without names and one null, against names in several spellings."""
    facts = spark.createDataFrame([(i, None if i % 4 == 3 else i % 4, [None, "", "Ana Maria", "ana mária", "Ion  Pop", "x"][i % 6]) for i in range(240)], "id int, key int, text string")
    names = spark.createDataFrame([(k, n) for k in (0, 1) for n in ("Ana Maria", "Ana-Maria", "ION POP", "Ion Popa", "", "Zaharia Stancu cel lung")], "key int, name string")
    got = joins.best_match(facts, names, "key", "text")
    every = facts.join(names, "key", "left").withColumn("s", F.floor(joins.similarity(F.col("text"), F.col("name")) * 10000 + 0.5) / 10000)
    best = {r.id: (r.a, r.b) for r in every.groupBy("id").agg(F.sort_array(F.collect_list("s"), False).alias("l")).select("id", F.get("l", F.lit(0)).alias("a"), F.get("l", F.lit(1)).alias("b")).collect()}
    rows = got.collect()
    assert len(rows) == 240
    for r in rows:
        a, b = best[r.id] if r.key in (0, 1) else (None, None)
        assert r.score == a and r.reason == ("no_candidate" if a is None else "too_different" if a < 0.6 else "ambiguous" if a - b < 0.15 else "matched")
    assert "levenshtein" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_index_of_streets_is_sent_to_no_driver(spark):
    """Small files do not tell how large their index is: it was broadcast, and collected by the driver for it."""
    known = spark.createDataFrame([(1, "c", "Strada Lunga", ""), (2, "c", "Aleea Mare", "")], "street_id long, city string, name string, zones string")
    asked = spark.createDataFrame([(1, "c", "lunga"), (2, "c", "Mar"), (3, "c", "nowhere")], "id long, city string, text string")
    out = streets.lookup_streets(asked, known)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.status, r.street_id) for r in out.collect()} == {(1, "without-type", 1), (2, "without-type", 2), (3, "unknown", None)}


def test_an_address_of_many_rows_is_read_once(spark):
    """The table of addresses that are read has a row an address; rows with a null one stay."""
    rows = spark.range(90).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("Str. Lunga nr. 4, Arad"), (F.col("id") % 3).cast("string"))).alias("address"))
    told, settled = [], backfill.settled
    backfill.settled = lambda df: told.append(settled(df)) or told[-1]
    try:
        out = backfill.assessed(rows)
    finally:
        backfill.settled = settled
    assert told[0].count() == 3 and out.count() == 90


def test_stops_come_in_parts_of_bounded_rows(spark, monkeypatch):
    """Parts were as many as ever however many rows there were, so a task's sorts and groups grew with the table."""
    monkeypatch.setattr(grouped, "PART_ROWS", 500, raising=False)
    stops = tables.stops(spark, SMALL)
    held = stops.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 12 and max(r["count"] for r in held) < 1000 and sum(r["count"] for r in held) == stops.count()


def test_lines_of_orders_are_grouped_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(grouped, "PART_ROWS", 500, raising=False)
    zones = kpi_queries._lines(spark, SMALL).where("kind = 'zone_tax'")
    assert len(zones.groupBy(F.spark_partition_id()).count().collect()) >= 12


def test_locations_of_one_file_are_dealt_over_all_cores(spark, monkeypatch):
    """One task had all locations of a small file in every round."""
    places = spark.range(4000).coalesce(1).select(F.lit(1).alias("depot"), F.col("id").alias("location_id"), (44 + F.col("id") % 7).alias("lat"), (25 + F.col("id") % 11).alias("lon"), F.lit(1.0).alias("weight"))
    told, settled = [], planning.settled
    monkeypatch.setattr(planning, "settled", lambda df: told.append(df) or settled(df))
    assert planning.territories(places, "depot", 2, rounds=1).count() == 4000 and told[0].rdd.getNumPartitions() >= 4


def test_boxes_that_lie_by_plan_are_not_shuffled_again(spark):
    """Every rule joined boxes by plan and cell, which shuffled them anew for each."""
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = loads.load_findings(load_queries._placed(spark, SMALL), load_queries._holds(spark, SMALL))
        keys = re.findall(r"hashpartitioning\((.*?), \d+\)", out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    assert keys and all(re.fullmatch(r"(l_orderkey|o_orderkey|plan_id)#\d+L", key) for key in keys)


def test_idle_clock_reads_whole_microseconds():
    """Frames had fourteen columns a vehicle, two of them timestamps, which cost most of the stream's time; a sample without a time does not move the clock."""

    class State:
        get = exists = None

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.get, self.exists = None, None

    def told(state, *rows):
        frame = pd.DataFrame(rows, columns=["event_id", "micros", "speed", "stop_m"])
        return {r.event_id: r.idle_min for out in telematics._idle_clock((7,), iter([frame[:1], frame[1:]]), state) for r in out.itertuples()}

    state, minute, nan = State(), 60_000_000, float("nan")
    first = told(state, (2, 5 * minute, 0.0, 900.0), (1, 2 * minute, 0.0, nan), (3, nan, 0.0, 900.0))
    assert first[1] == 0 and first[2] == 3 and math.isnan(first[3]) and state.get == (2 * minute,)
    second = told(state, (4, 6 * minute, 5.0, 151.0), (5, 7 * minute, 0.0, 150.0), (6, 9 * minute, 1.0, nan))
    assert second[4] == 4 and math.isnan(second[5]) and second[6] == 0 and state.get == (9 * minute,)
    told(state, (7, 10 * minute, nan, 900.0))
    assert state.exists is None and "timestamp" not in telematics._OUT
