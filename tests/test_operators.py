"""Worked examples and invariants of functions and operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from haulspark.functions import geo, numeric, text, timez
from haulspark.operators import analytics, documents, joins, planning, pricing, relational, reporting, sequences
from haulspark.sources import tables as t
from haulspark.streaming.runs import exceptions_to_the_end

SF = "/root/testdata/sf0.001"
day = datetime.date


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("x", "places", "want"), [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -2.0), (1.25, 1, 1.3), (None, 2, None)])
def test_half_up(spark, x, places, want):
    assert one(spark, numeric.half_up(F.lit(x).cast("double"), places)) == want


@pytest.mark.parametrize(("cell", "want"), [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.234", 1234.0), ("12,5", 12.5), ("1.234.567", 1234567.0), ("1.2.34", 12.34), ("1,2,3", None), ("abc", None), ("", None), (None, None), ("-7,25", -7.25), (" 1 000,5 ", 1000.5)])
def test_import_numbers(spark, cell, want):
    assert one(spark, numeric.locale_number(F.lit(cell).cast("string"))) == want


@pytest.mark.parametrize(("value", "want"), [("31.12.2024", day(2024, 12, 31)), ("1/2/2024", day(2024, 2, 1)), ("2024-02-29", day(2024, 2, 29)), ("31.02.2024", None), ("45292", day(2024, 1, 1)), ("soon", None), (None, None)])
def test_dates(spark, value, want):
    assert one(spark, text.day_first_date(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(("value", "want"), [("8", 480), ("08:30", 510), ("0.5", 720), ("24:00", None), ("8:75", None), ("x", None)])
def test_clock(spark, value, want):
    assert one(spark, text.clock_minutes(F.lit(value))) == want


def test_text(spark):
    assert one(spark, text.fold(F.lit("  Str. Ștefan-cel-MARE, Nr. 4 "))) == "str stefan cel mare nr 4"
    assert one(spark, text.canonical_plate(F.lit("b 12-abc"))) == "B12ABC"
    assert one(spark, text.hamming(F.lit("123"), F.lit("124"))) == 1 and one(spark, text.hamming(F.lit("12"), F.lit("124"))) == 99
    assert one(spark, text.similarity(F.lit("depot"), F.lit("depots"))) == pytest.approx(5 / 6)
    assert one(spark, text.similarity(F.lit("Ștefan  cel"), F.lit("stefan CEL"))) == 1.0 and one(spark, text.similarity(F.lit(""), F.lit(""))) == 0.0 and one(spark, text.similarity(F.lit(None).cast("string"), F.lit("a"))) == 0.0
    assert one(spark, text.route_legs(F.lit("Arad -> Cluj / Iași – Brașov"))) == ["Arad", "Cluj", "Iași", "Brașov"]


def test_geography(spark):
    assert one(spark, geo.haversine_km(F.lit(44.4268), F.lit(26.1025), F.lit(46.7712), F.lit(23.6236))) == pytest.approx(324, abs=3)
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]])
    inside = lambda x, y: one(spark, geo.in_ring(F.lit(x), F.lit(y), ring))
    assert inside(1.0, 0.5) and inside(0.5, 2.0) and not inside(2.0, 2.0) and not inside(5.0, 1.0)


def test_business_days(spark):
    assert one(spark, timez.day_start(F.lit("2024-07-01").cast("date"))) == datetime.datetime(2024, 6, 30, 21)
    assert one(spark, timez.local_week(F.lit("2024-01-07 22:30:00").cast("timestamp"))) == day(2024, 1, 8)


def test_asof_ties_open_ends_and_missing_keys(spark):
    dim = spark.createDataFrame([(1, 0, day(2024, 1, 1), None, 10.0), (1, 1, day(2024, 3, 1), day(2024, 3, 31), 20.0), (1, 2, day(2024, 3, 1), None, 30.0), (1, 3, None, None, 40.0)], "k int, pos int, valid_from date, valid_to date, v double")
    facts = spark.createDataFrame([(1, 1, day(2023, 1, 1)), (2, 1, day(2024, 2, 1)), (3, 1, day(2024, 3, 31)), (4, 1, day(2024, 4, 1)), (5, 2, day(2024, 4, 1)), (6, 1, None)], "id int, k int, d date")
    got = {r.id: r.v for r in joins.asof(facts, dim, ["k"], "d", ["v"]).collect()}
    assert got == {1: None, 2: 10.0, 3: 20.0, 4: 30.0, 5: None, 6: None}


def test_narrowest_bracket_wins_and_bounds_touch(spark):
    dim = spark.createDataFrame([(1, 0, 0.0, None, 1.0), (1, 1, 3.5, 7.5, 2.0), (1, 2, 7.5, 12.0, 3.0)], "k int, pos int, low double, high double, rate double").withColumns({"valid_from": F.lit("2020-01-01").cast("date"), "valid_to": F.lit(None).cast("date")})
    facts = spark.createDataFrame([(i, 1, x, day(2024, 1, 1)) for i, x in enumerate([1.0, 3.5, 7.5, 11.0, 40.0])], "id int, k int, x double, d date")
    assert [r.rate for r in joins.bracket(facts, dim, ["k"], "x", "d", ["rate"]).orderBy("id").collect()] == [1.0, 2.0, 2.0, 3.0, 1.0]


def test_a_missing_leg_stops_the_clock(spark):
    stops = spark.createDataFrame([(1, 1, None, 10.0), (1, 2, 30.0, None), (1, 3, None, 5.0), (1, 4, 20.0, 5.0)], "route_id long, seq int, leg_min double, service_min double")
    rows = sequences.schedule(stops, start=480).orderBy("seq").collect()
    assert [(r.arrival, r.departure) for r in rows] == [(480.0, 490.0), (520.0, 535.0), (None, None), (None, None)]


def test_breaks_and_rests(spark):
    stops = spark.createDataFrame([(1, 1, 300.0, 300.0, 0.0), (1, 2, 300.0, 300.0, 0.0), (1, 3, 0.0, 0.0, 0.0)], "route_id long, seq int, leg_min double, leg_km double, service_min double")
    rows = sequences.driving_rules(stops, start=0.0).collect()
    assert [(r.kind, r.arrival, r.departure, r.km) for r in rows] == [
        ("break", 270.0, 315.0, 270.0), ("stop", 345.0, 345.0, 30.0), ("rest", 585.0, 1245.0, 240.0), ("stop", 1305.0, 1305.0, 60.0), ("stop", 1305.0, 1305.0, 0.0)]
    by_route = sequences.driving_rules(stops.union(stops.withColumn("route_id", F.lit(2).cast("long"))).repartition(3)).groupBy("route_id").agg(F.sum("km").alias("km")).collect()
    assert sorted((r.route_id, r.km) for r in by_route) == [(1, 600.0), (2, 600.0)]


def test_thinned_trails_keep_ends_and_distances(spark):
    points = spark.createDataFrame([(1, i, 44.0 + i * 0.0001, 26.0) for i in range(200)] + [(2, 0, 44.0, 26.0)], "v long, i int, lat double, lon double")
    rows = sequences.thin_trail(points, "v", ["i"], 40.0).collect()
    kept = sorted(r.i for r in rows if r.v == 1)
    assert kept[0] == 0 and kept[-1] == 199 and all(b - a == 4 for a, b in zip(kept[:-2], kept[1:-1], strict=True)) and sum(r.v == 2 for r in rows) == 1
    assert sequences.thin_trail(points.where("v = 1"), "v", ["i"], 40.0, most=10).count() <= 11


def test_costs(spark):
    v = spark.createDataFrame([(1, None, 7.0, 30.0, 0.1, None, 0.25, None, 20.0, 15.0), (2, 3.0, 7.0, 30.0, None, None, None, 40.0, 20.0, None), (3, *[None] * 9)], "id int, cost_per_km double, fuel_price double, consumption double, toll_km double, depreciation_km double, maintenance_km double, hourly_wage double, company_wage double, cost_per_hour double")
    rates = {r.id: (r.per_km, r.per_hour) for r in analytics.cost_rates(v).collect()}
    assert rates == {1: (2.45, 20.0), 2: (3.0, 40.0), 3: (None, None)}
    runs = spark.createDataFrame([(2.0, 30.0, 10.0, 90.0, 3, 0.0), (None, None, 10.0, 90.0, 3, 5.0)], "per_km double, per_hour double, km double, minutes double, stops int, kg double")
    a, b = analytics.activity_cost(runs).collect()
    assert (a.total_cost, a.per_stop, a.per_kg) == (65.0, 21.67, None) and b.total_cost is None


def test_price_lines(spark):
    trips = spark.createDataFrame([(1, 100.0, 2.0, 50.0, 30.0), (2, None, 2.0, None, 10.0)], "tpo_id long, trip_rate double, km_rate double, min_km double, driven_km double")
    taxes = spark.createDataFrame([(1, 7, 1, 12.5), (1, 7, 2, 99.0), (1, 8, 3, None)], "tpo_id long, zone_id int, place int, rate double")
    extra = spark.createDataFrame([(2, "DM", 40.0, None), (2, "DM", None, 1.0)], "tpo_id long, code string, rate double, quantity double")
    manual = spark.createDataFrame([(2, 5.005)], "tpo_id long, amount double")
    got = {r.tpo_id: (r.n_lines, r.total, r.warnings) for r in pricing.totals(pricing.price_lines(trips, taxes, extra, manual)).collect()}
    assert got == {1: (4, 212.5, 1), 2: (3, 65.0, 0)} or got[2][1] == pytest.approx(65.01)


def test_reports(spark):
    assert one(spark, reporting.tonnes(F.lit(12345.0))) == 12.35 and one(spark, reporting.tonnes(F.lit(0.0))) is None
    ident = lambda *a: one(spark, reporting.run_identity(*map(F.lit, a)))
    assert ident(7, day(2024, 1, 2), "B 12 ABC", 1) == "trip:7" and ident(None, day(2024, 1, 2), "b-12 abc", 1) == "2024-01-02|B12ABC" and ident(None, None, " ", 9) == "_|id:9"
    rows = spark.createDataFrame([(1, "A ", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "x"), (5, " ", "x")], "id int, tpo string, k string")
    assert {r.id for r in reporting.flag_duplicates(rows, "tpo", "k").where("is_duplicate").collect()} == {1, 2}


def test_documents(spark):
    note = "AVIZ nr. AB-123\nTPO: 12O4567l\nCJ 12 XYZ\n02.01.2024\nbrut 12.345,5 kg\nnet 13000 kg\n12 paleti"
    docs = documents.findings(documents.extract_fields(spark.createDataFrame([(1, note), (2, ""), (3, None)], "id int, text string")), "2024-01-05")
    a, b, c = docs.orderBy("id").collect()
    assert (a.tpo, a.doc_no, a.plate, a.doc_date, a.gross_kg, a.net_kg, a.pallets) == ("12045671", "AB-123", "CJ12XYZ", day(2024, 1, 2), 12345.5, 13000.0, 12)
    assert [f.rule for f in a.findings] == ["doc_no_invalid", "gross_below_net"] and {f.rule for f in b.findings} == {f.rule for f in c.findings} == {"tpo_missing", "date_missing", "plate_missing"}
    routed = documents.route_to_review(docs.withColumn("c", F.lit(0.9)), {"c": True})
    assert {r.routing for r in routed.collect()} == {"hitl_required"}


def test_lists(spark):
    rows = spark.createDataFrame([(i, f"name_{i}%" if i % 2 else "Other", i % 3) for i in range(20)], "id int, name string, g int")
    assert rows.where(relational.like_escaped(F.col("name"), "_1%")).count() == 1
    assert relational.entity_scan(rows, {"g": None}, ["g"], [F.col("id")]).count() == 0
    p = relational.page(rows, [F.col("id")], 2, 8).collect()
    assert [r.id for r in p] == list(range(8, 16)) and p[0].total_rows == 20
    assert relational.search_all({"r": (rows, "id", ["name"])}, "o").count() == 0


def test_loads_do_not_overlap_and_lie_inside(spark):
    items = spark.createDataFrame([(r, i, i % 4, 0.6 + i % 3 * 0.3, 0.5 + i % 4 * 0.2, 0.4 + i % 5 * 0.3) for r in (1, 2) for i in range(40)], "route_id long, item_id long, stop_seq int, l double, w double, h double")
    rows = planning.pack(items, "route_id", 6.0, 2.4, 2.4).collect()
    assert len(rows) == 80
    for route in (1, 2):
        boxes = [(r.x, r.y, r.z, r.dl, r.dw, r.dh) for r in rows if r.route_id == route and r.x is not None]
        assert len(boxes) > 20
        for i, a in enumerate(boxes):
            assert a[0] + a[3] <= 6.001 and a[1] + a[4] <= 2.401 and a[2] + a[5] <= 2.401
            assert not any(all(a[k] < b[k] + b[k + 3] - 1e-6 and b[k] < a[k] + a[k + 3] - 1e-6 for k in range(3)) for b in boxes[:i])


def test_drivers_are_given_in_vehicle_order(spark):
    vehicles = spark.createDataFrame([(1, 1, 12), (1, 2, 12), (1, 3, 11), (1, 4, None)], "depot int, vehicle_id long, preferred long")
    drivers = spark.createDataFrame([(1, 11), (1, 12), (1, 13)], "depot int, driver_id long")
    got = {r.vehicle_id: r.driver_id for r in planning.assign_drivers(vehicles, drivers, "depot").collect()}
    assert got == {1: 12, 2: 11, 3: 13, 4: None}


def test_territories_hold_every_location_once(spark):
    places = spark.createDataFrame([(i % 2, i, 44 + i % 17 / 10, 25 + i % 13 / 10, float(1 + i % 5)) for i in range(120)], "depot int, location_id long, lat double, lon double, weight double")
    rows = planning.territories(places, "depot", 4).collect()
    assert sorted(r.location_id for r in rows) == list(range(120)) and {r.cluster for r in rows} == {0, 1, 2, 3}
    square = spark.createDataFrame([(1, x, y) for x, y in [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0)]], "g int, x double, y double")
    assert len(planning.hull(square, "g").first().ring) == 4


def test_the_stream_finds_what_the_batch_finds(spark):
    from haulspark.operators import telematics as tele

    placed = tele.nearest_stop(t.positions(spark, SF), t.vehicle_stops(spark, SF))
    batch = tele.exceptions_of(tele.idle_minutes(placed).join(t.vehicle_plan(spark, SF), "vehicle_id", "left"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(exceptions_to_the_end(spark, SF)) == key(batch)


def test_delimited_files_are_sniffed_and_mapped(spark, tmp_path):
    from haulspark.operators.imports import import_plan
    from haulspark.sources.spreadsheets import fold_header, map_headers, read_orders, sniff_delimiter

    assert sniff_delimiter('a;"b;,,,c";d') == ";" and sniff_delimiter("a\tb,c\td") == "\t" and sniff_delimiter("one") == ","
    assert fold_header(" Număr_comandă ") == "numar comanda"
    assert map_headers(["Nr.", "Număr", "Foo", "KG"]) == ({"order_number": "Nr.", "weight_kg": "KG"}, ["Foo"], ["Număr"])
    (tmp_path / "in.csv").write_text('﻿Nr comandă;Locație;Data;Greutate;Foo\r\nA1;"Depozit; Nord";05.03.2024;1.234,5;x\r\n;;;;\r\nA1;depozit nord;06.03.2024;-3;\r\n;nowhere;;;\r\n', encoding="utf-8")
    rows = read_orders(spark, str(tmp_path / "in.csv"))
    assert rows.count() == 3
    places = spark.createDataFrame([(7, "Depozit Nord")], "location_id long, name string")
    clients = spark.createDataFrame([], "client_id long, name string")
    plan = import_plan(rows.withColumn("row_no", F.monotonically_increasing_id()), places, clients, spark.createDataFrame([], "order_number string")).orderBy("row_no").collect()
    assert [(r.action, r.order_number, r.location_id, r.weight_kg) for r in plan] == [("create", "A1", 7, 1234.5), ("error", "A1", 7, 0.0), ("error", None, None, 0.0)]
    assert plan[1].errors == ["weight_kg_negative"] and set(plan[2].errors) == {"number_missing", "date_missing", "location_unknown"}


def test_pages_are_rebuilt_and_split(spark):
    from haulspark.operators.lifecycle import join_rows_of_pages, merged_into, split_pages

    items = spark.createDataFrame([(1, 10.0, 700.0, 20.0, "a"), (1, 32.0, 699.0, 10.0, "b"), (1, 90.0, 701.0, 5.0, "c"), (1, 10.0, 650.0, 5.0, "d")], "page_id long, x double, y double, width double, text string")
    assert [(r.line_no, r.text) for r in join_rows_of_pages(items).orderBy("line_no").collect()] == [(1, "a b\tc"), (2, "d")]
    pages = spark.createDataFrame([(1, 1, ["x"]), (1, 2, []), (1, 3, ["y", "x"]), (1, 4, ["y"]), (1, 5, ["z"]), (2, 1, ["x"]), (2, 2, None)], "doc_id long, page_no int, keys array<string>")
    assert {(r.doc_id, r.page_no): r.part for r in split_pages(pages).collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): 2, (2, 1): 1, (2, 2): 1}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 4)], "id long, into_id long")
    assert {r.id: r.final_id for r in merged_into(loop, "id", "into_id").collect()} == {1: 3, 2: 3, 3: 3, 4: 4}


def test_walks_join_groups_that_batches_cut(spark):
    from haulspark.operators.grouped import walk_groups

    rows = spark.range(300).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = walk_groups(rows, "g", ["v"], lambda key, cols: [(key, len(cols["v"]), int(cols["v"] == sorted(cols["v"])))], "g long, n int, ok int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.g, r.n, r.ok) for r in got) == [(g, len(range(g, 300, 7)), 1) for g in range(7)]


def test_the_latest_position_of_a_stream_is_that_of_the_batch(spark):
    from haulspark.operators.telematics import latest_positions
    from haulspark.streaming.telematics import stream_latest

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    samples = events.select("event_id", F.col("user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("speed"), F.lit(44.0).alias("lat"), F.lit(26.0).alias("lon"))
    run = stream_latest(samples).writeStream.format("memory").queryName("latest_now").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    want = {(r.vehicle_id, r.event_id) for r in latest_positions(t.positions(spark, SF)).collect()}
    assert {(r.vehicle_id, r.event_id) for r in spark.table("latest_now").collect()} == want
