"""Workbooks, loads on a grid, live sinks, addresses and edges of the newer operators."""

import zipfile

import pytest
from pyspark.sql import functions as F

from haulspark.functions import address, geo, goods, text
from haulspark.operators import dispatch, fleet, lifecycle, planning, selection, upkeep
from haulspark.operators.joins import known_address, small, zone_of
from haulspark.sources import workbooks

SF = "/root/testdata/sf0.001"


def test_workbooks_are_read_back_with_totals_and_merges(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "T1", "a & <b>", 1.5), (1, 2, "T1", None, 2.25), (1, 3, "T2", "c", None), (2, 1, " x ", "é", 4.0)], "report long, n int, tpo string, name string, km double")
    made = workbooks.workbooks(rows.repartition(3), "report", ["tpo", "name", "km"], ["n"], ["km"], ["tpo"]).collect()
    for r in made:
        (tmp_path / f"r{r.report}.xlsx").write_bytes(bytes(r.content))
    got = {(r.file, r.row_no): r.cells for r in workbooks.read_workbooks(spark, str(tmp_path)).collect()}
    assert got == {
        ("r1.xlsx", 1): ["tpo", "name", "km"], ("r1.xlsx", 2): ["T1", "a & <b>", "1.5"], ("r1.xlsx", 3): ["T1", None, "2.25"], ("r1.xlsx", 4): ["T2", "c"], ("r1.xlsx", 5): ["Total", None, "3.75"],
        ("r2.xlsx", 1): ["tpo", "name", "km"], ("r2.xlsx", 2): [" x ", "é", "4.0"], ("r2.xlsx", 3): ["Total", None, "4.0"],
    }
    sheet = zipfile.ZipFile(tmp_path / "r1.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert '<mergeCell ref="A2:A3"/>' in sheet and sheet.count("mergeCell ") == 1


def test_shared_strings_and_gaps_are_read():
    import io

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AB2" t="b"><v>1</v></c></row><row r="3"/></sheetData></worksheet>'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{links}"><sheets><sheet name="x" sheetId="1" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="q" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>no</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
    assert workbooks.sheet_rows(data.getvalue()) == [(2, [None, "rich", *[None] * 25, "true"])]
    assert [workbooks.column_name(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


@pytest.mark.parametrize("loader", ["grid", "corners"])
def test_loads_lie_inside_and_do_not_collide(spark, loader):
    rows = spark.createDataFrame([(r, i, i % 4, 0.6 + i % 3 * 0.4, 0.4 + i % 4 * 0.2, 0.4 + i % 5 * 0.3, i % 6 != 0, i % 2 == 0) for r in (1, 2) for i in range(60)], "plan_id long, item_id long, stop_seq int, l double, w double, h double, stackable boolean, tip boolean")
    made = planning.grid_load(rows, "plan_id", 6.0, 2.4, 2.4) if loader == "grid" else planning.pack(rows, "plan_id", 6.0, 2.4, 2.4)
    boxes = made.select("plan_id", "item_id", "x", "y", "z", F.col("dl").alias("l"), F.col("dw").alias("w"), F.col("dh").alias("h"))
    inside = boxes.where("x is not null")
    assert made.count() == 120 and inside.count() > 40 and inside.where("x + l > 6.0001 or y + w > 2.4001 or z + h > 2.4001").count() == 0
    assert fleet.collisions(boxes).count() == 0
    again = {r.item_id: r for r in inside.where("plan_id = 1").collect()}
    told = {r.item_id: sorted((round(r.l, 6), round(r.w, 6), round(r.h, 6))) for r in rows.where("plan_id = 1").collect()}
    assert all(sorted((round(r.l, 6), round(r.w, 6), round(r.h, 6))) == told[i] for i, r in again.items())
    if loader == "grid":
        blocked = rows.where("plan_id = 1 and not stackable").select("item_id").join(inside.where("plan_id = 1"), "item_id").collect()
        assert not any(o.z > b.z and o.x < b.x + b.l - 1e-6 and b.x < o.x + o.l - 1e-6 and o.y < b.y + b.w - 1e-6 and b.y < o.y + o.w - 1e-6 for b in blocked for o in again.values())


def test_a_live_sink_sends_each_company_its_rows(spark, tmp_path):
    from haulspark.streaming.runs import publish

    spark.range(50).select("id", (F.col("id") % 3).alias("company"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(f"{tmp_path}/in")
    sent = {}
    stream = spark.readStream.schema("id long, company long, ts timestamp").parquet(f"{tmp_path}/in")
    publish(stream, "company", lambda company, rows: sent.setdefault(company, []).extend(rows), f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {c: len(r) for c, r in sent.items()} == {0: 17, 1: 17, 2: 16} and '"id":0' in "".join(sent[0])


def test_windows_drop_what_comes_after_the_watermark(spark, tmp_path):
    from haulspark.streaming.telematics import counted_by_hour

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, speed double").parquet(f"{tmp_path}/in")
    for rows in (["2024-01-01 10:10:00", "2024-01-01 10:20:00"], ["2024-01-01 13:00:00"], ["2024-01-01 10:30:00", "2024-01-01 15:00:00"]):
        spark.createDataFrame([(r,) for r in rows], "ts string").select(F.col("ts").cast("timestamp").alias("ts"), F.lit(1.0).alias("speed")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = counted_by_hour(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted((r.start.hour, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(10, 2), (13, 1)]


def test_addresses(spark):
    rows = spark.createDataFrame([("or. Turda, com. Aiton, str. X nr. 5B",), ("jud. CJ",), ("400123 Cluj Napoca",), (None,), ("Str. Al. Odobescu 5, Drobeta-Turnu Severin",)], "t string")
    p = [r.p for r in rows.select(address.parse(F.col("t")).alias("p")).collect()]
    assert (p[0].city, p[0].county, p[0].is_rural, p[0].house_number) == ("turda", "CJ", True, "5b")
    assert (p[1].county, p[1].city, p[1].street) == ("CJ", None, None) and p[2].postcode == "400123" and p[3].raw == "" and (p[4].city, p[4].county) == ("drobeta turnu severin", "MH")
    keys = rows.select(address.address_key(address.parse(F.col("t"))).alias("k")).collect()
    assert [k.k for k in keys][3] is None and keys[4].k == "mh|drobeta turnu severin|strada al odobescu 5"
    codes = spark.createDataFrame([("87015",), ("087015",), ("8701",), (None,)], "t string").select(address.postcode(F.col("t")).alias("p")).collect()
    assert [c.p for c in codes] == ["087015", "087015", None, None]


def test_zones_of_nothing(spark):
    zones = spark.createDataFrame([], "zone_id int, priority int, pos int, active boolean, polygons array<array<array<struct<lon:double,lat:double>>>>, counties array<string>, cities array<string>, postcodes array<string>")
    points = spark.createDataFrame([(1, None, None, None, None, None), (2, 26.0, 44.0, "x", "B", "010101")], "id int, lon double, lat double, city string, county string, postcode string")
    assert [(r.zone_id, r.matched_by) for r in zone_of(points, zones).collect()] == [(None, None)] * 2


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(2).select("id", F.expr("array_repeat('x', 50)").alias("v"))
    plan = lambda most: small(wide, wide, most)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(10_000).lower() and "broadcast" not in plan(100).lower()


def test_file_names_and_selections(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a", "a", "a-1", "a", "x\\y.pdf", "x/y.pdf", None, ".env", ".env"])], "z int, i int, name string")
    got = [r.unique_name for r in lifecycle.unique_names(rows, "z", "name", ["i"]).orderBy("i").collect()]
    assert got == ["a", "a-1", "a-1-1", "a-2", "x/y.pdf", "x/y-1.pdf", "file", ".env", ".env-1"] and len(set(got)) == len(got)
    with pytest.raises(ValueError):
        selection.select_documents(rows, {"q": "  ", "ids": []})
    assert selection.unique_ids([3, None, 3, 0, 4], 2) == [3, 4] and selection.clean_filters({"limit": -4})["limit"] == 1


def test_upserts_and_empty_tables(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "new", 2), (2, "newer", 1), (3, "c", 1)], "k int, v string, o int")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(upkeep.upsert(target, rows, ["k"], [F.col("o")])) == [(1, "a"), (2, "newer"), (3, "c")]
    assert plain(upkeep.upsert(target, rows, ["k"], [F.col("o")], update=False)) == [(1, "a"), (2, "b"), (3, "c")]
    assert plain(upkeep.upsert(target.limit(0), rows.limit(0), ["k"], [F.col("o")])) == []
    with pytest.raises(ValueError):
        from haulspark.operators.joins import distance_matrix

        distance_matrix(spark.range(201).select("id", F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")))


def test_geometry_of_holes_and_needles(spark):
    g = F.lit('{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]],[[[9,9],[10,9],[10,10],[9,9]]]]}')
    hit = lambda x, y: spark.range(1).select(geo.in_polygons(F.lit(x), F.lit(y), geo.geojson_polygons(g)).alias("v")).first().v
    assert hit(0.5, 0.5) and not hit(1.5, 1.5) and hit(9.9, 9.5) and not hit(5.0, 5.0)
    short = spark.range(1).select(geo.ring_metrics(F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")))).alias("m")).first().m
    assert (short.area, short.perimeter, short.compactness) == (0.0, 0.0, 0.0)


def test_known_addresses_of_nothing(spark):
    stored = spark.createDataFrame([], "address_id int, postcode string, locality string, street_name string, display string, disabled boolean, verified boolean, source string, seen_count int")
    rows = spark.createDataFrame([(1, "077015", None, None)], "id int, postcode string, locality string, hints array<string>")
    assert [(r.address_id, r.reason, r.candidates) for r in known_address(rows, stored).collect()] == [(None, "unknown_postcode", 0)]


def test_plans_of_nothing(spark):
    orders = spark.createDataFrame([], "order_id long, lat double, lon double, type string, weight_kg double, volume_m3 double, pallets double, service_min double, window_start string, window_end string")
    jobs, dropped = dispatch.solver_jobs(orders, orders.select("order_id"))
    assert jobs.count() == dropped.count() == 0
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(dispatch.time_window(F.lit(None).cast("string"), F.lit("08:30"))) == [0, 30600] and one(dispatch.time_window(F.lit("22:00"), F.lit("06:00"))) == [79200, 86400]
    assert one(goods.goods_unit(F.lit("  "))) is None and one(text.email_kind(F.lit(None).cast("string"))).valid is False
