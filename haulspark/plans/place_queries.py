"""Places and papers: known addresses, coordinates, outlines, packaging, scans, dates, the rules of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions import geo, goods, scans, text
from haulspark.operators import backfill, documents, fleet, sheets
from haulspark.operators.grouped import dealt
from haulspark.operators.joins import known_address
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sql(rows: list[tuple]) -> str:
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) + "::double" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(cell, row))})" for row in rows)


_KNOWN = [  # id, postcode, town, street, display, disabled, verified, source, seen
    (1, "077015", "Balotești", "Curtea Domnească", "Str. Curtea Domnească nr. 5, Balotești", False, False, "parsed", 2),
    (2, "77015", "Balotești", "Industriei", "Str. Industriei nr. 7, Balotești", False, False, "parsed", 3),
    (3, "011234", "București", "Aviatorilor", "Bd. Aviatorilor nr. 72, București", False, True, "parsed", 1),
    (4, "011234", "București", "Pantelimon Construct", "Str. Pantelimon Construct SRL nr. 5OS", False, False, "parsed", 9),
    (5, "020202", "Otopeni", "Drumul Gării", "Drumul Gării nr. 1, Otopeni", True, True, "manual", 9),
    (6, "030303", "Cluj", "Fabricii", "Str. Fabricii nr. 3, Cluj", False, False, "parsed", 1),
    (7, "040404", "Iași", "Noua Srl", "Noua SRL nr. 1, Iași", False, False, "parsed", 5),
    (8, "050505", "Arad", "Republicii", "Str. Republicii nr. 1, Arad", False, False, "parsed", 5),
    (9, "050505", "Arad", "Republicii Noi", "Str. Republicii Noi nr. 2, Arad", False, False, "parsed", 5),
]
_ASKED = [  # postcode, town, hints, and what is found: id, reason, candidates
    (None, "Arad", "x", None, "no_postcode", 0), ("999999", "Arad", "x", None, "unknown_postcode", 0), ("020202", "Otopeni", "x", None, "no_trusted", 1), ("030303", "Cluj", "fabricii", None, "no_trusted", 1),
    ("077015", "Arad", "industriei", None, "locality_mismatch", 2), ("040404", "iasi", "noua", None, "junk_filtered", 1), ("011234", "BUCURESTI", "zzzz", 3, None, 1), ("077015", "balotesti", "domneasca,xyz", 1, None, 2),
    ("77015", None, "lndustriei", 2, None, 2), ("077015", "Balotești", "zzzzzzz", None, "below_threshold", 2), ("050505", "Arad", "republicii", None, "ambiguous", 2),
]


@query(f"with a(i, found, reason, candidates) as (values {_sql([(i, *r[3:]) for i, r in enumerate(_ASKED)])}) select c_custkey as id, found as address_id, reason, candidates from customer join a on i = c_custkey % {len(_ASKED)}")
def known_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose postcode, town and garbled street are known, against a memory of nine addresses."""
    stored = spark.createDataFrame(_KNOWN, "address_id int, postcode string, locality string, street_name string, display string, disabled boolean, verified boolean, source string, seen_count int")
    asked = spark.createDataFrame([(i, *r[:2], r[2].split(",")) for i, r in enumerate(_ASKED)], "i long, postcode string, locality string, hints array<string>")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % len(_ASKED)).alias("i")).join(F.broadcast(asked), "i")
    return known_address(rows, stored).select("id", "address_id", "reason", "candidates")


@query("""
with r as (select c_custkey as id, 'k' || (c_custkey % 60) as address_key from customer), l as (select 'k' || (s_suppkey % 60) as address_key, min(s_suppkey) as id from supplier where s_suppkey % 2 = 0 and s_suppkey % 5 <> 0 group by 1), c as (select 'k' || (p_partkey % 60) as address_key, min(p_partkey) as id from part where p_partkey % 3 = 0 group by 1)
select r.id, r.address_key, case when l.id is not null then l.id / 10 + 44 else c.id / 10 + 45 end as lat, case when l.id is not null then l.id / 10 + 26 else c.id / 10 + 27 end as lon, case when l.id is not null then 'locations' when c.id is not null then 'geocode_cache' end as coordinate_source
from r left join l using (address_key) left join c using (address_key)""")
def coordinate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("k"), (F.col(c) % 60).cast("string")).alias("address_key")
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    locations = table(spark, sf_dir, "supplier").where(s % 2 == 0).select(s.alias("id"), key("s_suppkey"), F.when(s % 5 != 0, s / 10 + 44).alias("lat"), (s / 10 + 26).alias("lon"))
    cache = table(spark, sf_dir, "part").select(p.alias("id"), key("p_partkey"), F.when(p % 3 == 0, "hit").otherwise("miss").alias("status"), (p / 10 + 45).alias("lat"), (p / 10 + 27).alias("lon"))
    return fleet.known_coordinates(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), key("c_custkey")), locations, cache)


@query("""
with e as (select c_custkey, case c_custkey % 4 when 0 then 'accept' when 1 then 'review' when 2 then 'reject' end as action, c_custkey % 5 = 0 as cached, c_custkey % 9 = 0 as failed from customer)
select count(*) as total, count(*) filter (where action = 'accept') as accepted, count(*) filter (where action = 'review') as review, count(*) filter (where action is null or action = 'reject') as rejected, count(*) filter (where cached) as cached, count(*) filter (where failed) as errors from e""")
def lookup_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    action = F.when(k % 4 == 0, "accept").when(k % 4 == 1, "review").when(k % 4 == 2, "reject")
    return fleet.lookup_tally(table(spark, sf_dir, "customer").select(action.alias("action"), (k % 5 == 0).alias("cached"), F.when(k % 9 == 0, "timeout").alias("error")))


_HARBOUR = """
own as (select 'client' as source, c_custkey as source_id, c_custkey as client_id, 'Str. Fabricii ' || (c_custkey % 40) || ', Cluj-Napoca' as address, c_custkey % 40 as n, 'cj|cluj napoca|strada fabricii ' || (c_custkey % 40) as key, 0 as r, c_custkey % 2 = 0 as has_phone from customer where c_custkey % 10 <> 0),
trips as (select l_orderkey * 10 + l_linenumber as trip_id, l_partkey, l_suppkey from lineitem where l_linenumber <= 2),
ship as (select 'trip_shipper', min(trip_id), null::bigint, null, l_partkey % 60 as n, 'cj|cluj napoca|strada fabricii ' || (l_partkey % 60) as key, 1 as r, false from trips group by l_partkey % 60),
every_ as (select source, source_id, client_id, n, key, r from own union all select 'trip_shipper', trip_id, null, l_partkey % 60, 'cj|cluj napoca|strada fabricii ' || (l_partkey % 60), 1 from trips),
known as (select 'cj|cluj napoca|strada fabricii ' || i as key from range(0, 60, 7) t(i))"""


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, p = F.col("c_custkey"), F.col("l_partkey")
    clients = table(spark, sf_dir, "customer").select(
        k.alias("client_id"), F.col("c_name").alias("name"), F.concat(F.lit("RO "), (k + 1000).cast("string")).alias("tax_id"),
        F.when(k % 10 != 0, F.concat(F.lit("Str. Fabricii "), (k % 40).cast("string"), F.lit(", Cluj-Napoca"))).otherwise("  ").alias("address"), F.lit(None).cast("string").alias("contact"), F.when(k % 2 == 0, "1").alias("phone"),
    )
    blank = F.lit(None).cast("string")
    trips = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trip_id"), blank.alias("shipper_name"), F.concat(F.lit("Cluj Napoca, Strada Fabricii nr. "), (p % 60).cast("string")).alias("shipper_address"), blank.alias("shipper_tax_id"), blank.alias("shipper_contact"),
        blank.alias("shipper_phone"), F.lower(F.concat(F.lit("customer#"), F.lpad((p % 50).cast("string"), 9, "0"))).alias("consignee_name"), F.when(p % 3 == 0, ", ,").otherwise("").alias("consignee_address"), F.when(p % 6 == 0, F.concat((p % 50 + 1000).cast("string"), F.lit("!"))).alias("consignee_tax_id"),
        blank.alias("consignee_contact"), blank.alias("consignee_phone"),
    )
    known = spark.range(0, 60, 7).select(F.concat(F.lit("cj|cluj napoca|strada fabricii "), F.col("id").cast("string")).alias("address_key"))
    return backfill.assessed(backfill.candidates(clients, trips)), known


@query(f"""
with {_HARBOUR}, b as (select key, arg_min(source, struct_pack(r := r, i := source_id)) as source, arg_min(n, struct_pack(r := r, i := source_id)) as n, min(client_id) as client_id, count(*) as sources from every_ where key not in (select key from known) group by 1)
select key as address_key, source, client_id, sources, 'cluj napoca' as city, 'CJ' as county, case when source = 'client' then 'Str. Fabricii ' || n else 'Strada Fabricii nr. ' || n end as address from b""")
def location_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations from clients and trips whose addresses are written in two ways, but for those on file."""
    rows, known = _candidates(spark, sf_dir)
    one = backfill.one_an_address(rows, known)
    written = backfill.location_rows(one).join(one.select("address_key", "source", "sources"), "address_key")
    return written.select("address_key", "source", "client_id", "sources", "city", "county", "address")


@query(f"""
with {_HARBOUR}, blanks as (select count(*) as n from lineitem where l_linenumber <= 2 and l_partkey % 3 = 0), x as (select key, key in (select key from known) as old from every_)
select count(*) + (select n from blanks) as candidates, count(distinct case when not old then key end) as new_addresses, count(*) filter (where not old) - count(distinct case when not old then key end) as merged, count(*) filter (where old) as skipped_existing,
       (select n from blanks) as unusable, count(*) as good, 0::bigint as review, (select n from blanks) as poor from x""")
def backfill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known = _candidates(spark, sf_dir)
    return backfill.summary(rows, known).select("candidates", "new_addresses", "merged", "skipped_existing", "unusable", "good", "review", "poor")


@query("""
with r as (select s_suppkey as id, s_suppkey % 20 + 1 as a, s_suppkey % 7 + 1 as b, 44.0::double as lat from supplier),
m as (select *, 111320.0::double * cos(radians((lat + lat + (lat + b / 1000) + (lat + b / 1000) + lat) / 5)) as mx from r),
s as (select id, a / 1000 * mx * b / 1000 * 110540 as area, 2 * (a / 1000 * mx + b / 1000 * 110540) as perimeter from m)
select id, floor(area + 0.5)::bigint as area, floor(perimeter + 0.5)::bigint as perimeter, floor(4 * pi() * area / (perimeter * perimeter) * 1000 + 0.5) / 1000 as compactness, case when id % 3 = 0 then 1 else 0 end::int as spikes, true as boxed from s""")
def ring_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, length and compactness of rectangles drawn as GeoJSON; every third outline has a needle, which is reported."""
    k = F.col("s_suppkey")
    at = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    w, h = 26 + (k % 20 + 1) / 1000, 44 + (k % 7 + 1) / 1000
    corners = [at(F.lit(26.0), F.lit(44.0)), at(w, F.lit(44.0)), at(w, h), at(F.lit(26.0), h), at(F.lit(26.0), F.lit(44.0))]
    outline = lambda points: F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *points), F.lit("]]}"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), outline(corners).alias("g"), outline([corners[0], corners[1], at(w + 0.05, F.lit(44.0001)), at(w, F.lit(44.0002)), *corners[2:]]).alias("needle"))
    ring = lambda c: geo.geojson_polygons(F.col(c))[0][0]
    rows = rows.select("id", ring("g").alias("ring"), ring("needle").alias("needle")).withColumn("m", geo.ring_metrics(F.col("ring"))).withColumn("b", geo.ring_bounds(F.col("ring")))
    spikes = F.when(F.col("id") % 3 == 0, F.size(geo.ring_spikes(F.col("needle")))).otherwise(F.size(geo.ring_spikes(F.col("ring"))))
    return rows.select(
        "id", F.floor(F.col("m.area") + 0.5).alias("area"), F.floor(F.col("m.perimeter") + 0.5).alias("perimeter"), (F.floor(F.col("m.compactness") * 1000 + 0.5) / 1000).alias("compactness"),
        spikes.alias("spikes"), ((F.col("b.south") == 44.0) & (F.col("b.west") == 26.0) & (F.col("b.north") > 44) & (F.col("b.east") > 26)).alias("boxed"),
    )


@query("select c_custkey as id, printf('%.5f,%.5f', 44 + c_custkey / 70.0::double, 26 - c_custkey / 30.0::double) as key from customer")
def coordinate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), geo.coordinate_key(44 + k / 70, 26 - k / 30).alias("key"))


_UNITS = [
    ("Saci", "saci"), ("sac hârtie", "saci"), ("saci / găleți", "saci / galeti"), ("GĂLEȚI/SACI", "saci / galeti"), ("galeata", "galeti"), ("pal.", "paleti"), ("bucăți", "bucati"), ("PCS", "bucati"), ("m³", "m³"), ("mc", "m³"), ("M3", "m³"),
    ("colete", "colete"), ("saci/bucati", "saci / bucati"), ("tone", None), ("", None), (None, None), ("role", "role"),
]


@query(f"with u(i, raw, unit) as (values {_sql([(i, *u) for i, u in enumerate(_UNITS)])}) select p_partkey, unit, coalesce(unit = 'bucati', false) as only_counts from part join u on i = p_partkey % {len(_UNITS)}")
def packaging_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*[F.lit(u).cast("string") for u, _ in _UNITS]), (F.col("p_partkey") % len(_UNITS)).cast("int"))
    return table(spark, sf_dir, "part").withColumn("unit", goods.goods_unit(raw)).select("p_partkey", "unit", goods.only_counts(F.col("unit")).alias("only_counts"))


@query("""
with a as (select l_orderkey, l_linenumber, case when l_partkey % 4 <> 0 then l_extendedprice end as value, case when l_partkey % 5 <> 0 then l_quantity end as km, case when l_partkey % 3 <> 0 then l_discount * 100 end as tariff from lineitem)
select l_linenumber as line, cast(sum((floor(coalesce(km, 0) * coalesce(tariff, 0) * 100 + 0.5) / 100)::decimal(28,4)) as double) as by_km, cast(sum(coalesce(value, 0)::decimal(28,4)) as double) as by_order from a group by 1""")
def annex_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    value, km, tariff = F.when(p % 4 != 0, F.col("l_extendedprice")), F.when(p % 5 != 0, F.col("l_quantity")), F.when(p % 3 != 0, F.col("l_discount") * 100)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), goods.annex_amount(value, km, tariff, "km_tarif").alias("a"), goods.annex_amount(value, km, tariff, "tpo").alias("b"))
    return rows.groupBy("line").agg(F.sum(F.col("a").cast("decimal(28,4)")).cast("double").alias("by_km"), F.sum(F.col("b").cast("decimal(28,4)")).cast("double").alias("by_order"))


_SCANS = [  # as scanned, cleaned, and with its codes read; null where cleaning is all
    ("Greutate brutä  12 kg\r\n\r\n\r\n\r\nsfârșit", "Greutate brută 12 kg\n\nsfârșit", None), ("| Nr | Km |\n|---|---|\n| 1 | 420 |\nTotal ...... 9 ####", "Nr Km\n\n1 420\nTotal 9", None),
    ("| 7 | **72.00** | buc |", "7 72.00 buc", None), ("Str. 20, Balote$i și chi$inău, $12", "Str. 20, Balotești și chișinău, $12", None), ("„unu”\u00a0– \u2018doi\u2019 \u2212 5\u2026", "\"unu\" - 'doi' - 5\u2026", None),
    ("Adresă\0Client\nstr  Garlei\tALEEA   1", "Adresă\tClient\nstr Garlei\tALEEA 1", None), ("TP\u200b0-O0&5813 și PSL O12345", "TP0-O0&5813 și PSL O12345", "TPO-005813 și PSL-012345"),
    ("expeditiePSL-0012345 transport_TPO-0033395", "expeditiePSL-0012345 transport_TPO-0033395", "expeditie PSL-0012345 transport TPO-0033395"),
    ("Comanda de transfer TPO-0010692\nAviz de expediție rezumat: TPO-0033395", "Comanda de transfer TPO-0010692\nAviz de expediție rezumat: TPO-0033395", "Comanda de transfer TRO-0010692\nAviz de expediție rezumat: TPO-0033395"),
    ("TRO-OOI\n1300\nx IRO-OOI 1300", "TRO-OOI\n1300\nx IRO-OOI 1300", "TRO-0011300\nx TRO-0011300"), ("B33oSRS, b 1l2 vfm, B OO SRS; 5 s ac 02.10.202O", "B33oSRS, b 1l2 vfm, B OO SRS; 5 s ac 02.10.202O", "B 330 SRS, B 112 VFM, B OO SRS; 5 sac 02.10.2020"),
    ("Str. Kepublicii, Bolintin dina, Bd. Piperii", "Str. Kepublicii, Bolintin dina, Bd. Piperii", "Str. Republicii, Bolintin-Deal, Bd. Pipera"), ("TPO 2026-1088 TPO 12", "TPO 2026-1088 TPO 12", "TPO-2026-1088 TPO 12"), ("", "", ""), (None, None, None),
]


@query(f"with s(i, clean, codes) as (values {_sql([(i, c, k if k is not None else c) for i, (_, c, k) in enumerate(_SCANS)])}) select c_custkey as id, clean, codes from customer join s on i = c_custkey % {len(_SCANS)}")
def scan_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans as they come, cleaned, and with the codes and plates that they print."""
    raw = F.get(F.array(*[F.lit(r).cast("string") for r, *_ in _SCANS]), (F.col("c_custkey") % len(_SCANS)).cast("int"))
    return dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("id"), scans.clean_scan(raw).alias("clean"), scans.scanned_codes(raw).alias("codes"))


@query("""
with e as (select c_custkey as id, case c_custkey % 5 when 0 then ' Ana' || c_custkey || '@GMAIL.com ' when 1 then 'office@firma' || (c_custkey % 7) || '.ro' when 2 then 'no at sign' when 3 then 'a@b@yahoo.co.uk' else null end as email from customer)
select id, case id % 5 when 0 then 'gmail.com' when 1 then 'firma' || (id % 7) || '.ro' when 3 then 'yahoo.co.uk' else '' end as domain, id % 5 in (0, 3) as personal, id % 5 in (0, 1) as valid from e""")
def email_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    email = F.when(k % 5 == 0, F.concat(F.lit(" Ana"), k.cast("string"), F.lit("@GMAIL.com "))).when(k % 5 == 1, F.concat(F.lit("office@firma"), (k % 7).cast("string"), F.lit(".ro"))).when(k % 5 == 2, "no at sign").when(k % 5 == 3, "a@b@yahoo.co.uk")
    return table(spark, sf_dir, "customer").select(k.alias("id"), text.email_kind(email).alias("e")).select("id", "e.*")


_PRINTED = [  # day, month, year and what is read on 2026-10-19
    (1, 10, 2026, "2026-10-01", 0.9, False), (1, 10, 26, "2026-10-01", 0.9, False), (21, 9, 202, "2026-09-21", 0.55, True), (5, 3, 2020, "2026-03-05", 0.55, True), (5, 3, 2024, "2026-03-05", 0.55, True), (20, 10, 2026, "2026-10-20", 0.9, False),
    (21, 10, 2026, "2026-10-21", 0.9, False), (1, 1, 2019, "2019-01-01", 0.9, False), (15, 9, 2025, "2025-09-15", 0.9, False), (15, 8, 2025, "2025-08-15", 0.9, False), (32, 1, 2026, None, None, None), (1, 13, 2026, None, None, None), (1, 1, 1889, None, None, None), (None, 1, 2026, None, None, None),
]


@query(f"with p(i, d, m, y, date, confidence, repaired) as (values {_sql([(i, *p) for i, p in enumerate(_PRINTED)])}) select p_partkey, date, confidence, repaired from part join p on i = p_partkey % {len(_PRINTED)}")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed dates of which scans garble the year, read on one day."""
    parts = spark.createDataFrame([(i, *p[:3]) for i, p in enumerate(_PRINTED)], "i long, d int, m int, y int")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(_PRINTED)).alias("i")).join(F.broadcast(parts), "i")
    return rows.select("p_partkey", text.resolved_date(F.col("d"), F.col("m"), F.col("y"), F.lit("2026-10-19").cast("date")).alias("r")).select("p_partkey", "r.date", "r.confidence", "r.repaired")


@query("select c_custkey as id, case when c_custkey % 3 <> 0 then lpad((c_custkey % 1440 // 60)::varchar, 2, '0') || ':' || lpad((c_custkey % 60)::varchar, 2, '0') end as clock from customer")
def minutes_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), text.minutes_clock(F.when(k % 3 != 0, k - 2880)).alias("clock"))


_PAPERS = [  # columns, printed text, and the rules they break (dated 2026-10-19)
    ({"tpo": "TPO-0035189", "doc_no": "PSL-0012", "plate": "B 330 SRS", "doc_date": "2026-10-18", "route": "a / b", "goods": "saci", "quantity": "40", "gross_kg": 22000.0, "net_kg": 21000.0}, "", ""),
    ({}, "Aviz de expediție\nGreutate brută 12.345\nCantitate\nAdresa de livrare: x", "tpo_missing,date_missing,plate_missing,doc_no_missing,weights_missing,weights_missing,ruta_missing,goods_missing,goods_missing"),
    ({"tpo": "abc", "doc_no": "220", "plate": "TM 40 KG", "date_text": "soon", "quantity": "-3", "gross_kg": 12.0, "net_kg": -1.0}, "", "tpo_invalid,date_unparseable,plate_implausible,doc_no_invalid,quantity_invalid,weight_invalid,weight_implausible_low"),
    ({"tpo": "1234567", "doc_no": "TRO 55", "plate": "CA 4471 KX / B 63 RTX", "doc_date": "2024-10-18", "goods": "x", "gross_kg": 900.0, "net_kg": 1000.0}, "corectat la încărcare", "date_wrong_year,hand_correction_on_document,hand_correction_on_document,gross_below_net"),
    ({"tpo": "1234567", "plate": "CJ 12 ABC", "doc_date": "2026-10-21", "goods": "x", "net_kg": 1000.0}, "TPO 1234567, TPO 7654321; Masa brută", "multiple_avize_in_image,date_in_future,gross_missing_near_net"),
    ({"tpo": "1234567", "plate": "CJ 12 ABC", "doc_date": "2026-10-20", "goods": "x", "gross_kg": 1000.0, "route": "r"}, "Net weight; adresa de livrare A, adrese de livrare B", "net_missing_near_gross,delivery_address_ambiguous"),
    ({"tpo": "1234567", "plate": "CJ 12 ABC", "doc_date": "2026-10-20", "goods": "x", "c_tpo": 0.5, "c_goods": 0.6, "dup": True}, "PSL-1234 PSL-1234", "critical_low_confidence,field_review_band,duplicate_consignment_90d"),
    ({"tpo": "1234567", "plate": "CJ 12 ABC", "doc_date": "2026-10-20", "goods": "x", "c_tpo": 0.6, "c_goods": 0.4}, "PSL-1234 TRO-1234", "multiple_avize_in_image,field_review_band,critical_low_confidence"),
]


@query(f"""
with p(i, rules) as (values {_sql([(i, p[2]) for i, p in enumerate(_PAPERS)])}), c as (select rules, count(*) as n from orders join p on i = o_orderkey % {len(_PAPERS)} where rules <> '' group by 1)
select rule, sum(n)::bigint as n from (select unnest(string_split(rules, ',')) as rule, n from c) group by 1""")
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of the 25 rules is broken by papers written to break them."""
    names = ["tpo", "doc_no", "plate", "doc_date", "date_text", "route", "goods", "quantity", "gross_kg", "net_kg", "c_tpo", "c_goods", "dup"]
    papers = spark.createDataFrame([(i, *[p[0].get(n) for n in names], p[1]) for i, p in enumerate(_PAPERS)], "i long, tpo string, doc_no string, plate string, doc_date string, date_text string, route string, goods string, quantity string, gross_kg double, net_kg double, c_tpo double, c_goods double, is_duplicate boolean, text string")
    docs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % len(_PAPERS)).alias("i")).join(F.broadcast(papers.withColumn("doc_date", F.col("doc_date").cast("date"))), "i")
    found = documents.findings(docs, "2026-10-19", {"tpo": "c_tpo", "goods": "c_goods"})
    return found.select(F.explode("findings").alias("f")).groupBy(F.col("f.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("""
with d as (select o_orderkey as id, case when o_custkey % 9 <> 0 then 'T' || (o_custkey % 90) end as tpo, case when o_orderkey % 3 <> 0 then 'PSL-' || (o_orderkey % 2) end as doc_no, cast(o_orderdate as date) as day, o_orderdate as made, 'B' || (o_orderkey % 3) as plate from orders),
k as (select *, coalesce('doc:' || lower(doc_no), 'run:|' || day || '|' || lower(plate) || '|r') as c from d), w as (select *, lag(id) over p as before, lag(made) over p as before_made from k where tpo is not null window p as (partition by lower(tpo), c order by made, id))
select id, coalesce(made - before_made <= interval 90 days, false) as is_duplicate, case when made - before_made <= interval 90 days then before end as duplicate_of from w union all select id, false, null from k where tpo is null""")
def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consignments that came before within 90 days, and the newest of them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    docs = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(c % 9 != 0, F.concat(F.lit("T"), (c % 90).cast("string"))).alias("tpo"), F.when(k % 3 != 0, F.concat(F.lit("PSL-"), (k % 2).cast("string"))).alias("doc_no"), F.col("o_orderdate").cast("date").alias("doc_date"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.concat(F.lit("B"), (k % 3).cast("string")).alias("plate"), F.lit("r").alias("route"),
    )
    return documents.seen_before(docs, "id").select("id", "is_duplicate", "duplicate_of")


@query("""
with d as (select p_partkey as id, case when p_partkey % 3 <> 0 then 'old' end as f, case when p_partkey % 4 <> 0 then (p_partkey % 10) / 10 end as c, case when p_partkey % 5 <> 0 then 'new' end as nf, (p_partkey % 7) / 10 as nc, p_partkey % 6 = 0 as pinned from part),
b as (select *, not pinned and nf is not null and (f is null or nc > coalesce(c, 0)) as better from d)
select id, case when better then nf else f end as plate, case when better then nc else c end as plate_conf from b""")
def repaired_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values against a second reading."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 3 != 0, "old").alias("plate"), F.when(k % 4 != 0, (k % 10) / 10).alias("plate_conf"), F.when(k % 5 != 0, "new").alias("new_plate"), ((k % 7) / 10).alias("new_plate_conf"),
        F.when(k % 6 == 0, F.array(F.lit("plate"))).alias("corrected_fields"),
    )
    return documents.merged_fields(rows, ["plate"]).select("id", "plate", "plate_conf")


_SHEETS = [  # a sheet, {t} its seven digits, and the fields, values, confidences and lines that it fills on 2026-10-19
    (
        "carnet de bord\n1. TPO-{t}\n2. 11.08.2026\n3. -\n4. B 112 VFM\n5. Bolintin -> Ploiesti\n6. nisip\n7. 9.96\n8. 15744 kg\n9. 15000 kg\n10. PSL-{t}\n11. 2\n12. gol\n13. 120\n14. 4.5",
        [("tpo", "TPO-{t}", 0.92, 1), ("doc_date", "2026-08-11", 0.9, 2), ("plate", "B-112-VFM", 0.9, 4), ("route", "Bolintin -> Ploiesti", 0.82, 5), ("goods", "nisip", 0.82, 6), ("quantity", "9.96", 0.86, 7), ("gross_kg", "15744.0", 0.84, 8), ("net_kg", "15000.0", 0.84, 9), ("doc_no", "PSL-{t}", 0.9, 10), ("runs", "2", 0.86, 11), ("km", "120.0", 0.84, 13), ("tariff", "4.5", 0.84, 14)],
    ),
    (
        "1. B - 100 - PLM\n2. 12.03.2026\n3. TPO {t}\n4. Str. Lunga 4 – Iasi\n5. 18.5 m3\n6. 3 curse\n7. 22.500 kg\n14. 7,5 lei",
        [("plate", "B-100-PLM", 0.84, 1), ("doc_date", "2026-03-12", 0.9, 2), ("tpo", "TPO-{t}", 0.84, 3), ("route", "Str. Lunga 4 – Iasi", 0.78, 4), ("quantity", "18.5 m³", 0.82, 5), ("runs", "3", 0.82, 6), ("gross_kg", "22500.0", 0.8, 7), ("tariff", "7.5", 0.84, 14)],
    ),
    ("1. TPO-{t}\n2. gol\n7) 40 saci\nnothing", []),
    (
        "1) {t}\n2) saci\n3- 40 saci\n5. Bol -> Cluj\n5. again -> no\n8. 12\n9. 15000\n22. lost",
        [("tpo", "TPO-{t}", 0.8, 1), ("goods", "saci", 0.84, 2), ("quantity", "40.0 saci", 0.82, 3), ("route", "Bol -> Cluj", 0.82, 5), ("net_kg", "15000.0", 0.84, 9)],
    ),
    ("9. nisip\n10. 21000\n3. 9.96\n4. 10-10-2026\n1. x\n12. 55 ron", [("order_value", "9.96", 0.84, 3), ("doc_date", "2026-10-10", 0.84, 4), ("goods", "nisip", 0.78, 9), ("gross_kg", "21000.0", 0.8, 10), ("taxes", "55.0", 0.84, 12)]),
]


@query(f"""
with f(i, field, value, confidence, line) as (values {_sql([(i, *f) for i, (_, fields) in enumerate(_SHEETS) for f in fields])})
select c_custkey as id, field, replace(value, '{{t}}', lpad(c_custkey::varchar, 7, '0')) as value, confidence::double as confidence, line from customer join f on i = c_custkey % {len(_SHEETS)}""")
def numbered_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handwritten sheets in the guide's order, shifted, renumbered and too short."""
    k = F.col("c_custkey")
    layout = F.get(F.array(*[F.lit(t) for t, _ in _SHEETS]), (k % len(_SHEETS)).cast("int"))
    docs = table(spark, sf_dir, "customer").select(k.alias("id"), F.replace(layout, F.lit("{t}"), F.lpad(k.cast("string"), 7, "0")).alias("text"))
    return sheets.numbered_sheets(docs, "id", "2026-10-19")
