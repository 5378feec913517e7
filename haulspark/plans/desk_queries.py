"""Outlines, streets, codes, inboxes, caches and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions.numeric import exact_sum
from haulspark.operators import office
from haulspark.operators.relational import top_rows
from haulspark.sources import tables as t
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("select s_suppkey as id, 5 as n_points, (20 + s_suppkey % 5)::double as west, (44 + s_suppkey % 3)::double as south, 5 as kml_points from supplier")
def outline_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (20 + k % 5).cast("string"), (44 + k % 3).cast("string")
    x1, y1 = (21 + k % 5).cast("string"), (45 + k % 3).cast("string")
    corners = [(x, y), (x1, y), (x1, y1), (x, y1), (x, y)]
    ring = F.concat(F.lit("[["), F.concat_ws(",", *[F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")) for a, b in corners]), F.lit("]]"))
    doc = F.when(k % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit("]}")))
    kml = F.concat(F.lit("<kml><coordinates>\n "), F.concat_ws("\n ", *[F.concat(a, F.lit(","), b, F.lit(",0")) for a, b in corners]), F.lit("\n</coordinates></kml>"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), office.polygon_ring(doc).alias("ring"), office.kml_ring(kml).alias("kml"))
    low = lambda f: F.array_min(F.transform("ring", lambda p: p[f]))
    return rows.select("id", F.size("ring").alias("n_points"), low("lon").alias("west"), low("lat").alias("south"), F.size("kml").alias("kml_points"))


@query("select s_suppkey as id, 1 as seq, 1281 as tag, length(s_name)::int as length, s_name as text from supplier union all select s_suppkey, 2, 1282, 2, null from supplier")
def tag_length_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name").cast("binary")
    size = F.unhex(F.lpad(F.hex(F.length(name)), 4, "0"))
    content = F.concat(F.unhex(F.lit("050100")), size, name, F.unhex(F.lit("0502000002AABB")), F.unhex(F.lit("0503000FFF00")))
    return office.tag_length_value(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), content.alias("content")))


@query("""
with a as (select c_custkey % 2 = 0 as verified, c_custkey % 9 = 0 as disabled, case when c_custkey % 5 = 0 then 'manual' else 'ocr' end as source, c_custkey % 4 as seen from customer)
select count(*) filter (where not disabled and (verified or source = 'manual' or seen >= 2)) as trusted, count(*) as addresses from a""")
def trust_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ok = office.trusted(k % 9 == 0, k % 2 == 0, F.when(k % 5 == 0, "manual").otherwise("ocr"), k % 4)
    return table(spark, sf_dir, "customer").agg(F.count_if(ok).alias("trusted"), F.count("*").alias("addresses"))


@query("""
with r as (select p_partkey, case when p_partkey % 4 = 0 then ' ' else p_brand end as tpo, case when p_partkey % 3 <> 0 then date '2024-01-01' + cast(p_size as int) end as d from part)
select p_partkey, row_number() over (order by trim(tpo) = '', trim(tpo), d asc nulls last, p_partkey) as row_no from r""")
def merge_friendly_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, " ").otherwise(F.col("p_brand")).alias("tpo"), F.when(k % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), "p_size")).alias("d"))
    return office.merge_order(rows, "tpo", "d", "p_partkey").select("p_partkey", "row_no")


@query("""
with h as (select c_custkey as id, c_nationkey % 5 as street, (c_custkey % 200 + 1)::int as number from customer),
r(street, odd, low, high, zone) as (select s, o = 1, b * 40 + o, b * 40 + 20 + o, case when b = 2 then 'B' else 'A' end from range(5) t(s), range(2) u(o), range(4) v(b)),
i as (select h.id, max(zone) as zone from h join r on r.street = h.street and r.odd = (h.number % 2 = 1) and h.number between low and high group by 1),
g as (select h.id, (select zone from r where r.street = h.street and r.odd = (h.number % 2 = 1) and high < h.number order by low desc limit 1) as b, (select zone from r where r.street = h.street and r.odd = (h.number % 2 = 1) and low > h.number order by low limit 1) as a from h)
select h.id, coalesce(i.zone, case when g.a = g.b then g.a end) as zone from h left join i using (id) left join g using (id)""")
def street_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    houses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("long").alias("street"), (F.col("c_custkey") % 200 + 1).cast("int").alias("number"))
    odd, block = F.col("id") % 2, F.floor(F.col("id") / 2) % 4
    ranges = spark.range(40).select(F.floor(F.col("id") / 8).alias("street"), (odd == 1).alias("odd"), (block * 40 + odd).alias("low"), (block * 40 + 20 + odd).alias("high"), F.when(block == 2, "B").otherwise("A").alias("zone"))
    return office.street_zone(houses, ranges).select("id", "zone")


@query("select p_partkey, upper(p_type) || case when p_partkey % 3 = 0 then '' else ', X' || (p_partkey % 3)::varchar end as codes, case when p_partkey % 5 <> 0 then lpad(p_partkey::varchar, 8, '0') end as code from part")
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    given = F.array(F.concat(F.lit(" "), F.lower("p_type")), F.upper("p_type"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("x"), (k % 3).cast("string"))))
    number = F.when(k % 5 != 0, F.concat_ws("-", F.substring(F.lpad(k.cast("string"), 8, "0"), 1, 4), F.substring(F.lpad(k.cast("string"), 8, "0"), 5, 4))).otherwise("12")
    return table(spark, sf_dir, "part").select("p_partkey", office.join_codes(given).alias("codes"), office.transport_code(number).alias("code"))


@query("select o_orderkey, case when o_orderkey % 3 <> 0 then floor((o_totalprice - o_custkey * 7.0::double) * 100 + 0.5) / 100 end as margin from orders")
def trip_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") * 7.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", office.margin(F.col("o_totalprice"), cost).alias("margin"))


@query("""
with s as (select s_suppkey as id, list_filter([case when s_suppkey % 2 = 0 then 'frig' end, case when s_suppkey % 3 = 0 then 'adr' end, case when s_suppkey % 5 = 0 then 'macara' end], lambda x: x is not null) as skills from supplier)
select id, array_to_string(list_sort(list_transform(skills, lambda x: case x when 'adr' then 1 when 'frig' then 2 else 3 end)), ',') as skill_ids from s""")
def skill_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    skills = F.filter(F.array(F.when(k % 2 == 0, "Frig"), F.when(k % 3 == 0, " ADR"), F.when(k % 5 == 0, "macara")), lambda x: x.isNotNull())
    out = office.skill_ids(table(spark, sf_dir, "supplier").select("s_suppkey", skills.alias("skills")), "s_suppkey", "skills")
    return out.select("id", F.array_join(F.transform("skill_ids", lambda x: x.cast("string")), ",").alias("skill_ids"))


@query("""
with p as (select distinct l_suppkey % 40 as f, l_partkey % 40 as t from lineitem where l_suppkey % 40 <> l_partkey % 40)
select f as from_key, t as to_key from p where not ((f + t) % 3 = 0 and f % 2 = 0)""")
def matrix_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("from_key"), (F.col("l_partkey") % 40).alias("to_key"))
    cache = spark.range(1600).select(F.floor(F.col("id") / 40).alias("from_key"), (F.col("id") % 40).alias("to_key")).where("(from_key + to_key) % 3 = 0")
    cache = cache.withColumn("expires_at", F.when(F.col("from_key") % 2 == 0, "2024-03-01").otherwise("2024-01-01").cast("timestamp"))
    return office.matrix_misses(li, cache, "2024-02-01")


@query("""
with v as (select p_partkey, p_name || ' ' || p_type as value from part), b(no, words) as (values (0, ['red', 'ring', 'small']), (1, ['blue', 'economy']), (2, ['standard', 'large', 'medium'])),
s as (select p_partkey, no, len(list_filter(words, lambda x: list_contains(string_split(lower(value), ' '), x))) as n from v, b), k as (select *, row_number() over (partition by p_partkey order by n desc, no) as r from s)
select p_partkey, case when n > 0 then no end as block_no, n as shared from k where r = 1""")
def block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("value"))
    blocks = spark.createDataFrame([(1, 0, "Red ring, SMALL"), (1, 1, "blue economy"), (1, 2, "standard; large; medium")], "doc int, block_no int, text string")
    return office.best_block(values, blocks, "doc").select("p_partkey", "block_no", "shared")


@query("""
with n as (select user_id, event_id as key, ts, event_id % 3 = 0 as is_read from events where event_id % 7 <> 0)
select user_id, key, is_read, row_number() over (partition by user_id order by is_read, ts desc, key) as pos from n""")
def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbox of every user, over all events."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("key"), F.col("ts").alias("created_at"))
    return office.inbox(e, _inbox_state(e), "user_id").select("user_id", "key", "is_read", "pos")


def _inbox_state(e: DataFrame) -> DataFrame:
    return e.select("key", F.when(F.col("key") % 3 == 0, F.col("created_at")).alias("read_at"), F.when(F.col("key") % 7 == 0, F.col("created_at")).alias("deleted_at"))


@query("""
with s as (select distinct l_orderkey as route_id, l_linenumber as seq from lineitem where l_linenumber not in (1, 7))
select route_id, seq, 'R' || route_id::varchar || '-0' || seq::varchar as reference from s where not (route_id % 5 = 0 and seq % 2 = 0)""")
def waybill_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.runs(spark, sf_dir).select(F.col("tpo_id").alias("route_id"), F.col("line").alias("seq")).distinct()
    stops = s.withColumn("kind", t.order_kind(F.col("seq")))
    routes = s.select("route_id").distinct().withColumn("code", F.concat(F.lit("R"), F.col("route_id").cast("string")))
    return office.waybill_drafts(routes, stops, s.where("route_id % 5 = 0 and seq % 2 = 0"))


@query("""
select p_brand as warehouse, cast(sum((p_size * p_retailprice)::decimal(28,4)) as double) as stock_value, count(*) filter (where p_size <= 10) as low_stock, count(*) as products from part group by 1""")
def stock_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("warehouse")).agg(exact_sum(F.col("p_size") * F.col("p_retailprice")).alias("stock_value"), F.count_if(F.col("p_size") <= 10).alias("low_stock"), F.count("*").alias("products"))


@query("select cast(ts as date) as day, count(*) as events, array_to_string((list(event_id order by ts desc, event_id desc))[1:3], ',') as newest from events group by 1")
def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "ts", "event_id")
    counts = e.groupBy("day").agg(F.count("*").alias("events"))
    newest = top_rows(e, ["day"], [F.desc("ts"), F.desc("event_id")], 3).groupBy("day").agg(F.reverse(F.array_sort(F.collect_list(F.struct("ts", "event_id")))).alias("n"))
    return counts.join(newest, "day").select("day", "events", F.array_join(F.transform("n", lambda x: x["event_id"].cast("string")), ",").alias("newest"))


@query("""
select c_custkey as id, '{"plate":"B1","routing":"' || case when c_custkey % 2 = 0 then 'auto' else 'hitl' end || '"}' as data, case when c_custkey % 2 = 0 then 'auto' else 'hitl' end as routing from customer""")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every customer with a change merged in."""
    return _merged(table(spark, sf_dir, "customer"))


def _merged(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    old = F.from_json(F.lit('{"plate":"B1","routing":"none"}'), "map<string,string>")
    change = F.create_map(F.lit("routing"), F.when(k % 2 == 0, "auto").otherwise("hitl"))
    merged = F.map_concat(F.map_filter(old, lambda key, _: ~F.map_contains_key(change, key)), change)
    data = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))
    return customers.select(k.alias("id"), data.alias("data")).withColumn("routing", F.get_json_object("data", "$.routing"))


@query("select c_nationkey as nation, c_custkey as from_key, c_custkey + 1 as to_key, c_custkey * 1.5::double as km from customer")
def bulk_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of one length a nation, bound as one insert has them, back as rows."""
    packed = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_list("c_custkey")).alias("a"))
    bound = packed.select("nation", "a", F.transform("a", lambda x: x + 1).alias("b"), F.transform("a", lambda x: x * 1.5).alias("c"))
    return bound.select("nation", F.inline(F.arrays_zip(F.col("a").alias("from_key"), F.col("b").alias("to_key"), F.col("c").alias("km"))))
