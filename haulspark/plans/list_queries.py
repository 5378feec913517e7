"""Scans, searches, pages, joins and upserts of the list screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions.timez import in_days
from haulspark.operators import relational as rel
from haulspark.operators.joins import best_match, distance_matrix, keep_newest, one_digit_off, small, zone_of
from haulspark.operators.matching import match_locations, missing_requirements
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


@query("select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7 order by c_acctbal desc nulls first, c_custkey limit 200")
def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = ("c_mktsegment", "c_nationkey", "c_acctbal")
    rows = rel.entity_scan(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 7, "unknown": 1}, allowed, [rel.parse_order("-c_acctbal", allowed), F.col("c_custkey")])
    return rows.select("c_custkey", "c_name", "c_acctbal")


@query("select p_partkey, p_name from part where contains(lower(coalesce(p_name, '')), 'ring')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(rel.holds(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query("""
select * from (select 'client' as entity, c_custkey as id, c_name as title from customer where lower(c_name) like '%#00000001%' order by c_custkey limit 10)
union all select * from (select 'vehicle', s_suppkey, s_name from supplier where lower(s_name) like '%#00000001%' order by s_suppkey limit 10)
union all select * from (select 'goods', p_partkey, p_name from part where lower(p_name) like '%#00000001%' or lower(p_brand) like '%#00000001%' order by p_partkey limit 10)""")
def multi_entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"client": (table(spark, sf_dir, "customer"), "c_custkey", ["c_name"]), "vehicle": (table(spark, sf_dir, "supplier"), "s_suppkey", ["s_name"]), "goods": (table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand"])}
    return rel.search_all(tables, "#00000001")


@query("""
select count(*) as n, min(event_id) as lowest, max(event_id) as highest from events
where (case when event_id % 4 <> 0 then cast(ts as date) end between date '2024-01-05' and date '2024-01-09')
   or (event_id % 4 = 0 and ts >= timestamp '2024-01-04 22:00:00' and ts < timestamp '2024-01-09 22:00:00')""")
def date_window_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("date")))
    chosen = e.where(in_days(F.col("day"), F.col("ts").cast("timestamp"), "2024-01-05", "2024-01-09"))
    return chosen.agg(F.count("*").alias("n"), F.min("event_id").alias("lowest"), F.max("event_id").alias("highest"))


@query("""
select o_orderkey, o_totalprice, (select count(*) from orders where o_orderstatus = 'F') as total_rows from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 50 offset 100""")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return rel.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 50)


@query("""
select o_orderkey, day, row_number() over (order by day asc nulls last, o_orderkey) as pos from (select o_orderkey, case when o_orderkey % 4 <> 0 then cast(o_orderdate as date) end as day from orders)""")
def null_order_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order by its day, those without one last."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    return rel.numbered(rows, [F.col("day").asc_nulls_last(), F.col("o_orderkey")], "pos")


@query("""
select o_custkey as client_id, o_orderkey as order_id, status from (
  select o_custkey, o_orderkey, case o_orderstatus when 'P' then 'in_curs' when 'O' then 'nou' else 'gata' end as status,
         row_number() over (partition by o_custkey order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_orderdate desc, o_orderkey) as k from orders) where k = 1""")
def status_rank_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "in_curs").when(F.col("o_orderstatus") == "O", "nou").otherwise("gata")
    rows = o.select(F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("order_id"), "o_orderdate", status.alias("status"))
    rank = F.array_position(F.array(F.lit("in_curs"), F.lit("nou"), F.lit("gata")), F.col("status"))
    return keep_newest(rows, ["client_id"], [rank, -F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("order_id")]).select("client_id", "order_id", "status")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < -900)")
def in_list_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select event_type, count(*) as n, min(cast(json_extract_string(props, '$.k') as bigint)) as low, max(cast(json_extract_string(props, '$.k') as bigint)) as high from events where cast(json_extract_string(props, '$.k') as bigint) >= 50 group by 1")
def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").withColumn("k", k).where("k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("""
select n_name, c_mktsegment, count(*) as orders, cast(sum(o_totalprice::decimal(28,4)) as double) as value
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by 1, 2""")
def left_join_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(small(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_mktsegment", "n_name")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum(F.col("o_totalprice").cast("decimal(28,4)")).alias("v"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_name", "c_mktsegment").agg(F.sum("k").alias("orders"), F.sum("v").cast("double").alias("value"))


@query("select l_suppkey, l_partkey, count(*) as n from lineitem l join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey and p_size = s_nationkey group by 1, 2")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("p_size") == F.col("s_nationkey")))
    return joined.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))


@query("""
with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select c_custkey, event_id, event_type from customer left join e on user_id = c_custkey and k = 1""")
def lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of every customer."""
    return _latest(table(spark, sf_dir, "customer"), table(spark, sf_dir, "events"))


def _latest(customers: DataFrame, events: DataFrame) -> DataFrame:
    latest = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return customers.select("c_custkey").join(latest, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "e.event_id", "e.event_type")


@query("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey and l_shipdate >= o_orderdate) as stop_count from orders")
def scalar_count_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of every order from its date on."""
    return _stop_counts(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _stop_counts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    o, li = orders.select("o_orderkey", "o_orderdate"), lines.select("l_orderkey", "l_shipdate")
    joined = o.join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")), "left")
    return joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("stop_count"))


@query("""
select n_name, '[' || string_agg('{"id":' || s_suppkey || ',"name":"' || s_name || '"}', ',' order by s_suppkey) || ']' as members from nation join supplier on s_nationkey = n_nationkey group by 1""")
def nested_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(small(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_name").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))).alias("members"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus <> 'F')")
def not_exists_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(open_, "c_custkey", "left_anti")


@query("""
select c_custkey, coalesce(n, 0) as open_orders, coalesce(v, 0) as open_value from customer left join
(select o_custkey, count(*) as n, cast(sum(o_totalprice::decimal(28,4)) as double) as v from orders where o_orderstatus = 'O' group by 1) on o_custkey = c_custkey""")
def join_preaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(28,4)")).cast("double").alias("v"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(load, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("open_orders"), F.coalesce("v", F.lit(0.0)).alias("open_value"))


@query("""
with new as (select o_custkey as client_id, o_orderkey as order_id, o_totalprice as value, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders)
select client_id, order_id, value from new where k = 1""")
def upsert_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("value"), "o_orderdate")
    return keep_newest(o, ["client_id"], [-F.unix_micros(F.col("o_orderdate").cast("timestamp")), -F.col("order_id")]).select("client_id", "order_id", "value")


@query("""
with x as (select s_suppkey as id, unnest([{'document': 'inspection', 'expires': date '2024-01-01' + cast(s_suppkey % 60 as int)}, {'document': 'insurance', 'expires': case when s_suppkey % 3 <> 0 then date '2023-12-20' + cast(s_suppkey % 90 as int) end}]) as d from supplier)
select id, d.document as document, d.expires as expires, cast(d.expires - date '2024-01-10' as int) as days_left from x where d.expires <= date '2024-01-10' + 30""")
def expiry_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")).alias("inspection"), F.when(k % 3 != 0, F.date_add(F.lit("2023-12-20").cast("date"), (k % 90).cast("int"))).alias("insurance")
    )
    return rel.expiring(rows, "id", {"inspection": "inspection", "insurance": "insurance"}, "2024-01-10", 30)


@query("select count(*) filter (where not (ts < timestamp '2024-01-31' - interval 15 days) or event_type = 'signup') as kept, count(*) as before from events")
def retention_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = rel.retained(e, "ts", "2024-01-31", 15, keep=F.col("event_type") == "signup").agg(F.count("*").alias("kept"))
    return kept.crossJoin(e.agg(F.count("*").alias("before")))


@query("""
with old as (select c_custkey as id, c_mktsegment as segment, c_acctbal as balance from customer), new as (select c_custkey as id, case when c_custkey % 10 = 0 then 'OTHER' else c_mktsegment end as segment, case when c_custkey % 15 = 0 then c_acctbal + 1 else c_acctbal end as balance from customer)
select id, (o.segment is distinct from n.segment)::int + (o.balance is distinct from n.balance)::int as n_changes, case when o.segment is distinct from n.segment then o.segment end as old_segment
from old o join new n using (id) where o.segment is distinct from n.segment or o.balance is distinct from n.balance""")
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    new = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 10 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 15 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("balance"))
    return rel.changed_fields(old, new, "id", ["segment", "balance"]).select("id", F.size("changes").alias("n_changes"), F.try_element_at("changes", F.lit("segment"))["from"].alias("old_segment"))


@query("""
select 'orders' as source, count(*) > 0 as found from orders where o_custkey = 7 union all select 'customer', count(*) > 0 from customer where c_custkey = 7 union all select 'events', count(*) > 0 from events where user_id = 7""")
def union_all_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = lambda name, col: table(spark, sf_dir, name).where(F.col(col) == 7).limit(1).agg((F.count("*") > 0).alias("found")).select(F.lit(name).alias("source"), "found")
    return probe("orders", "o_custkey").unionByName(probe("customer", "c_custkey")).unionByName(probe("events", "user_id"))


@query("""
select c_custkey as id, array_to_string(list_sort(list_distinct(list_concat(['plate', 'seg' || (c_nationkey % 3)::varchar], ['seg' || (c_custkey % 3)::varchar]))), ',') as fields from customer""")
def array_union_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = lambda c: F.concat(F.lit("seg"), (F.col(c) % 3).cast("string"))
    both = F.array_union(F.array(F.lit("plate"), seg("c_nationkey")), F.array(seg("c_custkey")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array_sort(both), ",").alias("fields"))


@query("""
with c as (select s_suppkey as id, list_filter([case when s_suppkey % 4 = 0 then 'FRIG' when s_suppkey % 2 = 0 then 'frig' end, case when s_suppkey % 3 = 0 then 'Macara' end, case when s_suppkey % 2 = 0 then 'Frig' end, case when s_suppkey % 5 = 0 then 'ADR' end, case when s_suppkey % 6 = 0 then 'MACARA' end], lambda x: x is not null) as needs,
  list_filter([case when s_nationkey % 2 = 0 then 'Frig' end, 'adr'], lambda x: x is not null) as has from supplier),
u as (select id, unnest(needs) as x, generate_subscripts(needs, 1) as i, has from c), f as (select id, lower(x) as k, min(i) as i, arg_min(x, i) as x, any_value(has) as has from u group by 1, 2)
select c.id, coalesce(string_agg(f.x, ',' order by f.i) filter (not list_contains(list_transform(f.has, lambda h: lower(h)), f.k)), '') as missing from c left join f using (id) group by 1""")
def requirements_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers' routes need in any spelling and their vehicles lack."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    needs = F.array(F.when(k % 4 == 0, "FRIG").when(k % 2 == 0, "frig"), F.when(k % 3 == 0, "Macara"), F.when(k % 2 == 0, "Frig"), F.when(k % 5 == 0, "ADR"), F.when(k % 6 == 0, "MACARA"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.array_join(missing_requirements(needs, F.array(F.when(n % 2 == 0, "Frig"), F.lit("adr"))), ",").alias("missing"))


@query("""
with l as (select c_custkey as k from customer where c_custkey % 7 <> 0), m as (select c_custkey as id, c_custkey + case c_custkey % 5 when 1 then 1 else 0 end as k, c_custkey % 5 as way from customer)
select id, case when way in (0, 1) and k % 10 = 0 then null when way in (0, 1, 2, 3) and exists (select 1 from l where l.k = m.k) then k end as location_id,
  case when way = 4 then case when id % 10 = 4 then 'lipsa' else 'negasit' end when way in (0, 1) and k % 10 = 0 then 'nume_ambiguu' when not exists (select 1 from l where l.k = m.k) then 'negasit' when way in (0, 1) then 'nume' else 'adresa' end as reason from m""")
def location_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a name, with another spelling of it, with an address, with one whose town stands apart, and with nothing that is known."""
    k = F.col("c_custkey")
    customers, way = table(spark, sf_dir, "customer"), k % 5
    name = lambda n: F.when(n % 10 == 0, "Depozit").otherwise(F.concat(F.lit("Ștefan-Vodă "), n.cast("string")))
    places = customers.select(k.alias("location_id"), name(k).alias("name"), F.concat(F.lit("Str. Lungă nr. "), k.cast("string"), F.lit(", Arad")).alias("address"), (k % 7 != 0).alias("is_active"), k.alias("pos"))
    lines = customers.select(
        k.alias("id"), F.when(way == 0, name(k)).when(way == 1, F.upper(F.replace(name(k + 1), F.lit("-"), F.lit("  ")))).when((way == 4) & (k % 10 != 4), "nowhere").alias("location_name"),
        F.when(way == 2, F.concat(F.lit("STR. LUNGA "), k.cast("string"), F.lit(", ARAD"))).when(way == 3, F.concat(F.lit("str. Lungă "), k.cast("string"))).alias("address"), F.when(way == 3, "Arad").alias("city"),
    )
    return match_locations(lines, places)


@query("""
with n as (select coalesce(max(cast(regexp_extract(s_name, '#([0-9]+)$', 1) as bigint)), 0) as top from supplier), o as (select o_orderkey, row_number() over (order by o_orderkey) as k from orders)
select o_orderkey, 'F-' || case when top + k < 1000000 then lpad((top + k)::varchar, 6, '0') else (top + k)::varchar end as number from o, n""")
def next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next number of every order; one of more than six digits keeps them all."""
    top = table(spark, sf_dir, "supplier").agg(F.coalesce(F.max(F.nullif(F.regexp_extract("s_name", "#([0-9]+)$", 1), F.lit("")).cast("bigint")), F.lit(0)).alias("top"))
    o = rel.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "k")
    n = F.col("top") + F.col("k")
    return o.crossJoin(F.broadcast(top)).select("o_orderkey", F.concat(F.lit("F-"), F.when(n < 1000000, F.lpad(n.cast("string"), 6, "0")).otherwise(n.cast("string"))).alias("number"))


_MATCH_SQL = """
facts as (select c_custkey as id, c_nationkey as key, 'supplier ' || (c_custkey % 120)::varchar as text from customer),
names as (select s_nationkey as key, 'supplier ' || s_suppkey::varchar as name from supplier),
s as (select id, name, floor((1 - levenshtein(text, name) / greatest(length(text), length(name))) * 10000 + 0.5) / 10000 as score from facts left join names using (key)),
r as (select id, name, score, row_number() over (partition by id order by score desc, name) as k, lead(score) over (partition by id order by score desc, name) as second from s)"""


@query(f"""
with {_MATCH_SQL}
select id, case when score is not null and score >= 0.6 and not (second is not null and score - second < 0.15) then name end as matched_name, score,
       case when score is null then 'no_candidate' when score < 0.6 then 'too_different' when second is not null and score - second < 0.15 then 'ambiguous' else 'matched' end as reason
from r where k = 1""")
def fuzzy_best_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier that every customer names, if one is clearly best."""
    return _matched(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"))


def _matched(customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    c = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"), F.concat(F.lit("supplier "), (F.col("c_custkey") % 120).cast("string")).alias("text"))
    names = suppliers.select(F.col("s_nationkey").alias("key"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("name"))
    return best_match(c, names, "key", "text").select("id", "matched_name", "score", "reason")


@query("""
with p as (select c_custkey as id, c_nationkey % 5 as series, lpad((c_custkey * 7 % 1000)::varchar, 3, '0') as digits from customer), f as (select distinct s_nationkey % 5 as series, lpad((s_suppkey * 13 % 1000)::varchar, 3, '0') as digits from supplier),
n as (select p.id, p.digits, f.digits as fd, (substr(p.digits,1,1) <> substr(f.digits,1,1))::int + (substr(p.digits,2,1) <> substr(f.digits,2,1))::int + (substr(p.digits,3,1) <> substr(f.digits,3,1))::int as d from p left join f using (series))
select id, any_value(digits) as digits, case when bool_or(d = 0) then any_value(digits) when count(*) filter (where d = 1) = 1 then max(fd) filter (where d = 1) end as fixed_digits from n group by id""")
def hamming_plate_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c, m: F.lpad((F.col(c) * m % 1000).cast("string"), 3, "0")
    plates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("series"), code("c_custkey", 7).alias("digits"))
    fleet = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("series"), code("s_suppkey", 13).alias("digits"))
    return one_digit_off(plates, fleet).select("id", "digits", "fixed_digits")


_SQUARE = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
_ZONES = [  # zone, priority, active, polygons of rings of (lon, lat), counties, cities, postcodes
    (1, 5, True, [[_SQUARE(26.00, 44.00, 0.06), _SQUARE(26.02, 44.02, 0.01)]], [], ["city3"], []),
    (2, 9, True, [[[(26.03, 44.02), (26.09, 44.03), (26.05, 44.09), (26.03, 44.02)]], [_SQUARE(26.085, 44.005, 0.01)]], [], ["city4"], []),
    (3, 9, False, [[_SQUARE(26.00, 44.00, 0.10)]], [], ["city5"], []),
    (4, 1, True, None, [], ["city6", "city3"], []),
    (5, 2, True, None, ["B"], ["City 7", "city8"], []),
    (6, 3, True, None, ["IF", "CJ"], [], []),
    (7, 4, True, None, ["B"], [], ["01", "0234"]),
    (8, 2, True, None, [], [], ["9"]),
    (9, 8, True, None, [], [], []),
]


def _zones_sql() -> str:
    edges = [
        f"({z}, {p}, {i}, {n}, {r}, {a[0]!r}::double, {a[1]!r}::double, {b[0]!r}::double, {b[1]!r}::double)"
        for i, (z, p, on, polygons, *_) in enumerate(_ZONES) if on for n, rings in enumerate(polygons or []) for r, ring in enumerate(rings) for a, b in zip(ring, ring[1:], strict=False)
    ]
    names = [f"({z}, {p}, {i}, {counties or '[]::varchar[]'}, {[c.lower() for c in cities] or '[]::varchar[]'}, {codes or '[]::varchar[]'})" for i, (z, p, on, _, counties, cities, codes) in enumerate(_ZONES) if on]
    return f"edges(zone_id, priority, pos, polygon, ring, ax, ay, bx, by_) as (values {', '.join(edges)}), names(zone_id, priority, pos, counties, cities, codes) as (values {', '.join(names)})"


@query(f"""
with {t.POSITIONS_SQL}, {_zones_sql()}, p as (select event_id, lon, lat, case event_id % 12 when 7 then 'City  7' else 'city' || (event_id % 12) end as city, lower(case event_id % 12 when 7 then 'city 7' else 'city' || (event_id % 12) end) as folded, case event_id % 5 when 0 then 'b' when 1 then 'IF' when 2 then null else 'TM' end as county, case when event_id % 7 < 4 then lpad((event_id * 131 % 100000)::varchar, 6, '0') end as code from positions),
rings as (select event_id, zone_id, priority, pos, polygon, ring from p, edges where (ay > lat) <> (by_ > lat) and lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax group by all having count(*) % 2 = 1),
inside as (select distinct event_id, zone_id, priority, pos from rings r where ring = 0 and not exists (select 1 from rings h where h.event_id = r.event_id and h.zone_id = r.zone_id and h.polygon = r.polygon and h.ring > 0)),
told as (
  select event_id, zone_id, priority, pos from p, names where len(counties) + len(cities) + len(codes) > 0 and (len(counties) = 0 or list_contains(counties, upper(coalesce(county, '')))) and (len(cities) = 0 or list_contains(cities, folded))
    and (len(codes) = 0 or len(list_filter(codes, lambda x: starts_with(coalesce(code, ''), x))) > 0)),
hits as (select event_id, zone_id, 'polygon' as matched_by, 0 as r, -priority as q, pos from inside union all select event_id, zone_id, 'text', 1, -priority, pos from told),
best as (select *, row_number() over (partition by event_id order by r, q, pos) as k from hits)
select p.event_id, zone_id, matched_by from p left join best b on b.event_id = p.event_id and k = 1""")
def zone_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(z, p, i, on, polygons and [[[{"lon": x, "lat": y} for x, y in ring] for ring in rings] for rings in polygons], counties, cities, codes) for i, (z, p, on, polygons, counties, cities, codes) in enumerate(_ZONES)]
    zones = spark.createDataFrame(rows, "zone_id int, priority int, pos int, active boolean, polygons array<array<array<struct<lon:double,lat:double>>>>, counties array<string>, cities array<string>, postcodes array<string>")
    k = F.col("event_id")
    points = t.positions(spark, sf_dir).select(
        "event_id", "lon", "lat", F.when(k % 12 == 7, "City  7").otherwise(F.concat(F.lit("city"), (k % 12).cast("string"))).alias("city"),
        F.when(k % 5 == 0, "b").when(k % 5 == 1, "IF").when(k % 5 > 2, "TM").alias("county"), F.when(k % 7 < 4, F.lpad((k * 131 % 100000).cast("string"), 6, "0")).alias("postcode"),
    )
    return zone_of(points, zones).select("event_id", "zone_id", "matched_by")


@query("""
with p as (select n_nationkey as id, n_nationkey * 0.7::double + 40 as lat, n_nationkey * 13 % 250 / 10 + 20 as lon from nation)
select a.id as from_id, b.id as to_id, floor(2 * 6371.0::double * asin(least(1.0::double, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) * 10 + 0.5) / 10 as km from p a, p b where a.id <> b.id""")
def cross_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all places of a plan from each other: every place is asked against the one list of places, which has a limit of 200."""
    k = F.col("n_nationkey")
    p = table(spark, sf_dir, "nation").select(k.alias("id"), (k * 0.7 + 40).alias("lat"), (k * 13 % 250 / 10 + 20).alias("lon"))
    return distance_matrix(p).select("from_id", "to_id", "km")


@query("""
with k as (select lower(p_name) as key, count(*) as n, min(p_partkey) as id from part group by 1), w as (select lower(p_name) || case when p_partkey % 3 = 0 then ' x' else '' end as key, p_partkey from part)
select w.p_partkey as row_id, case when n = 1 then id end as part_id, case when n is null then 'unknown' when n > 1 then 'ambiguous' else 'matched' end as reason from w left join k using (key)""")
def unambiguous_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    keys = p.groupBy(F.lower("p_name").alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("id"))
    wanted = p.select(F.concat(F.lower("p_name"), F.when(F.col("p_partkey") % 3 == 0, " x").otherwise("")).alias("key"), F.col("p_partkey").alias("row_id"))
    reason = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return wanted.join(keys, "key", "left").select("row_id", F.when(F.col("n") == 1, F.col("id")).alias("part_id"), reason.alias("reason"))


@query("""
with x as (select o_orderkey, sha256(o_orderpriority || '|' || (o_custkey % 500)::varchar) as h from orders), c as (select distinct sha256(o_orderpriority || '|' || (o_custkey % 500)::varchar) as h from orders where o_orderkey % 3 = 0)
select count(*) as misses, count(distinct h) as contents from x where h not in (select h from c)""")
def cache_miss_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderpriority", (F.col("o_custkey") % 500).cast("string")), 256).alias("h"))
    cached = o.where("o_orderkey % 3 = 0").select("h").distinct()
    return o.join(cached, "h", "left_anti").agg(F.count("*").alias("misses"), F.count_distinct("h").alias("contents"))
