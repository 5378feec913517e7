"""Vehicles, loads and plans: plates, summaries, edited routes, solver problems and solutions, scenarios, delays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.operators import dispatch, fleet, sequences
from haulspark.operators.relational import numbered
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


@query("""
with v as (select s_suppkey as id, 'B' || lpad((s_suppkey % 70)::varchar, 2, '0') || 'ABC' as plate, case when s_suppkey % 3 <> 0 then s_suppkey * 100.0::double end as mma, s_suppkey % 4 = 0 as scanned, row_number() over (partition by s_suppkey % 70 order by s_suppkey % 3 = 0, s_suppkey % 11, s_suppkey) as k from supplier),
a as (select c_custkey as id, case when c_custkey % 13 <> 0 then 'B' || lpad((c_custkey % 90)::varchar, 2, '0') || 'ABC' end as plate from customer)
select a.id, v.id is not null as known, v.id as vehicle_id, mma as mma_kg, v.id is not null and mma is not null and not scanned as verified from a left join v on v.plate = a.plate and k = 1""")
def plate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    plate = lambda n, form: F.format_string(form, n.cast("int"))
    vehicles = table(spark, sf_dir, "supplier").select(s.alias("vehicle_id"), plate(s % 70, "b-%02d abc").alias("plate"), F.when(s % 3 != 0, s * 100.0).alias("mma_kg"), (s % 4 == 0).alias("added_by_scan"), (s % 11).alias("created_at"))
    rows = table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 13 != 0, plate(c % 90, " B %02d ABC / CJ 01 XYZ")).otherwise(" / ").alias("plate"))
    return fleet.plate_status(rows, vehicles).select("id", "known", "vehicle_id", "mma_kg", "verified")


@query(f"""
with {t.STOPS_SQL}, r as (select o_orderkey as route_id, case when o_orderkey % 5 <> 0 then floor(o_totalprice) end as planned_m, case when o_orderkey % 7 <> 0 then floor(o_totalprice) + o_orderkey % 9000 end as trail_m from orders),
s as (select route_id, count(*) filter (where kind not in ('depot_start', 'pauza')) as n, count(*) filter (where kind not in ('depot_start', 'pauza') and load_kg is not null) as done from stops group by 1),
k as (select route_id, floor(planned_m / 1000 * 10 + 0.5) / 10 as planned_km, floor(trail_m / 1000 * 10 + 0.5) / 10 as actual_km from r)
select k.route_id, planned_km, actual_km, floor((actual_km - planned_km) * 10 + 0.5) / 10 as delta_km, coalesce(done, 0) as stops_done, coalesce(n, 0) as stops_total from k left join s using (route_id)""")
def replay_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    routes = table(spark, sf_dir, "orders").select(k.alias("route_id"), F.when(k % 5 != 0, price).alias("planned_m"))
    trails = table(spark, sf_dir, "orders").select(k.alias("route_id"), F.when(k % 7 != 0, price + k % 9000).alias("trail_m"))
    stops = t.stops(spark, sf_dir).select("route_id", "kind", F.when(F.col("load_kg").isNotNull(), "finalizat").otherwise("planificat").alias("status"))
    return fleet.replay_kpis(routes, stops, trails)


_TIER_SQL = "p as (select c_custkey as id, c_name as name, case when c_custkey % 9 = 0 then 'missing' when c_custkey % 5 = 0 then 'verified' when c_custkey % 7 = 0 then 'review' when c_custkey % 100 >= 80 then 'good' when c_custkey % 100 >= 45 then 'review' else 'poor' end as tier from customer)"


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tier = fleet.place_tier(F.when(k % 9 != 0, 44.0), F.lit(26.0), k % 5 == 0, F.when(k % 7 != 0, k % 100 / 100))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), tier.alias("tier"))


@query(f"with {_TIER_SQL} select count(*) filter (where tier = 'missing') as missing, count(*) filter (where tier = 'poor') as poor, count(*) filter (where tier = 'review') as review, count(*) filter (where tier = 'good') as good, count(*) filter (where tier = 'verified') as verified, count(*) as total, count(*) filter (where tier <> 'verified') as todo from p")
def place_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.queue_summary(_tiers(spark, sf_dir))


@query(f"with {_TIER_SQL} select id, tier, row_number() over (order by case tier when 'missing' then 0 when 'poor' then 1 when 'review' then 2 when 'good' then 3 else 4 end, lower(name), id) as pos from p")
def urgency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places numbered in the order in which they need a person."""
    rows = _tiers(spark, sf_dir)
    return numbered(rows, [*fleet.by_urgency(F.col("tier"), F.col("name")), F.col("id")], "pos").select("id", "tier", "pos")


@query("""
select c_custkey as id, row_number() over (order by c_custkey % 6 = 0, case c_custkey % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 else 0 end, lower(c_name), c_custkey) as pos from customer""")
def account_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    role = F.get(F.array(*[F.lit(r) for r in (*fleet.ROLES, "guest")]), (k % 5).cast("int"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), "c_name", role.alias("role"), (k % 6 != 0).alias("active"))
    return numbered(rows, [*fleet.by_role(F.col("active"), F.col("role"), F.col("c_name")), F.col("id")], "pos").select("id", "pos")


@query("""
with v as (select case when s_suppkey % 8 <> 0 then date '2024-01-15' + cast(s_suppkey % 90 - 30 as int) end as expiry from supplier where s_suppkey % 10 <> 0), s as (select case when expiry is null then 'missing' when expiry < date '2024-01-15' then 'expired' when expiry <= date '2024-02-14' then 'soon' else 'ok' end as s from v)
select count(*) filter (where s = 'missing') as missing, count(*) filter (where s = 'expired') as expired, count(*) filter (where s = 'soon') as soon, count(*) filter (where s = 'ok') as ok, count(*) as total from s""")
def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.when(k % 8 != 0, F.date_add(F.lit("2024-01-15").cast("date"), (k % 90 - 30).cast("int"))).alias("expiry"), F.when(k % 10 == 0, False).alias("is_active"))
    return fleet.inspection_summary(rows, "2024-01-15")


@query("select s_suppkey as scenario_id, s_name as name, case when s_suppkey % 3 <> 0 then s_suppkey % 9 + 0.5::double end as distance_km, (s_suppkey % 5)::double as unassigned, null::double as cost from supplier")
def scenario_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kpis = F.to_json(F.struct(F.when(k % 3 != 0, k % 9 + 0.5).alias("distance_km"), (k % 5).alias("unassigned")))
    return fleet.compare_scenarios(table(spark, sf_dir, "supplier").select(k.alias("scenario_id"), F.col("s_name").alias("name"), kpis.alias("kpis")), ["distance_km", "unassigned", "cost"])


@query("select o_orderkey as order_number from orders where o_orderstatus = 'O' and cast(o_orderdate as date) = date '1998-02-10' union all select o_orderkey from orders where o_orderstatus = 'O' and (contains(o_orderkey::varchar, '77') or contains('client ' || o_custkey, '77') or contains(lower(o_orderpriority), '77'))")
def unplanned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that wait for a plan, of one day, and those that hold a text."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_number"), F.when(F.col("o_orderstatus") == "O", "nou").otherwise("livrat").alias("status"), F.col("o_orderdate").alias("requested_date"),
        F.concat(F.lit("Client "), F.col("o_custkey").cast("string")).alias("client_name"), F.col("o_orderpriority").alias("goods"),
    )
    return fleet.unplanned(rows, "1998-02-10").select("order_number").unionByName(fleet.unplanned(rows, text=" 77 ").select("order_number"))


_BOX_SQL = "b as (select l_orderkey as plan_id, case when l_partkey % 17 <> 0 then l_linenumber end as stop_seq, case when l_partkey % 3 <> 0 then 'P' || (l_partkey % 6) end as sku, case when l_partkey % 5 <> 0 then l_quantity * 10.5::double end as weight_kg, 1.2::double as l, 0.8::double as w, case when l_partkey % 7 <> 0 then 0.5 + l_partkey % 4 * 0.25::double end as h from lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), F.when(p % 17 != 0, F.col("l_linenumber")).alias("stop_seq"), F.when(p % 3 != 0, F.concat(F.lit("P"), (p % 6).cast("string"))).alias("sku"),
        F.when(p % 5 != 0, F.col("l_quantity") * 10.5).alias("weight_kg"), F.lit(1.2).alias("l"), F.lit(0.8).alias("w"), F.when(p % 7 != 0, 0.5 + p % 4 * 0.25).alias("h"),
    )


@query(f"""
with {_BOX_SQL}, s as (select plan_id, coalesce(stop_seq, 0) as stop_seq, count(*) as item_count, floor(cast(sum(coalesce(weight_kg, 0)::decimal(28,4)) as double) * 10 + 0.5) / 10 as weight_kg, floor(cast(sum(coalesce(l * w * h, 0)::decimal(28,6)) as double) * 1000 + 0.5) / 1000 as volume_m3 from b group by 1, 2)
select *, row_number() over (partition by plan_id order by stop_seq desc) as load_order from s""")
def load_by_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.load_by_stop(_boxes(spark, sf_dir))


@query(f"with {_BOX_SQL} select plan_id, stop_seq, coalesce(sku, 'palet') as sku, count(*) as quantity, floor(cast(sum(coalesce(weight_kg, 0)::decimal(28,4)) as double) * 10 + 0.5) / 10 as weight_kg from b group by 1, 2, 3")
def articles_by_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.article_rows(_boxes(spark, sf_dir))


_PLACED_SQL = """
b as (select l_orderkey as plan_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as item_id, case when l_partkey % 13 <> 0 then (l_linenumber - 1) * 1.5::double + l_partkey % 3 * 0.25 end as x, l_suppkey % 2 * 0.75::double as y, case when l_partkey % 4 = 0 then 1.0::double else 0.0 end as z, 1.25::double as l, 1.0::double as w, 1.0::double as h, l_quantity * 10.0::double as weight_kg,
        row_number() over (partition by l_orderkey, l_partkey, l_suppkey, l_linenumber order by l_extendedprice) as twin from lineitem)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), (p * 100000 + s * 10 + n).alias("item_id"), F.when(p % 13 != 0, (n - 1) * 1.5 + p % 3 * 0.25).alias("x"), (s % 2 * 0.75).alias("y"), F.when(p % 4 == 0, 1.0).otherwise(0.0).alias("z"),
        F.lit(1.25).alias("l"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"), (F.col("l_quantity") * 10.0).alias("weight_kg"),
    )


def _holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("plan_id"), F.lit(13.6).alias("hold_l"), F.lit(2.45).alias("hold_w"), F.lit(2.7).alias("hold_h"), F.when(k % 5 != 0, 24000.0).otherwise(0.0).alias("payload_kg"), F.lit(1.0).alias("front_x"), F.lit(8.0).alias("rear_x"))


@query(f"""
with {_PLACED_SQL}, s as (select plan_id, count(*) as n, floor(cast(sum((l * w * h)::decimal(28,6)) as double) * 100 + 0.5) / 100 as m3, floor(cast(sum(weight_kg::decimal(28,4)) as double) * 10 + 0.5) / 10 as kg, floor(cast(sum((case when z <= 0.001 then l * w else 0 end)::decimal(28,6)) as double) / (1.2::double * 0.8::double) * 10 + 0.5) / 10 as places from b where x is not null group by 1)
select o_orderkey as plan_id, coalesce(n, 0) as placed_count, coalesce(m3, 0) as used_m3, 89.96::double as capacity_m3, floor(coalesce(m3, 0) / 89.96::double * 10000 + 0.5) / 10000 as volume_share, coalesce(kg, 0) as used_kg, case when o_orderkey % 5 <> 0 then floor(coalesce(kg, 0) / 24000.0::double * 10000 + 0.5) / 10000 else 0 end as weight_share,
       coalesce(places, 0) as pallets_used, 34::bigint as pallets, floor(coalesce(places, 0) / 34 * 10000 + 0.5) / 10000 as pallet_share from orders left join s on plan_id = o_orderkey""")
def load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.load_statistics(_placed(spark, sf_dir), _holds(spark, sf_dir))


@query(f"""
with {_PLACED_SQL}, s as (select plan_id, cast(sum(weight_kg::decimal(28,4)) as double) as kg, cast(sum((weight_kg * (x + l / 2))::decimal(28,4)) as double) as moment from b where x is not null group by 1), r as (select o_orderkey as plan_id, coalesce(kg, 0) as kg, coalesce((moment - kg * 1.0) / (8.0::double - 1.0), 0) as rear from orders left join s on plan_id = o_orderkey)
select plan_id, floor((kg - rear) * 10 + 0.5) / 10 as front_kg, floor(rear * 10 + 0.5) / 10 as rear_kg from r""")
def axle_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.axle_loads(_placed(spark, sf_dir), _holds(spark, sf_dir))


@query(f"with {_PLACED_SQL} select distinct a.plan_id, a.item_id as a, b.item_id as b from b a join b on a.plan_id = b.plan_id and a.item_id < b.item_id where a.x < b.x + b.l and b.x < a.x + a.l and a.y < b.y + b.w and b.y < a.y + a.w and a.z < b.z + b.h and b.z < a.z + a.h")
def load_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.collisions(_placed(spark, sf_dir))


_ROUTE_SQL = """
s as (select l_orderkey as route_id, row_number() over (partition by l_orderkey order by l_linenumber, cast(l_shipdate as date), l_partkey, l_suppkey, l_extendedprice) as seq, count(*) over (partition by l_orderkey) as n from lineitem),
r as (select route_id, seq as stop_id, seq, n, case when seq = 1 then 0 when seq = n then 2 else 1 end as pin from s)"""


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.resequence(t.runs(spark, sf_dir), "tpo_id", [F.col(c) for c in ("line", "run_date", "goods_id", "vehicle_id", "value")]).withColumn("n", F.count("*").over(Window.partitionBy("tpo_id")))
    kind = F.when(F.col("seq") == 1, "depot_start").when(F.col("seq") == F.col("n"), "depot_end").otherwise("livrare")
    return rows.select(F.col("tpo_id").alias("route_id"), F.col("seq").cast("long").alias("stop_id"), "seq", kind.alias("kind"))


@query(f"""
with {_ROUTE_SQL}, i as (select route_id, stop_id, pin, seq::double as p from r union all select distinct route_id, 99, 1, greatest(route_id % 9 - 1, 0) + 0.5::double from r)
select route_id, stop_id, row_number() over (partition by route_id order by pin, p, stop_id) as seq from i""")
def route_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _route(spark, sf_dir)
    new = s.select("route_id").distinct().select("route_id", F.lit(99).cast("long").alias("stop_id"), F.lit("livrare").alias("kind"), (F.col("route_id") % 9 - 1).alias("at"))
    return dispatch.insert_stops(s, new).select("route_id", "stop_id", "seq")


@query(f"with {_ROUTE_SQL} select route_id, stop_id, row_number() over (partition by route_id order by pin, seq) as seq from r where stop_id <> route_id % 5")
def route_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _route(spark, sf_dir)
    gone = s.select("route_id").distinct().withColumn("stop_id", F.col("route_id") % 5)
    return dispatch.remove_stops(s, gone).select("route_id", "stop_id", "seq")


@query(f"""
with {_ROUTE_SQL}, m as (select *, route_id % 5 as mover, route_id % 6 as to_, (route_id % 5 between 1 and n) as known from r),
p as (select *, case when not known then seq::double when stop_id = mover then to_ - 0.5::double else seq - 1 - case when seq > mover then 1 else 0 end end as place from m)
select route_id, stop_id, row_number() over (partition by route_id order by pin, place, stop_id) as seq from p""")
def route_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _route(spark, sf_dir)
    moves = s.select("route_id").distinct().select("route_id", (F.col("route_id") % 5).alias("stop_id"), (F.col("route_id") % 6).alias("to"))
    return dispatch.move_stops(s, moves).select("route_id", "stop_id", "seq")


@query(f"""
with {_ROUTE_SQL} select route_id, stop_id, row_number() over (partition by route_id order by pin, case when stop_id in (5, 3) then 0 else 1 end, case when stop_id in (5, 3) then -stop_id else seq end) as seq from r""")
def route_apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _route(spark, sf_dir)
    order = s.select("route_id").distinct().withColumn("ids", F.array(*[F.lit(i).cast("long") for i in (5, 77, 3)]))
    return dispatch.apply_order(s, order).select("route_id", "stop_id", "seq")


_JOB_SQL = """
o as (select o_orderkey as order_id, o_orderkey % 17 <> 0 as placed, o_orderkey % 19 <> 0 as road, case o_orderkey % 3 when 0 then 'livrare' when 1 then 'ridicare' else 'schimb' end as type, case when o_orderkey % 5 <> 0 then floor(o_totalprice) / 100 end as kg, o_orderkey % 7 * 0.125::double as m3, o_orderkey % 4 as pal, case when o_orderkey % 6 <> 0 then o_orderkey % 50 end as service_min,
             case when o_orderkey % 8 <> 0 then (o_orderkey % 12) * 60 end as a, case when o_orderkey % 9 <> 0 then (o_orderkey % 20) * 60 end as b from orders),
d as (select *, [greatest(0, floor(coalesce(kg, 0) + 0.5))::bigint, floor(m3 * 100 + 0.5)::bigint, pal::bigint] as demand from o)"""


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    clock = lambda n: F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit(":00"))
    o = table(spark, sf_dir, "orders").select(
        k.alias("order_id"), F.when(k % 17 != 0, 44.0).alias("lat"), F.lit(26.0).alias("lon"), F.when(k % 3 == 0, "livrare").when(k % 3 == 1, "ridicare").otherwise("schimb").alias("type"),
        F.when(k % 5 != 0, F.floor("o_totalprice") / 100).alias("weight_kg"), (k % 7 * 0.125).alias("volume_m3"), (k % 4).cast("double").alias("pallets"), F.when(k % 6 != 0, (k % 50).cast("double")).alias("service_min"),
        F.when(k % 8 != 0, clock(k % 12)).alias("window_start"), F.when(k % 9 != 0, clock(k % 20)).alias("window_end"),
    )
    return o, o.where(F.col("order_id") % 19 != 0).select("order_id")


@query(f"""
with {_JOB_SQL} select order_id, floor(coalesce(service_min, 15) * 60 + 0.5)::bigint as service, case when type <> 'ridicare' then array_to_string(demand, ',') end as delivery, case when type <> 'livrare' then array_to_string(demand, ',') end as pickup,
       case when a is not null or b is not null then (coalesce(a, 0) * 60) || '-' || case when b is null or b <= coalesce(a, 0) then 86400 else b * 60 end end as time_window from d where placed and road""")
def solver_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, _ = dispatch.solver_jobs(*_orders(spark, sf_dir))
    listed = lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by)
    return jobs.select("order_id", "service", listed("delivery", ",").alias("delivery"), listed("pickup", ",").alias("pickup"), listed("time_window", "-").alias("time_window"))


@query(f"with {_JOB_SQL} select order_id, case when not placed then 'fara_coordonate' else 'fara_drum' end as reason from d where not (placed and road)")
def solver_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.solver_jobs(*_orders(spark, sf_dir))[1]


@query(f"""
with {_JOB_SQL}, t as (select sum(demand[1])::bigint as kg, sum(demand[2])::bigint as m3, sum(demand[3])::bigint as pal from d where placed and road), v as (select s_suppkey as id, case when s_suppkey % 3 <> 0 then s_suppkey * 10.4::double end as kg, case when s_suppkey % 4 <> 0 then s_suppkey * 0.25::double end as m3, case when s_suppkey % 5 <> 0 then s_suppkey % 34 end as pal, case when s_suppkey % 2 = 0 then 20.0::double end as hour from supplier where s_suppkey % 7 <> 0)
select id as vehicle_id, coalesce(floor(v.kg + 0.5)::bigint, t.kg) || ',' || coalesce(floor(v.m3 * 100 + 0.5)::bigint, t.m3) || ',' || coalesce(v.pal, t.pal) as capacity, '21600-79200' as time_window, 2000::bigint as per_hour, 0::bigint as per_km from v, t""")
def solver_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(
        k.alias("vehicle_id"), F.when(k % 7 != 0, 44.0).alias("depot_lat"), F.lit(26.0).alias("depot_lon"), F.when(k % 3 != 0, k * 10.4).alias("capacity_kg"), F.when(k % 4 != 0, k * 0.25).alias("capacity_m3"), F.when(k % 5 != 0, (k % 34).cast("double")).alias("capacity_pallets"),
        F.when(k % 2 == 0, 20.0).alias("cost_per_hour"), F.lit(None).cast("double").alias("cost_per_km"), F.lit(None).cast("string").alias("shift_start"), F.lit(None).cast("string").alias("shift_end"),
    )
    out = dispatch.solver_vehicles(v, dispatch.solver_jobs(*_orders(spark, sf_dir))[0])
    listed = lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by)
    return out.select("vehicle_id", listed("capacity", ",").alias("capacity"), listed("time_window", "-").alias("time_window"), "per_hour", "per_km")


@query("""
with p as (select distinct l_suppkey % 40 as f, l_partkey % 40 as t from lineitem), e as (select f, t, case when f = 13 or t = 13 or (f + t) % 5 = 0 then 1000000 else floor((f + t) * 60 + 0.5)::bigint end as s from p where f <> t), b as (select f as k, s from e union all select t, s from e)
select k as key from b group by 1 having min(s) >= 1000000""")
def stranded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("from_key"), (F.col("l_partkey") % 40).alias("to_key")).distinct()
    cut = (F.col("from_key") == 13) | (F.col("to_key") == 13) | ((F.col("from_key") + F.col("to_key")) % 5 == 0)
    minutes = F.when(~cut, F.col("from_key") + F.col("to_key"))
    return dispatch.stranded(dispatch.encoded_matrix(li.withColumns({"minutes": minutes.cast("double"), "km": minutes.cast("double")})))


_STEP_SQL = f"with {_ROUTE_SQL}, x as (select route_id, seq, case when seq = 1 then 'start' when seq = n then 'end' when seq % 4 = 0 then 'break' else 'job' end as type, (route_id * 7 + seq) % 100 as order_id, seq * 600 as arrival, case when seq % 3 <> 0 then seq * 60 end as service, case when seq % 5 <> 0 then seq * 1500 end as distance, seq * 90 as duration from r), y as (select *, coalesce(last_value(distance ignore nulls) over w, 0) as d, coalesce(last_value(duration ignore nulls) over w, 0) as s from x window w as (partition by route_id order by seq))"


def _solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _route(spark, sf_dir), F.col("seq")
    kind = F.when(F.col("kind") == "depot_start", "start").when(F.col("kind") == "depot_end", "end").when(n % 4 == 0, "break").otherwise("job")
    steps = s.select("route_id", n.alias("n"), kind.alias("type"), ((F.col("route_id") * 7 + n) % 100).alias("order_id"), (n * 600).alias("arrival"), F.when(n % 3 != 0, n * 60).alias("service"), F.lit(None).cast("int").alias("waiting"), F.when(n % 5 != 0, n * 1500).alias("distance"), (n * 90).alias("duration"))
    orders = spark.range(100).select(F.col("id").alias("order_id"), F.when(F.col("id") % 3 == 0, "ridicare").otherwise("schimb").alias("type"))
    return dispatch.solution_stops(steps, orders)


@query(_STEP_SQL + """
select route_id, seq::int as seq, case type when 'start' then 'depot_start' when 'end' then 'depot_end' when 'break' then 'pauza' else case when order_id % 3 = 0 then 'ridicare' else 'livrare' end end as kind, case when type = 'job' then order_id end as order_id, arrival + coalesce(service, 0) as departure_sec,
       floor(coalesce(service, 0) / 60 + 0.5)::bigint as service_min, (d - coalesce(lag(d) over w, 0)) / 1000 as leg_km, floor((s - coalesce(lag(s) over w, 0)) / 60 + 0.5)::bigint as leg_min from y window w as (partition by route_id order by seq)""")
def solution_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solution(spark, sf_dir).select("route_id", "seq", "kind", "order_id", "departure_sec", "service_min", "leg_km", "leg_min")


@query(_STEP_SQL + """
, z as (select route_id % 10 as scenario_id, route_id, (d - coalesce(lag(d) over w, 0)) / 1000 as km, floor((s - coalesce(lag(s) over w, 0)) / 60 + 0.5) as m, floor(coalesce(service, 0) / 60 + 0.5) as sm from y window w as (partition by route_id order by seq)),
u as (select o_orderkey % 10 as scenario_id, count(*) as n from orders where o_orderkey % 23 = 0 group by 1)
select z.scenario_id, count(distinct route_id) as routes, floor(cast(sum(km::decimal(28,3)) as double) * 1000 + 0.5) / 1000 as distance_km, sum(m)::bigint as duration_min, sum(sm)::bigint as service_min, 0::bigint as waiting_min, coalesce(any_value(u.n), 0) as unassigned from z left join u using (scenario_id) group by 1""")
def scenario_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = _solution(spark, sf_dir).withColumn("scenario_id", F.col("route_id") % 10)
    left = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 23 == 0).select((F.col("o_orderkey") % 10).alias("scenario_id"))
    return dispatch.scenario_kpis(stops, left)


@query("""
with r as (select o_orderkey as route_id, date '2024-01-01' + cast(o_custkey % 30 as int) as route_date, case when o_custkey % 30 = 4 and o_orderkey % 3 = 0 then 'lansata' else 'planificata' end as status, null::bigint as scenario_id from orders),
s as (select i as scenario_id, date '2024-01-01' + cast(i as int) as route_date, case when i = 6 then 'ciorna' else 'rulat' end as status from range(10) t(i)), ok as (select * from s where status = 'rulat' and scenario_id % 2 = 0 and route_date not in (select route_date from r where status = 'lansata'))
select * from r where route_date not in (select route_date from ok) union all select scenario_id * 100 + k, route_date, 'planificata', scenario_id from ok, range(3) t(k)""")
def scenario_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five solved days are put in force; one is not solved and one has routes on the road."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    routes = table(spark, sf_dir, "orders").select(k.alias("route_id"), at(c % 30).alias("route_date"), F.when((c % 30 == 4) & (k % 3 == 0), "lansata").otherwise("planificata").alias("status"), F.lit(None).cast("long").alias("scenario_id"))
    scenarios = spark.range(10).select(F.col("id").alias("scenario_id"), at(F.col("id")).alias("route_date"), F.when(F.col("id") == 6, "ciorna").otherwise("rulat").alias("status"))
    planned = spark.range(30).select((F.col("id") % 10).alias("scenario_id"), (F.col("id") % 10 * 100 + F.floor(F.col("id") / 10)).alias("route_id"))
    return dispatch.promote(routes, scenarios, scenarios.where("scenario_id % 2 = 0").select("scenario_id"), planned)


_DELAY_SQL = f"{t.STOPS_SQL}, d as (select o_orderkey as route_id, o_orderkey % 5 as from_seq, case when o_orderkey % 7 = 0 then 0 else o_orderkey % 60 + 1 end as delay from orders where o_orderkey % 2 = 0), x as (select s.*, case when load_kg is null then 'finalizat' else 'planificat' end as status, d.delay, coalesce(line >= from_seq and delay > 0 and load_kg is not null, false) as moved from stops s left join d using (route_id))"


def _delayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, k = t.stops(spark, sf_dir), F.col("o_orderkey")
    stops = s.select(
        "route_id", F.col("line").alias("seq"), F.concat_ws("-", "route_id", "line", "vehicle_id", "km").alias("stop_id"), F.when(F.col("load_kg").isNull(), "finalizat").otherwise("planificat").alias("status"), F.col("planned_at").cast("timestamp").alias("planned_at"), F.lit(None).cast("int").alias("eta_delay_min"),
        F.when(F.col("line") % 3 == 0, " ").otherwise(F.concat(F.lit(" Client"), (F.col("vehicle_id") % 3).cast("string"), F.lit("@X.ro"))).alias("client_email"),
    )
    delays = table(spark, sf_dir, "orders").where(k % 2 == 0).select(k.alias("route_id"), (k % 5).alias("from_seq"), F.when(k % 7 == 0, 0).otherwise(k % 60 + 1).alias("delay_min"))
    return stops, delays


@query(f"with {_DELAY_SQL} select route_id, line as seq, count(*) as n, count(*) filter (where moved) as shifted, max(planned_at + case when moved then to_minutes(delay) else interval 0 minutes end) as latest from x group by 1, 2")
def delay_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dispatch.shift_after_delay(*_delayed(spark, sf_dir))
    return out.groupBy("route_id", "seq").agg(F.count("*").alias("n"), F.count_if("shifted").alias("shifted"), F.max("planned_at").alias("latest"))


@query(f"with {_DELAY_SQL} select route_id, 'client' || (vehicle_id % 3) || '@x.ro' as mail_to, min(line) as seq, any_value(delay) as delay_min from x where moved and line % 3 <> 0 group by 1, 2")
def delay_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.delay_mails(*_delayed(spark, sf_dir)).select("route_id", "mail_to", "seq", "delay_min")


@query("""
with s as (select l_orderkey as route_id, min(l_linenumber) as a, max(l_linenumber) as b, nullif(count(*) filter (where l_linenumber not in (1, 7)), 0) as n from lineitem group by 1),
d as (select o_orderkey as route_id, strftime(o_orderdate, '%Y-%m-%d') as transport_date, case when o_orderkey % 6 <> 0 then 'B' || (o_orderkey % 90) end as vehicle, 'loc ' || a as place_start, 'loc ' || b as place_end, n as unloading_places from orders left join s on route_id = o_orderkey)
select route_id, transport_date, vehicle, place_start, place_end, unloading_places, array_to_string(list_filter([case when vehicle is null then 'vehicle' end, case when place_start is null then 'place_start' end, case when place_end is null then 'place_end' end, case when unloading_places is null then 'unloading_places' end], lambda x: x is not null), ',') as missing from d""")
def transport_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    routes = table(spark, sf_dir, "orders").select(k.alias("route_id"), F.col("o_orderdate").alias("route_date"), F.when(k % 6 != 0, F.concat(F.lit("B"), (k % 90).cast("string"))).alias("plate"), F.lit(None).cast("string").alias("code"))
    stops = t.runs(spark, sf_dir).select(F.col("tpo_id").alias("route_id"), F.col("line").alias("seq"), F.concat(F.lit("loc "), F.col("line").cast("string")).alias("name"), t.order_kind(F.col("line")).alias("kind"))
    out = dispatch.declaration(routes, stops, {"fiscal_code": "RO1", "name": "Firma"})
    return out.select("route_id", "transport_date", "vehicle", "place_start", "place_end", "unloading_places", F.array_join("missing", ",").alias("missing"))


@query("""
with i as (select o_orderkey % 11 = 0 as a, o_orderkey % 13 = 0 as b, o_custkey % 7 = 0 as c, o_orderkey % 17 = 0 as d, o_orderkey % 5 = 0 as e from orders)
select error, count(*) as n from (select unnest(list_filter([case when a then 'number_missing' end, case when b then 'date_missing' end, case when c then 'client_missing' end, case when d then 'tax_id_missing' end, case when e then 'total_invalid' end], lambda x: x is not null)) as error from i) group by 1""")
def invoice_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    errors = dispatch.invoice_errors(F.when(k % 11 != 0, k.cast("string")).otherwise(" "), F.when(k % 13 != 0, F.col("o_orderdate")), F.when(F.col("o_custkey") % 7 != 0, "x"), F.when(k % 17 != 0, "RO1"), F.when(k % 5 == 0, F.when(k % 2 == 0, -1.0)).otherwise(F.col("o_totalprice")))
    return table(spark, sf_dir, "orders").select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))
