"""Figures, costs, pricing and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions.numeric import exact_sum, half_up, percent, vat_rate
from haulspark.functions.timez import local_week
from haulspark.operators import analytics, documents, pricing, reporting
from haulspark.operators.grouped import in_parts
from haulspark.operators.joins import asof, asof_with_fallback, bracket, small
from haulspark.sources import tables as t
from haulspark.sources.tables import table

FIRST, LAST = "1996-01-01", "1997-12-31"
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its own name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""
with {t.ROUTES_SQL}, {t.STOPS_SQL}, {t.REQUESTS_SQL},
r as (select * from routes where route_date between date '{FIRST}' and date '{LAST}' and status <> 'anulata'),
s as (select route_id, count(*) as measured, count(*) filter (where actual_at <= planned_at + interval 15 minutes) as on_time from stops where kind not in ('depot_start', 'depot_end', 'pauza', 'repaus') group by 1),
a as (
  select count(*) as routes, cast(sum(planned_km::decimal(28,4)) as double) as pk, cast(sum(actual_km::decimal(28,4)) as double) as ak,
         cast(sum(planned_min::decimal(28,4)) as double) as pm, cast(sum(actual_min::decimal(28,4)) as double) as am,
         cast(sum(cost::decimal(28,4)) as double) as c, count(cost) as costed, coalesce(sum(measured), 0)::bigint as measured, coalesce(sum(on_time), 0)::bigint as on_time
  from r left join s using (route_id)
), o as (
  select count(*) filter (where status = 'livrat') as orders_delivered, count(*) filter (where status not in ('livrat', 'esuat', 'anulat')) as orders_open
  from requests where requested_date between date '{FIRST}' and date '{LAST}'
)
select routes, floor(pk * 10 + 0.5) / 10 as planned_km, floor(ak * 10 + 0.5) / 10 as actual_km, floor((ak - pk) * 10 + 0.5) / 10 as delta_km,
       floor(pm / 60 * 10 + 0.5) / 10 as planned_hours, floor(am / 60 * 10 + 0.5) / 10 as actual_hours,
       case when costed > 0 then floor(c * 100 + 0.5) / 100 end as cost_total, case when costed > 0 then floor(c / costed * 100 + 0.5) / 100 end as cost_per_route,
       measured, on_time, case when measured > 0 then floor(on_time / measured * 1000 + 0.5) / 10 end as on_time_pct, orders_delivered, orders_open
from a, o""")
def cockpit_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cockpit(t.routes(spark, sf_dir), t.stops(spark, sf_dir), t.requests(spark, sf_dir), FIRST, LAST)


@query(f"""
with {t.STOPS_SQL}
select vehicle_id, count(*) as measured, count(*) filter (where actual_at <= planned_at + interval 15 minutes) as on_time,
       floor(count(*) filter (where actual_at <= planned_at + interval 15 minutes) / count(*) * 1000 + 0.5) / 10 as on_time_pct
from stops where kind not in ('depot_start', 'depot_end', 'pauza', 'repaus') group by 1""")
def punctuality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.punctuality(t.stops(spark, sf_dir), "vehicle_id")


@query(f"""
with {t.ROUTES_SQL}, {t.STOPS_SQL},
s as (select route_id, count(*) as n_stops, count(*) filter (where actual_at <= planned_at + interval 15 minutes and kind = 'livrare') as on_time from stops group by 1)
select route_id, n_stops, on_time, planned_km, actual_km, floor((actual_km - planned_km) * 10 + 0.5) / 10 as delta_km, actual_min - planned_min as delta_min, cost
from routes join s using (route_id) where route_date between date '{FIRST}' and date '{LAST}' and status <> 'anulata'""")
def cockpit_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = t.routes(spark, sf_dir).where(F.col("route_date").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")) & (F.col("status") != "anulata"))
    s = t.stops(spark, sf_dir)
    reached = analytics.on_time(F.col("planned_at"), F.col("actual_at")) & (F.col("kind") == "livrare")
    per_route = s.groupBy("route_id").agg(F.count("*").alias("n_stops"), F.count_if(reached).alias("on_time"))
    return analytics.plan_against_actual(routes).join(per_route, "route_id").select("route_id", "n_stops", "on_time", "planned_km", "actual_km", "delta_km", "delta_min", "cost")


@query(f"""
with {t.STOPS_SQL}, s as (
  select vehicle_id, cast(sum(km::decimal(28,4)) as double) as total_km, cast(sum((case when coalesce(load_kg, 0) <= 0 then km else 0 end)::decimal(28,4)) as double) as empty_km
  from stops where km >= 0 group by 1)
select *, case when total_km > 0 then floor(empty_km / total_km * 1000 + 0.5) / 10 end as empty_pct from s""")
def empty_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.empty_km(t.stops(spark, sf_dir), "vehicle_id")


@query("""
select l_suppkey as vehicle_id, floor(cast(sum(l_quantity::decimal(28,4)) as double) / 2000 * 1000 + 0.5) / 10 as weight_pct,
       floor(cast(sum(l_tax::decimal(28,4)) as double) / 40 * 1000 + 0.5) / 10 as volume_pct
from lineitem group by 1""")
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t.runs(spark, sf_dir)
    return r.groupBy("vehicle_id").agg(percent(exact_sum(F.col("km")), F.lit(2000.0)).alias("weight_pct"), percent(exact_sum(F.col("tax")), F.lit(40.0)).alias("volume_pct"))


_VEHICLES_SQL = """
v as (
  select s_suppkey as vehicle_id, case when s_suppkey % 4 = 0 then floor(s_acctbal) / 1000 end as cost_per_km, 6.5 + s_suppkey % 3 as fuel_price,
         case when s_suppkey % 5 <> 0 then 28.0 + s_suppkey % 7 end as consumption, case when s_suppkey % 3 = 0 then 0.12 end as toll_km, case when s_suppkey % 6 <> 0 then 0.2 end as depreciation_km,
         case when s_suppkey % 7 = 0 then 30.0 end as hourly_wage, case when s_suppkey % 2 = 0 then 25.0 end as company_wage, case when s_suppkey % 11 <> 0 then 22.5 end as cost_per_hour
  from supplier
), parts as (
  select *, floor((fuel_price * consumption / 100)::double * 10000 + 0.5) / 10000 as fuel_km from v
), rates as (
  select vehicle_id,
         coalesce(cost_per_km, case when fuel_km is not null or toll_km is not null or depreciation_km is not null
           then floor((((0.0::double + coalesce(fuel_km, 0)::double) + coalesce(toll_km, 0)::double) + coalesce(depreciation_km, 0)::double) * 10000 + 0.5) / 10000 end) as per_km,
         coalesce(hourly_wage, company_wage, cost_per_hour)::double as per_hour
  from parts
)"""


def _vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("vehicle_id"), F.when(k % 4 == 0, F.floor("s_acctbal") / 1000).alias("cost_per_km"), (F.lit(6.5) + k % 3).alias("fuel_price"),
        F.when(k % 5 != 0, 28.0 + k % 7).alias("consumption"), F.when(k % 3 == 0, 0.12).alias("toll_km"), F.when(k % 6 != 0, 0.2).alias("depreciation_km"), F.lit(None).cast("double").alias("maintenance_km"),
        F.when(k % 7 == 0, 30.0).alias("hourly_wage"), F.when(k % 2 == 0, 25.0).alias("company_wage"), F.when(k % 11 != 0, 22.5).alias("cost_per_hour"),
    )


@query(f"with {_VEHICLES_SQL} select * from rates")
def cost_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cost_rates(_vehicles(spark, sf_dir)).select("vehicle_id", "per_km", "per_hour")


@query(f"""
with {_VEHICLES_SQL}, w as (
  select l_suppkey as vehicle_id, cast(sum(l_quantity::decimal(28,4)) as double) as km, cast(sum((l_quantity * 2)::decimal(28,4)) as double) as minutes, count(*) as stops, cast(sum((l_quantity * 10)::decimal(28,4)) as double) as kg
  from lineitem group by 1
), c as (
  select vehicle_id, km, minutes, stops, kg, floor(per_km * km * 100 + 0.5) / 100 as km_cost, floor(per_hour * (minutes / 60) * 100 + 0.5) / 100 as hour_cost,
         case when per_km is not null or per_hour is not null then floor((coalesce(per_km * km, 0) + coalesce(per_hour * (minutes / 60), 0)) * 100 + 0.5) / 100 end as total_cost
  from w join rates using (vehicle_id))
select vehicle_id, km_cost, hour_cost, total_cost, floor(total_cost / stops * 100 + 0.5) / 100 as per_stop, floor(total_cost / kg * 1000 + 0.5) / 1000 as per_kg from c""")
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t.runs(spark, sf_dir).groupBy("vehicle_id").agg(exact_sum(F.col("km")).alias("km"), exact_sum(F.col("km") * 2).alias("minutes"), F.count("*").alias("stops"), exact_sum(F.col("km") * 10).alias("kg"))
    rates = analytics.cost_rates(_vehicles(spark, sf_dir)).select("vehicle_id", "per_km", "per_hour")
    return analytics.activity_cost(r.join(rates, "vehicle_id")).select("vehicle_id", "km_cost", "hour_cost", "total_cost", "per_stop", "per_kg")


_RUNS_REGION_SQL = """
facts as (
  select l_orderkey as tpo_id, l_linenumber as line, l_partkey as goods_id, l_suppkey as vehicle_id, cast(l_shipdate as date) as run_date, l_quantity as km, l_extendedprice as value, n_regionkey as region, p_brand as cls0
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey
)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(small(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("vehicle_id"), F.col("n_regionkey").alias("region"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("goods_id"), F.col("p_brand").alias("cls0"))
    return t.runs(spark, sf_dir).select("tpo_id", "line", "goods_id", "vehicle_id", "run_date", "km", "value").join(s, "vehicle_id").join(p, "goods_id")


@query(f"""
with {_RUNS_REGION_SQL}, {t.TARIFFS_SQL}, hit as (
  select f.*, (select tariff from tariffs t where t.region = f.region and t.valid_from <= f.run_date and (t.valid_to is null or t.valid_to >= f.run_date) order by t.valid_from desc, t.pos limit 1) as tariff from facts f)
select region, tariff, count(*) as n_runs, cast(sum((floor(value * coalesce(tariff, 0) * 100 + 0.5) / 100)::decimal(28,4)) as double) as amount from hit group by 1, 2""")
def asof_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = asof(_facts(spark, sf_dir), t.tariffs(spark), ["region"], "run_date", ["tariff"])
    return hit.groupBy("region", "tariff").agg(F.count("*").alias("n_runs"), exact_sum(half_up(F.col("value") * F.coalesce("tariff", F.lit(0.0)), 2)).alias("amount"))


@query(f"""
with {_RUNS_REGION_SQL}, {t.TARIFFS_SQL}, hit as (
  select f.*, coalesce(
    (select tariff from tariffs t where t.region = f.region and t.cls = f.cls0 and t.valid_from <= f.run_date and (t.valid_to is null or t.valid_to >= f.run_date) order by t.valid_from desc, t.pos limit 1),
    (select tariff from tariffs t where t.region = f.region and t.cls is null and t.valid_from <= f.run_date and (t.valid_to is null or t.valid_to >= f.run_date) order by t.valid_from desc, t.pos limit 1)) as tariff from facts f)
select cls0 as vehicle_class, tariff, count(*) as n_runs from hit group by 1, 2""")
def asof_with_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = asof_with_fallback(_facts(spark, sf_dir), t.tariffs(spark), ["region"], "run_date", "cls0", ["tariff"])
    return hit.groupBy(F.col("cls0").alias("vehicle_class"), "tariff").agg(F.count("*").alias("n_runs"))


@query(f"""
with {_RUNS_REGION_SQL}, {t.BRACKETS_SQL}, hit as (
  select f.*, (select rate from brackets b where b.region = f.region and f.km >= coalesce(b.low, 0) and (b.high is null or f.km <= b.high) and b.valid_from <= f.run_date and (b.valid_to is null or b.valid_to >= f.run_date)
    order by coalesce(b.high - b.low, 'infinity'::double), b.valid_from desc, b.pos limit 1) as rate from facts f)
select region, rate, count(*) as n_runs from hit group by 1, 2""")
def bracket_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = bracket(_facts(spark, sf_dir), t.brackets(spark), ["region"], "km", "run_date", ["rate"])
    return hit.groupBy("region", "rate").agg(F.count("*").alias("n_runs"))


_LINES_SQL = """
orders_in as (select o_orderkey as tpo_id, o_custkey as client_id, case when o_orderkey % 3 <> 0 then floor(o_totalprice) / 100 end as trip_rate, case when o_orderkey % 4 <> 0 then 1.5::double end as km_rate, case when o_orderkey % 5 = 0 then 120.0::double end as min_km from orders),
driven as (select l_orderkey as tpo_id, cast(sum(l_quantity::decimal(28,4)) as double) as driven_km from lineitem group by 1),
trips as (select * from orders_in left join driven using (tpo_id)),
zone_taxes as (select l_orderkey as tpo_id, l_suppkey % 10 as zone_id, l_linenumber * 1000000 + l_partkey as place, case when l_suppkey % 10 <> 7 then (l_suppkey % 10) * 2.5::double end as rate from lineitem),
lines as (
  select tpo_id, 'trip_rate' as kind, 1.0::double as quantity, trip_rate as unit_rate, floor(trip_rate * 100 + 0.5) / 100 as amount, null::varchar as warning from trips where trip_rate is not null
  union all
  select tpo_id, 'km_rate', greatest(floor(driven_km * 100 + 0.5) / 100, coalesce(min_km, 0)), km_rate, floor(greatest(floor(driven_km * 100 + 0.5) / 100, coalesce(min_km, 0)) * km_rate * 100 + 0.5) / 100, null from trips where km_rate is not null and driven_km is not null
  union all
  select tpo_id, 'zone_tax', 1.0, rate, floor(coalesce(rate, 0) * 100 + 0.5) / 100, case when rate is null then 'zone_without_rate' end from (select tpo_id, zone_id, any_value(rate) as rate from zone_taxes group by 1, 2)
  union all
  select o_orderkey, 'surcharge', case when o_orderkey % 2 = 0 then 2.0 else 1.0 end, 45.5, floor(45.5 * case when o_orderkey % 2 = 0 then 2.0 else 1.0 end * 100 + 0.5) / 100, null from orders where o_orderpriority = '1-URGENT'
  union all
  select o_orderkey, 'manual', 1.0, 10.25, 10.25, null from orders where o_orderkey % 50 = 0
)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    runs = in_parts(t.runs(spark, sf_dir), "tpo_id")
    driven = runs.groupBy("tpo_id").agg(exact_sum(F.col("km")).alias("driven_km"))
    trips = in_parts(o.select(k.alias("tpo_id"), F.when(k % 3 != 0, F.floor("o_totalprice") / 100).alias("trip_rate"), F.when(k % 4 != 0, 1.5).alias("km_rate"), F.when(k % 5 == 0, 120.0).alias("min_km")), "tpo_id").join(driven, "tpo_id", "left")
    zone = F.col("vehicle_id") % 10
    taxes = runs.select("tpo_id", zone.alias("zone_id"), (F.col("line") * 1000000 + F.col("goods_id")).alias("place"), F.when(zone != 7, zone * 2.5).alias("rate"))
    extra = o.where("o_orderpriority = '1-URGENT'").select(k.alias("tpo_id"), F.lit("DM").alias("code"), F.lit(45.5).alias("rate"), F.when(k % 2 == 0, 2.0).alias("quantity"))
    manual = o.where(k % 50 == 0).select(k.alias("tpo_id"), F.lit(10.25).alias("amount"))
    return pricing.price_lines(trips, taxes, extra, manual)


@query(f"with {_LINES_SQL} select tpo_id, count(*) as n_lines, floor(cast(sum(amount::decimal(28,4)) as double) * 100 + 0.5) / 100 as total, count(warning) as warnings from lines group by 1")
def tpo_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.totals(_lines(spark, sf_dir))


@query(f"""
with {_LINES_SQL}
select tpo_id, {", ".join(f"floor(coalesce(cast(sum(amount::decimal(28,4)) filter (where kind = '{k}') as double), 0) * 100 + 0.5) / 100 as {k}" for k in ("trip_rate", "km_rate", "zone_tax", "surcharge", "manual"))},
       floor(cast(sum(amount::decimal(28,4)) as double) * 100 + 0.5) / 100 as total
from lines group by 1""")
def charge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.charge_summary(_lines(spark, sf_dir))


@query("""
with l as (select o_custkey as client_id, count(*) as n_lines, floor(cast(sum((floor(o_totalprice / 10 * 100 + 0.5) / 100)::decimal(28,4)) as double) * 100 + 0.5) / 100 as subtotal from orders group by 1),
c as (select c_custkey as client_id, case when c_mktsegment = 'FURNITURE' then 0.0::double when c_custkey % 4 = 0 then 9.0 else 19.0 end as vat_pct from customer),
v as (select *, floor(subtotal * vat_pct / 100 * 100 + 0.5) / 100 as vat from l join c using (client_id)),
x as (select *, floor((subtotal + vat) * 100 + 0.5) / 100 as total, case when client_id % 3 = 0 then floor((subtotal + vat) * 100 + 0.5) / 100 when client_id % 3 = 1 then 1.0 end as stored_total from v)
select client_id, n_lines, subtotal, vat_pct, vat, total, stored_total is not null and abs(stored_total - total) > 0.005 as mismatch from x""")
def invoice_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client_id"), (F.col("o_totalprice") / 10).alias("amount"))
    k = F.col("c_custkey")
    regime = F.when(F.col("c_mktsegment") == "FURNITURE", "scutit").otherwise("normal")
    clients = table(spark, sf_dir, "customer").select(k.alias("client_id"), vat_rate(regime, F.when(k % 4 == 0, 9.0)).alias("vat_pct"))
    plain = pricing.invoice_draft(lines, clients, spark.createDataFrame([], "client_id long, stored_total double"))
    stored = plain.select("client_id", F.when(F.col("client_id") % 3 == 0, F.col("total")).when(F.col("client_id") % 3 == 1, 1.0).alias("stored_total"))
    return pricing.invoice_draft(lines, clients, stored).select("client_id", "n_lines", "subtotal", "vat_pct", "vat", "total", "mismatch")


@query("""
with f as (
  select l_orderkey, l_linenumber, case when l_partkey % 9 <> 0 then l_quantity * 1400 end as weight_kg, case when l_suppkey % 4 <> 0 then l_suppkey % 4 end as zone_id,
         l_partkey % 11 <> 0 as supported, case when l_partkey % 13 <> 0 then 'x' else ' ' end as address, l_partkey % 7 <> 0 as known, l_partkey % 8 <> 0 as sure, case when l_suppkey % 17 <> 0 then 'B01ABC' end as plate, l_suppkey % 19 <> 0 as plate_ok,
         l_suppkey % 23 <> 0 as vehicle_known, case when l_suppkey % 3 <> 0 then l_suppkey % 65 end as mma, l_linenumber % 5 as r
  from lineitem
), s as (
  select case when weight_kg is null then 'no_weight' when weight_kg <= 0 or weight_kg > 60000 then 'weight_implausible' when not supported then 'outside_city' when trim(address) = '' then 'no_address' when not known then 'address_unknown' when not sure then 'address_unsure'
              when zone_id is null then 'outside' when plate is null then 'plate_missing' when not plate_ok then 'plate_invalid' when not vehicle_known then 'vehicle_unknown' when mma is null then 'mma_missing'
              when mma < 1 or mma > 60 then 'mma_suspect' when mma <= 7.5 then 'under_threshold' when r = 0 then 'no_bracket' else 'ok' end as status from f)
select status, count(*) as n from s group by 1""")
def zone_tax_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    rows = li.select(
        F.when(p % 9 != 0, F.col("l_quantity") * 1400).alias("weight_kg"), F.when(s % 4 != 0, s % 4).alias("zone_id"), (p % 11 != 0).alias("supported"), F.when(p % 13 != 0, "x").otherwise(" ").alias("address"),
        (p % 7 != 0).alias("address_known"), (p % 8 != 0).alias("address_sure"), F.when(s % 17 != 0, "B01ABC").alias("plate"), (s % 19 != 0).alias("plate_ok"), (s % 23 != 0).alias("vehicle_known"),
        F.when(s % 3 != 0, s % 65).alias("mma"), F.lit(7.5).alias("threshold"), F.when(F.col("l_linenumber") % 5 != 0, 10.0).alias("rate"),
    )
    return pricing.zone_tax_status(rows).groupBy("status").agg(F.count("*").alias("n"))


@query("""
with s as (select l_suppkey, case when l_partkey % 4 <> 0 then l_quantity end as km, case when l_partkey % 6 <> 0 then l_extendedprice end as value, null::double as weight from lineitem)
select * from (
  select 'km' as source, floor(cast(sum(km::decimal(28,4)) as double) * 10000 + 0.5) / 10000 as total, count(km) as counted, count(*) - count(km) as missing from s
  union all select 'value', floor(cast(sum(value::decimal(28,4)) as double) * 10000 + 0.5) / 10000, count(value), count(*) - count(value) from s
  union all select 'weight', null, count(weight), count(*) - count(weight) from s) where counted > 0""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("goods_id")
    rows = t.runs(spark, sf_dir).select(F.when(g % 4 != 0, F.col("km")).alias("km"), F.when(g % 6 != 0, F.col("value")).alias("value"), F.lit(None).cast("double").alias("weight"))
    return reporting.report_totals(rows, ["km", "value", "weight"])


_WARN_SQL = """
with d as (
  select o_orderkey as id, case when o_orderkey % 19 <> 0 then case o_orderstatus when 'F' then 'confirmed' when 'P' then 'extracted' else 'uploaded' end end as status, o_orderkey % 13 = 0 as review, case when o_orderkey % 17 = 0 then ' ' else 'T' || (o_custkey % 400) end as tpo,
         case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as day, case when o_orderkey % 3 <> 0 then o_totalprice / 10 end as gross, 'doc:' || (o_orderkey % 4) as consignment from orders),
k as (select *, case when trim(tpo) <> '' then count(*) over (partition by lower(trim(tpo)), consignment) else 0 end as twins from d),
b as (select id, unnest(list_filter([{rules}], lambda x: x is not null)) as rule from k)
select rule, count(*) as n, array_to_string((list_sort(list(id)))[1:50], ',') as ids from b group by 1"""
_EVERY = "case when status <> 'confirmed' then 'not_confirmed' end, case when review then 'needs_review' end, case when twins > 1 then 'duplicate_tpo' end"


def _warned(spark: SparkSession, sf_dir: str, sources: list[str]) -> DataFrame:
    k, status = F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "extracted").otherwise("uploaded")
    docs = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 19 != 0, status).alias("status"), (k % 13 == 0).alias("needs_review"), F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("T"), (F.col("o_custkey") % 400).cast("string"))).alias("numar_tpo"),
        F.when(k % 11 != 0, F.col("o_orderdate").cast("date")).alias("data_efectuare_cursa"), F.lit(None).cast("date").alias("data_facturare"), F.when(k % 3 != 0, F.col("o_totalprice") / 10).alias("gross_weight_kg"),
        F.concat(F.lit("doc:"), (k % 4).cast("string")).alias("consignment"),
    )
    out = reporting.document_warnings(docs, sources)
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query(_WARN_SQL.format(rules=_EVERY + ", case when trim(tpo) = '' then 'missing_tpo' end, case when day is null then 'missing_date' end, 'missing_invoice_date', case when gross is null then 'missing_quantity_weight' end, case when gross is null then 'missing_gross_weight' end"))
def report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of a template that shows orders, days, invoices, quantities and weights."""
    return _warned(spark, sf_dir, ["numar_tpo", "data_efectuare_cursa", "data_facturare", "cantitate_marfa", "gross_weight_kg"])


@query(_WARN_SQL.format(rules=_EVERY + ", case when gross is not null then 'weight_not_exported' end"))
def report_warnings_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of a template that shows neither weights nor quantities."""
    return _warned(spark, sf_dir, ["ruta_transport"])


@query("""
with r as (
  select l_orderkey, case when l_partkey % 5 = 0 then 'trip:' || (l_partkey % 50)::varchar when l_suppkey % 7 <> 0 then strftime(l_shipdate, '%Y-%m-%d') || '|V' || l_suppkey::varchar else strftime(l_shipdate, '%Y-%m-%d') || '|id:' || l_partkey::varchar end as run from lineitem)
select l_orderkey as tpo_id, count(*) as n_rows, count(distinct run) as n_runs from r group by 1""")
def distinct_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, v = F.col("goods_id"), F.col("vehicle_id")
    trip, plate = F.when(g % 5 == 0, g % 50), F.when(v % 7 != 0, F.concat(F.lit("v "), v.cast("string")))
    rows = t.runs(spark, sf_dir).withColumn("run", reporting.run_identity(trip, F.col("run_date"), plate, g))
    return reporting.distinct_runs(rows, "tpo_id", "run").groupBy("tpo_id").agg(F.count("*").alias("n_rows"), F.max("n_runs").alias("n_runs"))


@query("""
with k as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, count(*) over (partition by l_orderkey, l_suppkey % 20) > 1 as is_duplicate from lineitem)
select l_orderkey as tpo_id, count(*) filter (where is_duplicate) as duplicates, count(*) as n_rows from k group by 1""")
def duplicate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.runs(spark, sf_dir).select("tpo_id", (F.col("vehicle_id") % 20).alias("consignment"))
    return reporting.flag_duplicates(rows, "tpo_id", "consignment").groupBy("tpo_id").agg(F.count_if("is_duplicate").alias("duplicates"), F.count("*").alias("n_rows"))


@query("""
select coalesce(nullif(trim(case when l_suppkey % 10 <> 0 then 'V' || l_suppkey::varchar else ' ' end), ''), '-') as plate, count(*) as n_runs, cast(sum(l_quantity::decimal(28,4)) as double) as km
from lineitem group by 1 order by n_runs desc, km desc, plate limit 50""")
def group_by_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vehicle_id")
    plate = F.coalesce(F.nullif(F.trim(F.when(v % 10 != 0, F.concat(F.lit("V"), v.cast("string"))).otherwise(" ")), F.lit("")), F.lit("-"))
    return t.runs(spark, sf_dir).groupBy(plate.alias("plate")).agg(F.count("*").alias("n_runs"), exact_sum(F.col("km")).alias("km")).orderBy(F.desc("n_runs"), F.desc("km"), "plate").limit(50)


@query("""
select cast(date_trunc('week', timezone('Europe/Bucharest', timezone('UTC', ts))) as date) as week, count(*) as events, count(*) filter (where event_type = 'error') as errors
from events group by 1 order by week desc limit 12""")
def weekly_filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("week", local_week(F.col("ts").cast("timestamp")))
    return e.groupBy("week").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).orderBy(F.desc("week")).limit(12)


@query("""
select count(*) as vehicles, count(*) filter (where s_acctbal < 0) as in_debt, count(*) filter (where s_nationkey % 5 = 0) as region_check, cast(sum(s_acctbal::decimal(28,4)) as double) as balance from supplier""")
def count_if_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").agg(F.count("*").alias("vehicles"), F.count_if(F.col("s_acctbal") < 0).alias("in_debt"), F.count_if(F.col("s_nationkey") % 5 == 0).alias("region_check"), exact_sum(F.col("s_acctbal")).alias("balance"))


@query("""
with d as (select o_custkey as operator, list_distinct(list_filter([case when o_orderkey % 3 = 0 then 'plate' end, case when o_orderkey % 5 = 0 then 'tpo' end], lambda x: x is not null)) as fields from orders)
select operator, count(*) as documents, count(*) filter (where len(fields) > 0) as touched, floor(count(*) filter (where len(fields) > 0) / count(*) * 1000 + 0.5) / 1000 as touch_rate from d group by 1""")
def feedback_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    fields = F.filter(F.array(F.when(k % 3 == 0, "plate"), F.when(k % 5 == 0, "tpo")), lambda x: x.isNotNull())
    return documents.feedback(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("operator"), fields.alias("corrected_fields")))


@query("""
with d as (select o_orderkey as id, unnest(list_filter([case when o_orderkey % 3 = 0 then 'plate' end, case when o_orderkey % 5 = 0 then 'tpo' end, case when o_orderkey % 11 = 0 then 'date' end], lambda x: x is not null)) as field from orders)
select field, count(*) as corrections, count(distinct id) as documents, array_to_string((list_sort(list(id)))[1:3], ',') as examples from d group by 1""")
def field_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    fields = F.filter(F.array(F.when(k % 3 == 0, "plate"), F.when(k % 5 == 0, "tpo"), F.when(k % 11 == 0, "date")), lambda x: x.isNotNull())
    out = documents.field_corrections(table(spark, sf_dir, "orders").select("o_orderkey", fields.alias("corrected_fields")), "o_orderkey")
    return out.withColumn("examples", F.array_join(F.transform("examples", lambda i: i.cast("string")), ","))


@query("""
select row_number() over (order by s_suppkey) as row_no, s_name as name, coalesce(nullif(case when s_suppkey % 6 <> 0 then s_suppkey::varchar end, ''), 'none') as code, case when floor(s_acctbal / 5000)::bigint = 0 then '12' else floor(s_acctbal / 5000)::bigint::varchar end as km
from supplier""")
def template_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(k % 6 != 0, k.cast("string")).alias("code"), F.floor(F.col("s_acctbal") / 5000).alias("km_parcursi"))
    template = [{"key": "name", "source": "s_name", "default": None}, {"key": "code", "source": "code", "default": "none"}, {"key": "km", "source": "km_parcursi", "default": "12"}]
    return reporting.project(rows, template, [F.col("s_suppkey")])
