"""The star-schema test tables read as freight data. The analogy is stated column by column; nothing here is measured freight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators.grouped import in_parts
from haulspark.operators.telematics import next_open_stops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a run: its order the transport order, its supplier the vehicle, its quantity the kilometres."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("tpo_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("goods_id"), F.col("l_suppkey").alias("vehicle_id"),
        F.col("l_shipdate").cast("date").alias("run_date"), F.col("l_quantity").alias("km"), F.col("l_extendedprice").alias("value"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a route; distances and costs are functions of its price, missing for some keys."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    planned = F.floor(F.col("o_totalprice") / 100) / 10
    return o.select(
        key.alias("route_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").cast("date").alias("route_date"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"), "anulata").when(F.col("o_orderstatus") == "P", "planificata").otherwise("finalizata").alias("status"),
        planned.alias("planned_km"), F.when(key % 7 != 0, planned + key % 11).alias("actual_km"),
        (planned * 2).alias("planned_min"), F.when(key % 7 != 0, planned * 2 + key % 13).alias("actual_min"),
        F.when(key % 5 != 0, F.floor(F.col("o_totalprice")) / 4).alias("cost"),
    )


ROUTES_SQL = """
routes as (
  select o_orderkey as route_id, o_custkey as client_id, cast(o_orderdate as date) as route_date,
         case when o_orderstatus = 'O' and o_orderpriority = '5-LOW' then 'anulata' when o_orderstatus = 'P' then 'planificata' else 'finalizata' end as status,
         floor(o_totalprice / 100) / 10 as planned_km,
         case when o_orderkey % 7 <> 0 then floor(o_totalprice / 100) / 10 + o_orderkey % 11 end as actual_km,
         floor(o_totalprice / 100) / 10 * 2 as planned_min,
         case when o_orderkey % 7 <> 0 then floor(o_totalprice / 100) / 10 * 2 + o_orderkey % 13 end as actual_min,
         case when o_orderkey % 5 <> 0 then floor(o_totalprice) / 4 end as cost
  from orders
)"""


def order_kind(line: Column) -> Column:
    return F.when(line == 1, "depot_start").when(line == 7, "pauza").otherwise("livrare")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is also a stop: planned ``line`` times 20 days after the order, reached on its ship date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return in_parts(li, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("line"), order_kind(F.col("l_linenumber")).alias("kind"), F.col("l_suppkey").alias("vehicle_id"),
        (F.col("o_orderdate") + F.make_interval(days=F.col("l_linenumber") * 20)).alias("planned_at"),
        F.col("l_shipdate").alias("actual_at"), F.col("l_quantity").alias("km"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity") * 10).alias("load_kg"),
    )


STOPS_SQL = """
stops as (
  select l_orderkey as route_id, l_linenumber as line,
         case when l_linenumber = 1 then 'depot_start' when l_linenumber = 7 then 'pauza' else 'livrare' end as kind, l_suppkey as vehicle_id,
         o_orderdate + to_days(cast(l_linenumber * 20 as int)) as planned_at, l_shipdate as actual_at, l_quantity as km,
         case when l_partkey % 3 <> 0 then l_quantity * 10 end as load_kg
  from lineitem join orders on l_orderkey = o_orderkey
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is also a transport request: F delivered, P failed, O new."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "livrat").when(F.col("o_orderstatus") == "P", "esuat").otherwise("nou")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").cast("date").alias("requested_date"), status.alias("status"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"))


REQUESTS_SQL = """
requests as (
  select o_orderkey as order_id, o_custkey as client_id, cast(o_orderdate as date) as requested_date,
         case when o_orderstatus = 'F' then 'livrat' when o_orderstatus = 'P' then 'esuat' else 'nou' end as status, o_totalprice as value, o_orderpriority as priority
  from orders
)"""


def tariffs(spark: SparkSession) -> DataFrame:
    """Rates a region with overlapping validity; every other one is of a vehicle class."""
    return spark.range(40).select(
        (F.col("id") % 5).cast("int").alias("region"), F.col("id").cast("int").alias("pos"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.floor(F.col("id") / 5) * 300).cast("int")).alias("valid_from"),
        F.when(F.col("id") % 3 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.floor(F.col("id") / 5) * 300 + 500).cast("int"))).alias("valid_to"),
        F.when(F.col("id") % 2 == 0, "Brand#1").alias("cls"), (1 + F.col("id") * 0.25).alias("tariff"),
    )


TARIFFS_SQL = """
tariffs as (
  select cast(i % 5 as int) as region, cast(i as int) as pos, date '1995-01-01' + cast(i // 5 * 300 as int) as valid_from,
         case when i % 3 <> 0 then date '1995-01-01' + cast(i // 5 * 300 + 500 as int) end as valid_to,
         case when i % 2 = 0 then 'Brand#1' end as cls, 1 + i * 0.25::double as tariff
  from range(40) t(i)
)"""


def brackets(spark: SparkSession) -> DataFrame:
    """Zone rates by weight bracket; brackets touch and one spans all."""
    return spark.range(30).select(
        (F.col("id") % 5).cast("int").alias("region"), F.col("id").cast("int").alias("pos"),
        (F.floor(F.col("id") / 5) * 8.0).alias("low"), F.when(F.col("id") < 25, F.floor(F.col("id") / 5) * 8.0 + F.when(F.col("id") < 5, 60.0).otherwise(8.0)).alias("high"),
        F.lit("1994-01-01").cast("date").alias("valid_from"), F.when(F.col("id") % 4 == 0, F.lit("2000-06-30").cast("date")).alias("valid_to"), (F.col("id") * 3 + 5.0).alias("rate"),
    )


BRACKETS_SQL = """
brackets as (
  select cast(i % 5 as int) as region, cast(i as int) as pos, i // 5 * 8.0::double as low,
         case when i < 25 then i // 5 * 8.0::double + case when i < 5 then 60.0 else 8.0 end end as high,
         date '1994-01-01' as valid_from, case when i % 4 = 0 then date '2000-06-30' end as valid_to, i * 3 + 5.0::double as rate
  from range(30) t(i)
)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a vehicle's sample: its value the speed, its place a function of its id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("speed"),
        (44.0 + (F.col("event_id") * 37 % 1000) / 10000.0).alias("lat"), (26.0 + (F.col("event_id") * 91 % 1000) / 10000.0).alias("lon"),
    )


POSITIONS_SQL = """
positions as (
  select event_id, user_id as vehicle_id, ts, value as speed,
         44.0::double + (event_id * 37 % 1000) / 10000.0::double as lat, 26.0::double + (event_id * 91 % 1000) / 10000.0::double as lon
  from events
)"""


def vehicle_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stops a vehicle, placed by its number."""
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("vehicle_id")).distinct()
    return v.select("vehicle_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(
        "vehicle_id", (F.col("vehicle_id") * 10 + F.col("k")).alias("stop_id"),
        (44.0 + ((F.col("vehicle_id") * 13 + F.col("k") * 333) % 1000) / 10000.0).alias("lat"), (26.0 + ((F.col("vehicle_id") * 29 + F.col("k") * 333) % 1000) / 10000.0).alias("lon"),
    )


VEHICLE_STOPS_SQL = """
vstops as (
  select vehicle_id, vehicle_id * 10 + k as stop_id,
         44.0::double + ((vehicle_id * 13 + k * 333) % 1000) / 10000.0::double as lat, 26.0::double + ((vehicle_id * 29 + k * 333) % 1000) / 10000.0::double as lon
  from (select distinct user_id as vehicle_id from events), range(3) t(k)
)"""


def vehicle_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next stop that every other vehicle owes: one of its own, planned within January, with a window that opens at some half hour."""
    v = F.col("vehicle_id")
    stops = vehicle_stops(spark, sf_dir).where(v % 2 == 0).select(
        "vehicle_id", "stop_id", "lat", "lon", (F.col("stop_id") - v * 10).alias("seq"), (v * 7).alias("route_id"),
        F.when(F.col("stop_id") - v * 10 < v % 3, "finalizat").otherwise("planificat").alias("status"), F.lit("livrare").alias("kind"),
        F.when(v % 10 != 0, F.lit("2024-01-02").cast("timestamp") + F.make_dt_interval(days=(v % 28).cast("int"), hours=(v % 24).cast("int"))).alias("planned_at"),
        F.when(v % 6 != 0, F.concat(F.lpad((v % 24).cast("string"), 2, "0"), F.lit(":30:00"))).alias("window_start"),
    )
    return next_open_stops(stops)


VEHICLE_PLAN_SQL = """
vplan as (
  select vehicle_id, vehicle_id * 7 as route_id, stop_id as next_stop_id, lat as next_lat, lon as next_lon,
         case when vehicle_id % 10 <> 0 then timestamp '2024-01-02' + to_days(cast(vehicle_id % 28 as int)) + to_hours(cast(vehicle_id % 24 as int)) end as planned_at,
         case when vehicle_id % 6 <> 0 then vehicle_id % 24 * 60 + 30 end as opens
  from vstops where vehicle_id % 2 = 0 and stop_id - vehicle_id * 10 = vehicle_id % 3
)"""
