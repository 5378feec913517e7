"""Ordered rows, texts and vehicle positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.functions import numeric, text
from haulspark.functions.geo import haversine_m
from haulspark.functions.numeric import exact_sum, half_up
from haulspark.operators import documents, planning, sequences
from haulspark.operators import telematics as tele
from haulspark.sources import tables as t
from haulspark.sources.shared import settled
from haulspark.sources.tables import table
from haulspark.streaming.runs import exceptions_to_the_end, hours_to_the_end

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ORDER = ("line", "run_date", "goods_id", "vehicle_id", "value")
_SEQ_SQL = """
stops as (
  select l_orderkey as route_id, row_number() over (partition by l_orderkey order by l_linenumber, cast(l_shipdate as date), l_partkey, l_suppkey, l_extendedprice) as seq, l_suppkey as place, l_partkey as goods_id,
         case when l_partkey % 29 <> 0 then l_quantity end as leg_min, case when l_partkey % 4 <> 0 then (l_partkey % 30)::double end as service_min, (l_partkey % 24 * 30)::double as opens, (l_partkey % 24 * 30 + 60)::double as closes, l_quantity as km
  from lineitem)"""


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sequences.resequence(t.runs(spark, sf_dir), "tpo_id", [F.col(c) for c in _ORDER])
    g = F.col("goods_id")
    return r.select(
        F.col("tpo_id").alias("route_id"), "seq", F.col("vehicle_id").alias("place"), "goods_id", F.when(g % 29 != 0, F.col("km")).alias("leg_min"), F.when(g % 4 != 0, (g % 30).cast("double")).alias("service_min"),
        (g % 24 * 30).cast("double").alias("opens"), (g % 24 * 30 + 60).cast("double").alias("closes"), "km",
    )


@query(f"with {_SEQ_SQL} select route_id, seq, place from stops")
def resequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stops(spark, sf_dir).select("route_id", "seq", "place")


@query(f"with {_SEQ_SQL}, l as (select *, lag(place) over (partition by route_id order by seq) as from_place from stops) select route_id, seq, from_place, place, abs(place - from_place) * 5 as leg_km from l")
def legs_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.legs(_stops(spark, sf_dir)).select("route_id", "seq", "from_place", "place", (F.abs(F.col("place") - F.col("from_place")) * 5).alias("leg_km"))


_CLOCK_SQL = f"""
with {_SEQ_SQL}, w as (select *, case when seq = 1 then 0 else leg_min end as way, coalesce(service_min, 15) as stay from stops),
c as (select *, bool_or(way is null) over (partition by route_id order by seq rows unbounded preceding) as unknown, sum(coalesce(way, 0) + stay) over (partition by route_id order by seq rows unbounded preceding) + 480 as dep from w),
clocks as (select route_id, seq, opens, closes, km, case when not unknown then dep end as departure, case when not unknown then dep - stay end as arrival from c)"""


@query(_CLOCK_SQL + " select route_id, seq, arrival, departure from clocks")
def schedule_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.schedule(_stops(spark, sf_dir), start=480).select("route_id", "seq", "arrival", "departure")


@query(_CLOCK_SQL + " select route_id, seq, greatest(arrival - closes, 0) as late_min, greatest(opens - arrival, 0) as early_min from clocks where arrival is not null")
def time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    clocks = sequences.schedule(_stops(spark, sf_dir), start=480).where("arrival is not null")
    return sequences.window_violations(clocks).select("route_id", "seq", "late_min", "early_min")


@query(_CLOCK_SQL + ", t as (select route_id, count(*) as stops, cast(sum(km::decimal(28,4)) as double) as km, count(*) filter (where arrival is null) as unclocked from clocks group by 1) select *, unclocked = 0 as complete from t")
def route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    clocks = sequences.schedule(_stops(spark, sf_dir), start=480)
    out = clocks.groupBy("route_id").agg(F.count("*").alias("stops"), exact_sum(F.col("km")).alias("km"), F.count_if(F.col("arrival").isNull()).alias("unclocked"))
    return out.withColumn("complete", F.col("unclocked") == 0)


@query(_CLOCK_SQL + " select route_id, seq, case when seq >= 3 and seq % 4 <> 0 then arrival + 25 else arrival end as eta from clocks")
def eta_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    clocks = sequences.schedule(_stops(spark, sf_dir), start=480)
    return sequences.shift_clocks(clocks, F.lit(3), F.lit(25.0), F.col("seq") % 4 != 0, clock="arrival").select("route_id", "seq", "eta")


@query(f"with {_SEQ_SQL} select route_id, min(seq) as next_seq, arg_min(place, seq) as next_place from stops where place % 5 <> 0 group by 1")
def next_open_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = _stops(spark, sf_dir).where("place % 5 <> 0")
    return open_.groupBy("route_id").agg(F.min(F.struct("seq", "place")).alias("n")).select("route_id", F.col("n.seq").alias("next_seq"), F.col("n.place").alias("next_place"))


@query(f"""
with {_SEQ_SQL}, k as (select route_id, seq, case when place % 3 = 0 then '' else 'k' || (place % 3)::varchar end as key from stops), m as (select *, row_number() over (partition by route_id order by seq) as n, case when key is distinct from lag(key) over (partition by route_id order by seq) then 1 else 0 end as new from k),
i as (select *, sum(new) over (partition by route_id order by seq rows unbounded preceding) as island from m)
select route_id, key, min(n) as first_row, max(n) as last_row, count(*) as n_rows from i where trim(key) <> '' group by route_id, island, key having count(*) > 1""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stops(spark, sf_dir).select("route_id", "seq", F.when(F.col("place") % 3 == 0, "").otherwise(F.concat(F.lit("k"), (F.col("place") % 3).cast("string"))).alias("key"))
    return sequences.run_lengths(rows, [F.col("seq")], "key", "route_id")


@query(f"with {_SEQ_SQL}, c as (select route_id, seq, sum(km) over (partition by route_id order by seq rows unbounded preceding) as total from stops) select route_id, seq, total - coalesce(lag(total) over (partition by route_id order by seq), 0) as total_step from c")
def cumulative_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("route_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    running = _stops(spark, sf_dir).select("route_id", "seq", F.sum("km").over(w).alias("total"))
    return sequences.differences(running, "route_id", "seq", ["total"]).select("route_id", "seq", "total_step")


@query("""
with r as (select s_nationkey as region, s_suppkey as pos, date '1996-01-01' + (s_suppkey * 37 % 1000)::int as valid_from, case when s_suppkey % 11 <> 0 then date '1996-01-01' + (s_suppkey * 37 % 1000 + s_suppkey * 7 % 120)::int end as valid_to from supplier),
n as (select *, lead(valid_from) over (partition by region order by valid_from, pos) as next_from from r) select region, pos, valid_from, valid_to, next_from from n where next_from is not null and (valid_to is null or valid_to >= next_from)""")
def tariff_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tariffs of each region, a supplier's each, that still hold when the next begins."""
    k = F.col("s_suppkey")
    begins = F.date_add(F.lit("1996-01-01").cast("date"), (k * 37 % 1000).cast("int"))
    tariffs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("region"), k.alias("pos"), begins.alias("valid_from"), F.when(k % 11 != 0, F.date_add(begins, (k * 7 % 120).cast("int"))).alias("valid_to"))
    return sequences.overlaps(tariffs, ["region"]).select("region", "pos", "valid_from", "valid_to", "next_from")


def _routes_for_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("km") % 10 != 0
    return _stops(spark, sf_dir).select("route_id", F.col("seq").cast("int").alias("seq"), F.when(known, F.col("km") * 6).alias("leg_min"), F.when(F.col("km") % 9 != 0, F.col("km") * 7).alias("leg_km"), "service_min")


@query(f"""
with recursive {_SEQ_SQL}, r as (select route_id, seq, case when km % 10 <> 0 then km * 6 else 0 end::double as leg, case when km % 9 <> 0 then km * 7 end::double as km, coalesce(service_min, 15)::double as service from stops),
w(route_id, seq, whole, togo, full_km, km, clock, since, today, kind, arrival, departure, driven) as (
  select route_id, 0::bigint, 0::double, 0::double, null::double, null::double, 480::double, 0::double, 0::double, null::varchar, null::double, null::double, null::double from (select distinct route_id from r)
  union all
  select route_id, seq, whole, case when halt then togo - room else -1 end, full_km, case when halt and km is not null then greatest(0, round(km - part, 3)) else km end,
         case when halt then clock + room + stay else clock + togo + service end, case when halt then 0 else since + togo end, case when halt then case when night then 0 else today + room end else today + togo end,
         case when not halt then 'stop' when night then 'rest' else 'break' end, clock + case when halt then room else togo end, clock + case when halt then room + stay else togo + service end, case when halt then part else km end
  from (
    select *, floor(full_km * room / whole * 1000 + 0.5) / 1000 as part, today + room >= 540 as night, case when today + room >= 540 then 660 else 45 end as stay
    from (
      select *, togo > room as halt
      from (
        select w.route_id, coalesce(n.seq, w.seq) as seq, coalesce(n.leg, w.whole) as whole, coalesce(n.leg, w.togo) as togo, case when n.seq is not null then n.km else w.full_km end as full_km, case when n.seq is not null then n.km else w.km end as km, w.clock, w.since, w.today,
               least(270 - w.since, 540 - w.today) as room, coalesce(n.service, c.service) as service
        from w left join r n on n.route_id = w.route_id and w.togo <= 0 and (w.kind = 'stop' or w.kind is null) and n.seq = w.seq + 1
        left join r c on c.route_id = w.route_id and c.seq = w.seq
        where n.seq is not null or w.togo > 0 or w.kind in ('break', 'rest')) x) y) z)
select route_id, seq::int as seq, kind, arrival, departure, driven as km from w where kind is not null""")
def driving_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.driving_rules(_routes_for_drivers(spark, sf_dir))


_WINDOWS_SQL = """
d as (select * from ({walk})),
n as (select l_orderkey as route_id, unnest(range(1, count(*) + 1))::int as seq from lineitem group by 1),
m as (select route_id, seq, case when route_id % 5 <> 0 then 360 + (route_id * 7 + seq * 90) % 900 end as opens, case when (route_id + seq) % 4 <> 0 then 420 + (route_id * 7 + seq * 90) % 900 end as closes from n),
v as (select route_id, seq, case when floor(arrival) > closes then 'intarziere' when floor(arrival) < opens and arrival < 1440 then 'prea_devreme' end as type, (case when floor(arrival) > closes then floor(arrival) - closes else opens - floor(arrival) end)::bigint as by_min from d join m using (route_id, seq) where kind = 'stop')"""


def _clock(minute):
    return F.format_string("%02d:%02d", (minute / 60).cast("int"), (minute % 60).cast("int"))


def _windows(walked: DataFrame) -> DataFrame:
    r, s = F.col("route_id"), F.col("seq")
    base = (r * 7 + s * 90) % 900
    return walked.where("kind = 'stop'").select("route_id", "seq", F.when(r % 5 != 0, _clock(base + 360)).alias("opens"), F.when((r + s) % 4 != 0, _clock(base + 420)).alias("closes"))


@query(f"with {_WINDOWS_SQL.format(walk=ORACLE_SQL['driving_rules'])} select route_id, seq, type, by_min from v where type is not null")
def missed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops whose windows the breaks and rests of their drivers make them miss."""
    walked = settled(driving_rules(spark, sf_dir))
    return sequences.missed_windows(walked, _windows(walked))


@query(f"""
with {_WINDOWS_SQL.format(walk=ORACLE_SQL['driving_rules'])}, h as (select route_id, count(*) as missed from v where type is not null group by 1)
select route_id, coalesce(sum(km::decimal(28, 3)), 0)::double as km, floor(max(departure) - 480 + 0.5)::bigint as span_min, count(*) filter (kind = 'break') as breaks, count(*) filter (kind = 'rest') as rests, coalesce(any_value(missed), 0) as missed from d left join h using (route_id) group by 1""")
def walk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = settled(driving_rules(spark, sf_dir))
    return sequences.walk_totals(walked, sequences.missed_windows(walked, _windows(walked)))


_HAVERSINE = "2 * 6371000.0::double * asin(least(1.0::double, sqrt(power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query(f"""
with {t.POSITIONS_SQL}, p as (select *, lag(lat) over w as plat, lag(lon) over w as plon from positions window w as (partition by vehicle_id order by ts, event_id))
select vehicle_id, count(*) as n_points, cast(floor(coalesce(cast(sum(({_HAVERSINE.format(a='p', b='')})::decimal(20,6)) as double), 0) + 0.5) as bigint) as trail_m from p group by 1""")
def trail_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.trail_metres(t.positions(spark, sf_dir), "vehicle_id", ["ts", "event_id"])


@query(f"""
with recursive {t.POSITIONS_SQL}, p as (select *, row_number() over (partition by vehicle_id order by ts, event_id) as n, count(*) over (partition by vehicle_id) as total from positions),
w as (
  select vehicle_id, n, total, lat as klat, lon as klon, true as keep from p where n = 1
  union all
  select p.vehicle_id, p.n, p.total, case when far then p.lat else p.klat end, case when far then p.lon else p.klon end, far
  from (select p.*, w.klat, w.klon, {_HAVERSINE.format(a='p.', b='w.k')} >= 4000 as far from w join p on p.vehicle_id = w.vehicle_id and p.n = w.n + 1) p)
select p.event_id, p.vehicle_id, p.ts, p.speed, p.lat, p.lon from w join p using (vehicle_id, n) where w.keep or w.n = w.total""")
def trail_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.thin_trail(t.positions(spark, sf_dir), "vehicle_id", ["ts", "event_id"], least_m=4000.0)


_NEAR_SQL = f"""
with {t.POSITIONS_SQL}, {t.VEHICLE_STOPS_SQL}, near as (
  select p.event_id, p.vehicle_id, p.ts, p.speed, v.stop_id, m, row_number() over (partition by event_id order by m, v.stop_id) as k
  from (select p.event_id, p.vehicle_id, p.ts, p.speed, v.stop_id, {_HAVERSINE.format(a='p.', b='v.')} as m from positions p join vstops v using (vehicle_id)) p, lateral (select p.stop_id) v
), placed as (select event_id, vehicle_id, ts, speed, stop_id, m as stop_m from near where k = 1)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tele.nearest_stop(t.positions(spark, sf_dir), t.vehicle_stops(spark, sf_dir))


@query(_NEAR_SQL + " select event_id, stop_id, floor(stop_m) as stop_m from placed")
def nearest_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("event_id", "stop_id", F.floor("stop_m").cast("double").alias("stop_m"))


_IDLE_SQL = _NEAR_SQL + """
, marked as (select *, speed <= 5 and stop_m > 150 as idle from placed),
spells as (select *, sum((not idle)::int) over (partition by vehicle_id order by ts, event_id rows unbounded preceding) as spell from marked),
clocked as (select *, case when idle then (epoch_us(ts) - epoch_us(min(case when idle then ts end) over (partition by vehicle_id, spell))) / 60000000 end as idle_min from spells)"""


@query(_IDLE_SQL + " select event_id, floor(idle_min * 1000) / 1000 as idle_min from clocked where idle")
def idle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tele.idle_minutes(_placed(spark, sf_dir)).where("idle_min is not null").select("event_id", (F.floor(F.col("idle_min") * 1000) / 1000).alias("idle_min"))


_FOUND_SQL = _IDLE_SQL + f"""
, {t.VEHICLE_PLAN_SQL}, known as (
  select c.*, p.lat, p.lon, n.route_id, n.next_stop_id, (epoch_us(c.ts) - epoch_us(n.planned_at)) / 60000000 as behind, n.planned_at is not null as planned, n.opens,
         {_HAVERSINE.format(a='p.', b='n.next_')} <= 150 as there, extract(hour from local) * 60 + extract(minute from local) as now, floor(idle_min + 0.5) as idle_m
  from (select *, timezone('Europe/Bucharest', timezone('UTC', ts)) as local from clocked) c join positions p using (event_id) left join vplan n on n.vehicle_id = c.vehicle_id),
found as (
  select event_id, vehicle_id, route_id, null::bigint as stop_id, ts, 'viteza' as type, case when speed > 110 then 'critical' else 'warning' end as severity from known where speed > 90
  union all select event_id, vehicle_id, route_id, next_stop_id, ts, 'intarziere', case when floor(behind + 0.5) >= 45 then 'critical' else 'warning' end from known where next_stop_id is not null and behind > 15 and not coalesce(there, false)
  union all select event_id, vehicle_id, route_id, next_stop_id, ts, 'prea_devreme', 'info' from known where planned and there and now + 30 < opens
  union all select event_id, vehicle_id, route_id, next_stop_id, ts, 'abatere_traseu', case when stop_m > 2400 then 'critical' else 'warning' end from known where stop_m > 800 and next_stop_id is not null
  union all select event_id, vehicle_id, route_id, null, ts, 'oprire_neplanificata', case when idle_m >= 40 then 'critical' else 'warning' end from known where speed <= 5 and stop_m > 800 and idle_m >= 20
  union all select event_id, vehicle_id, route_id, null, ts, 'stationare', case when idle_m >= 40 then 'critical' else 'warning' end from known where speed <= 5 and stop_m is null and idle_m >= 20)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tele.exceptions_of(tele.idle_minutes(_placed(spark, sf_dir)).join(t.vehicle_plan(spark, sf_dir), "vehicle_id", "left"))


@query(_FOUND_SQL + " select event_id, vehicle_id, route_id, stop_id, type, severity from found")
def exceptions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).drop("ts")


@query(_FOUND_SQL + """
, first as (select *, row_number() over (partition by type, vehicle_id, route_id, stop_id order by ts, event_id, severity) as k from found)
select type, vehicle_id, route_id, stop_id, event_id, severity from first where k = 1 and not (type = 'viteza' and vehicle_id % 6 = 0 and vehicle_id % 4 <> 0)""")
def exception_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is open already: speeding of some vehicles on their route; of others it is open on another route, which is another matter."""
    v = F.col("vehicle_id")
    plan = t.vehicle_plan(spark, sf_dir)
    open_ = t.positions(spark, sf_dir).where(v % 6 == 0).select("vehicle_id").distinct().join(plan.select("vehicle_id", F.col("route_id").alias("_r")), "vehicle_id", "left")
    route = F.when(v % 4 == 0, F.lit(-1).cast("long")).otherwise(F.col("_r"))
    open_ = open_.select(F.lit("viteza").alias("type"), "vehicle_id", route.alias("route_id"), F.lit(None).cast("long").alias("stop_id"))
    return tele.new_exceptions(_found(spark, sf_dir), open_).select("type", "vehicle_id", "route_id", "stop_id", "event_id", "severity")


@query(f"with {t.POSITIONS_SQL}, r as (select *, row_number() over (partition by vehicle_id order by ts desc, event_id desc) as k from positions) select vehicle_id, event_id, speed, lat, lon from r where k = 1")
def latest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tele.latest_positions(t.positions(spark, sf_dir)).select("vehicle_id", "event_id", "speed", "lat", "lon")


@query("""
with x as (select event_id, case when event_id % 50 = 0 then null else user_id end as vehicle_id, case when event_id % 17 = 0 then 95.0::double else 45.0 end as lat, case when event_id % 31 = 0 then null else 26.0::double end as lon, case when event_id % 23 = 0 then timestamp '2024-03-05' else ts end as ts from events)
select coalesce(case when vehicle_id is null then 'no_vehicle' when lat is null or lon is null or lat not between -90 and 90 then 'bad_coordinates' when ts > timestamp '2024-02-01' + interval 24 hours then 'in_future' end, 'accepted') as reason, count(*) as n from x group by 1""")
def sample_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    x = table(spark, sf_dir, "events").select(
        F.when(k % 50 != 0, F.col("user_id")).alias("vehicle_id"), F.when(k % 17 == 0, 95.0).otherwise(45.0).alias("lat"), F.when(k % 31 != 0, 26.0).alias("lon"),
        F.when(k % 23 == 0, F.lit("2024-03-05").cast("timestamp")).otherwise(F.col("ts").cast("timestamp")).alias("ts"),
    )
    return x.groupBy(F.coalesce(tele.rejection(F.lit("2024-02-01").cast("timestamp")), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(_FOUND_SQL + " select event_id, vehicle_id, route_id, stop_id, type, severity from found")
def stream_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming twin over the events file, run to its end and returned as the table it filled; it finds what the batch finds."""
    return exceptions_to_the_end(spark, sf_dir).drop("ts")


@query("""
with h as (select date_trunc('hour', ts) as start, count(*) as n, max(value) as fastest from events group by 1)
select start, n, fastest from h where start + interval 1 hour <= (select max(ts) - interval 10 minutes from events)""")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples an hour, given out once the watermark has passed the hour."""
    return hours_to_the_end(spark, sf_dir)


@query("select p_partkey, trim(regexp_replace(translate(lower('Țară ' || p_name || ' -ÉÂ'), 'ăâîșşțţáàäãåéèêëíìïóòôöõúùûüçñýÿ', 'aaissttaaaaaeeeeiiiooooouuuucnyy'), '[^a-z0-9]+', ' ', 'g')) as folded from part")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.fold(F.concat(F.lit("Țară "), "p_name", F.lit(" -ÉÂ"))).alias("folded"))


@query("""
with x as (select p_partkey, case when p_partkey % 7 = 0 then '' else 'Șoseaua  ' || p_name end as a, case when p_partkey % 11 = 0 then null else 'soseaua ' || p_type || case when p_partkey % 3 = 0 then ' Ț' else '' end end as b from part),
f as (select p_partkey, case when a = '' then '' else 'soseaua ' || lower(p_name) end as a, case when b is null then '' else 'soseaua ' || lower(p_type) || case when p_partkey % 3 = 0 then ' t' else '' end end as b from x join part using (p_partkey))
select p_partkey, case when a = '' or b = '' then 0 else floor((1 - levenshtein(a, b) / greatest(length(a), length(b))) * 10000 + 0.5) / 10000 end as similarity_score from f""")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without case and marks; an empty one is like nothing."""
    k = F.col("p_partkey")
    a = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Șoseaua  "), "p_name"))
    b = F.when(k % 11 != 0, F.concat(F.lit("soseaua "), "p_type", F.when(k % 3 == 0, " Ț").otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", half_up(text.similarity(a, b), 4).alias("similarity_score"))


@query("""
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::bigint as i, l_partkey % 100 as f, (l_partkey % 8)::int as form from lineitem),
y as (select *, format('{:,}', i) as en, replace(format('{:,}', i), ',', '.') as ro, lpad(f::varchar, 2, '0') as ff, i + f / 100.0::double as v from x)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case form when 0 then ro || ',' || ff when 1 then en || '.' || ff when 2 then i || ',' || ff when 3 then ' ' || i || '.' || ff || ' ' when 4 then 'no ' || i when 5 then i || ',' || f || ',' || ff when 6 then '-' || ro || ',' || ff else '' end as cell,
  case when form in (4, 5, 7) then null when form = 6 then -(i || '.' || ff)::double else (i || '.' || ff)::double end as imported,
  case when form in (4, 5, 7) then null when form = 6 then -(i || '.' || ff)::double else (i || '.' || ff)::double end as printed from y where i >= 1000""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of every line in the ways that sheets and papers write them."""
    i, f = F.floor("l_extendedprice"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0")
    en = F.format_number(i, 0)
    ro, plain = F.replace(en, F.lit(","), F.lit(".")), i.cast("string")
    cells = [F.concat_ws(",", ro, f), F.concat_ws(".", en, f), F.concat_ws(",", plain, f), F.concat(F.lit(" "), plain, F.lit("."), f, F.lit(" ")), F.concat(F.lit("no "), plain), F.concat_ws(",", plain, (F.col("l_partkey") % 100).cast("string"), f), F.concat(F.lit("-"), ro, F.lit(","), f), F.lit("")]
    rows = table(spark, sf_dir, "lineitem").where(i >= 1000).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.get(F.array(*cells), (F.col("l_partkey") % 8).cast("int")).alias("cell"))
    return rows.select("*", numeric.locale_number(F.col("cell")).alias("imported"), numeric.document_number(F.col("cell")).alias("printed"))


@query("select o_orderkey, cast(o_orderdate as date) as parsed, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) end as serial from orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    serial = F.when(F.col("o_orderkey") % 2 == 0, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")).otherwise("31.02.2024")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.day_first_date(F.date_format(d, "dd.MM.yyyy")).alias("parsed"), text.day_first_date(serial).alias("serial"))


@query("""
with v as (select s_suppkey as id, date '2015-01-01' + cast(s_suppkey * 11 as int) as made, case when s_suppkey % 4 = 0 then 'taxi' when s_suppkey % 4 = 1 then 'light_trailer' when s_suppkey % 4 = 2 then 'goods' else 'passenger' end as kind from supplier),
m as (select *, case kind when 'taxi' then 6 when 'light_trailer' then 24 when 'goods' then 12 else case when date_diff('year', made, date '2024-01-10') - case when strftime(made, '%m%d') > '0110' then 1 else 0 end >= 12 then 12 else 24 end end as months from v)
select id, kind, months, cast(made + to_months(cast(months as int)) as date) as first_due from m""")
def inspection_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "taxi").when(k % 4 == 1, "light_trailer").when(k % 4 == 2, "goods").otherwise("passenger")
    v = table(spark, sf_dir, "supplier").select(k.alias("id"), F.date_add(F.lit("2015-01-01").cast("date"), (k * 11).cast("int")).alias("made"), kind.alias("kind"))
    age = F.floor(F.months_between(F.lit("2024-01-10").cast("date"), "made") / 12)
    months = F.when(F.col("kind") == "taxi", 6).when(F.col("kind") == "light_trailer", 24).when(F.col("kind") == "goods", 12).otherwise(F.when(age >= 12, 12).otherwise(24))
    return v.select("id", "kind", months.alias("months"), F.add_months("made", months).alias("first_due"))


@query(f"with {t.POSITIONS_SQL} select event_id, floor(2 * 6371000.0::double * asin(least(1.0::double, sqrt(power(sin(radians(44.05::double - lat) / 2), 2) + cos(radians(lat)) * cos(radians(44.05::double)) * power(sin(radians(26.05::double - lon) / 2), 2))))) as metres from positions")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.positions(spark, sf_dir).select("event_id", F.floor(haversine_m(F.col("lat"), F.col("lon"), F.lit(44.05), F.lit(26.05))).cast("double").alias("metres"))


_PROFILES = {"license": ("licensed", "license", "version", "public"), "secret": ("token", "=", '"'), "table": ("|", " | ")}


@query("""
with d as (select doc_id, lower(text) as x from documents), s as (
  select doc_id, unnest([{'s': (contains(x, 'licensed')::int + contains(x, 'license')::int + contains(x, 'version')::int + contains(x, 'public')::int) / 4, 'pos': 0, 'p': 'license'},
                         {'s': (contains(x, 'token')::int + contains(x, '=')::int + contains(x, '"')::int) / 3, 'pos': 1, 'p': 'secret'}, {'s': (contains(x, '|')::int + contains(x, ' | ')::int) / 2, 'pos': 2, 'p': 'table'}]) as r from d),
k as (select doc_id, r.s as s, r.p as p, row_number() over (partition by doc_id order by r.s desc, r.pos) as n from s)
select doc_id, case when s > 0 then p end as profile, floor(s * 1000 + 0.5) / 1000 as score from k where n = 1""")
def profile_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = documents.profile_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), _PROFILES)
    return scored.select("doc_id", "profile", half_up(F.col("score"), 3).alias("score"))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery notes written from runs, so that what was printed is known."""
    g, v = F.col("goods_id"), F.col("vehicle_id")
    note = F.concat(
        F.when(g % 5 != 0, F.concat(F.lit("TPO: "), (F.col("tpo_id") + 1000000).cast("string"), F.lit("\n"))).otherwise(""),
        F.when(g % 4 != 0, "Aviz nr. PSL-").otherwise("Aviz nr. A-"), (g + 100).cast("string"), F.lit("\nB "), F.lpad((v % 900 + 10).cast("string"), 2, "0"), F.lit(" XYZ\n"), F.date_format("run_date", "dd.MM.yyyy"),
        F.lit("\nbrut "), (F.col("km").cast("int") * 100).cast("string"), F.lit(" kg net "), (F.col("km").cast("int") * 100 - 50 + g % 7 * 20).cast("string"), F.lit(" kg, "), (g % 33 + 1).cast("string"), F.lit(" paleti"),
    )
    return t.runs(spark, sf_dir).select("tpo_id", "line", "goods_id", "vehicle_id", "run_date", "km", note.alias("text"))


@query("""
select l_orderkey as tpo_id, l_linenumber as line, l_partkey as goods_id, l_suppkey as vehicle_id, case when l_partkey % 5 <> 0 then (l_orderkey + 1000000)::varchar end as tpo, case when l_partkey % 4 <> 0 then 'PSL-' else 'A-' end || (l_partkey + 100)::varchar as doc_no,
       'B' || lpad((l_suppkey % 900 + 10)::varchar, 2, '0') || 'XYZ' as plate, cast(l_shipdate as date) as doc_date, l_quantity::int * 100.0::double as gross_kg, l_quantity::int * 100 - 50 + l_partkey % 7 * 20.0::double as net_kg, (l_partkey % 33 + 1)::int as pallets
from lineitem""")
def field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every note."""
    return _fields(_printed(spark, sf_dir))


def _fields(notes: DataFrame) -> DataFrame:
    out = documents.extract_fields(notes.withColumnRenamed("tpo_id", "order_id"))
    return out.select(F.col("order_id").alias("tpo_id"), "line", "goods_id", "vehicle_id", "tpo", "doc_no", "plate", "doc_date", "gross_kg", "net_kg", "pallets")


@query("""
with d as (select l_partkey % 5 <> 0 as has_tpo, l_partkey % 4 <> 0 as has_no, l_quantity::int * 100 as g, l_quantity::int * 100 - 50 + l_partkey % 7 * 20 as n, cast(l_shipdate as date) as day, 0.4 + (l_partkey % 60) / 100.0 as c1, 0.4 + (l_suppkey % 60) / 100.0 as c2 from lineitem),
w as (select greatest(case when not has_tpo or g + 0.05 < n or year(day) <> 2000 or day > date '2000-07-02' then 2 when not has_no then 1 else 0 end,
                      case when c1 >= 0.8 then 0 when c1 >= 0.55 then 1 else 2 end, case when c2 >= 0.8 then 0 when c2 >= 0.5 then 1 else 2 end) as worst, (not has_tpo)::int as e1, (g + 0.05 < n)::int as e2, (year(day) <> 2000)::int as e3, (year(day) = 2000 and day > date '2000-07-02')::int as e4 from d)
select ['auto', 'hitl_optional', 'hitl_required'][worst + 1] as routing, count(*) as n, sum(e1)::bigint as tpo_missing, sum(e2)::bigint as gross_below_net, sum(e3)::bigint as date_wrong_year, sum(e4)::bigint as date_in_future from w group by 1""")
def validate_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes read from their text, put to the rules and routed; pallets stand for the quantity."""
    g, v = F.col("goods_id"), F.col("vehicle_id")
    docs = documents.extract_fields(_printed(spark, sf_dir)).withColumns({"quantity": F.col("pallets"), "c1": F.lit(0.4) + (g % 60) / 100.0, "c2": F.lit(0.4) + (v % 60) / 100.0})
    routed = documents.route_to_review(documents.findings(docs, "2000-07-01"), {"c1": True, "c2": False})
    has = lambda rule: F.count_if(F.exists("findings", lambda f: f["rule"] == rule)).alias(rule)
    return routed.groupBy("routing").agg(F.count("*").alias("n"), has("tpo_missing"), has("gross_below_net"), has("date_wrong_year"), has("date_in_future"))


@query("""
with d as (select l_orderkey as tpo, l_suppkey % 15 as k, l_shipdate as ts, l_partkey as id, l_linenumber as line from lineitem),
w as (select *, lag(ts) over (partition by tpo, k order by ts, id, line) as before from d)
select count(*) as rows, count(*) filter (where before is not null and ts - before <= interval 90 days) as duplicates from w""")
def duplicates_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("tpo_id", "k").orderBy("run_date", "goods_id", "line")
    rows = t.runs(spark, sf_dir).withColumn("k", F.col("vehicle_id") % 15).withColumn("before", F.lag("run_date").over(w))
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("before").isNotNull() & (F.datediff("run_date", "before") <= 90)).alias("duplicates"))


@query("""
with r(rule_id, toks, vetoes, updated_at, pos) as (values (1, ['ring'], ['blue'], timestamp '2024-01-01', 0), (2, ['small', 'ring'], ['none'], timestamp '2024-01-01', 1), (3, ['red'], ['none'], timestamp '2024-01-02', 2), (4, ['red'], ['ring', 'widget'], timestamp '2024-01-02', 3), (5, ['blue', 'ring'], ['none'], timestamp '2023-01-01', 4)),
h as (select p_partkey, rule_id, row_number() over (partition by p_partkey order by len(toks) desc, updated_at desc, pos desc) as k from part, r where len(list_filter(toks, lambda x: not list_contains(string_split(lower(p_name), ' '), x))) = 0 and len(list_filter(vetoes, lambda x: list_contains(string_split(lower(p_name), ' '), x))) = 0)
select p.p_partkey, h.rule_id from part p left join h on h.p_partkey = p.p_partkey and k = 1""")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, ["ring"], ["blue"], "2024-01-01", 0), (2, ["small", "ring"], None, "2024-01-01", 1), (3, ["red"], [], "2024-01-02", 2), (4, ["red"], ["ring", "widget"], "2024-01-02", 3), (5, ["blue", "ring"], None, "2023-01-01", 4)], "rule_id int, tokens array<string>, vetoes array<string>, updated_at string, pos int").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    return documents.matching_rule(table(spark, sf_dir, "part").select("p_partkey", "p_name"), rules, "p_partkey", "p_name").select("p_partkey", "rule_id")


@query("select p_partkey, p_name || ' / ' || p_type || ' - ' || p_brand as route, 3 as n_places, p_name as origin, p_brand as destination from part")
def route_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.concat("p_name", F.lit(" / "), "p_type", F.lit(" - "), "p_brand")
    legs = text.route_legs(F.col("route"))
    return table(spark, sf_dir, "part").withColumn("route", route).select("p_partkey", "route", F.size(legs).alias("n_places"), F.get(legs, F.lit(0)).alias("origin"), F.element_at(legs, -1).alias("destination"))


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    weight = planning.location_weight((k % 7).cast("double"), (k % 100 * 10).cast("double"), k % 3)
    return c.select(F.col("c_nationkey").alias("depot"), k.alias("location_id"), (44 + k * 37 % 1000 / 500).alias("lat"), (25 + k * 91 % 1000 / 500).alias("lon"), weight.alias("weight"))


@query()
def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.territories(_locations(spark, sf_dir), "depot", 4)


@query("""
with p as (select c_nationkey as g, 25 + c_custkey * 91 % 1000 / 500 as x, 44 + c_custkey * 37 % 1000 / 500 as y from customer), d as (select distinct * from p),
e as (select a.g, a.x, a.y, b.x as bx, b.y as by from d a join d b on a.g = b.g and (a.x <> b.x or a.y <> b.y) where not exists (
  select 1 from d r where r.g = a.g and ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) < -1e-12 or abs((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)) <= 1e-12 and ((r.x - a.x) * (r.x - b.x) + (r.y - a.y) * (r.y - b.y)) > 1e-12))),
c as (select distinct g, x, y from e), m as (select g, avg(x) as mx, avg(y) as my from c group by g)
select g as depot, round(x + (x - mx) / sqrt((x - mx) ** 2 + (y - my) ** 2) * 2 / 111, 6) as x, round(y + (y - my) / sqrt((x - mx) ** 2 + (y - my) ** 2) * 2 / 111, 6) as y from c join m using (g)""")
def territory_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the outline of each depot's locations, two kilometres out."""
    points = _locations(spark, sf_dir).select("depot", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return planning.hull(points, "depot", 2.0).select("depot", F.explode("ring").alias("c")).select("depot", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("""
with c as (select c_nationkey as depot, (c_custkey % 4)::int as cluster, (c_custkey % 100)::double as weight from customer), l as (select depot, cluster, cast(sum(weight::decimal(28,4)) as double) as load from c group by 1, 2), m as (select *, avg(load) over (partition by depot) as mean_load from l),
d as (select *, floor(abs(load - mean_load) / mean_load * 1000 + 0.5) / 10 as deviation_pct from m)
select depot, cluster, load, deviation_pct, max(deviation_pct) over (partition by depot) <= 15 as balanced from d""")
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    clusters = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("depot"), (k % 4).cast("int").alias("cluster"), (k % 100).cast("double").alias("weight"))
    return planning.balance_report(clusters, "depot").select("depot", "cluster", "load", "deviation_pct", "balanced")


@query()
def packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("goods_id")
    r = sequences.resequence(t.runs(spark, sf_dir), "tpo_id", [F.col(c) for c in _ORDER])
    items = r.select(F.col("tpo_id").alias("route_id"), (F.col("tpo_id") * 1000 + F.col("seq")).alias("item_id"), F.col("seq").alias("stop_seq"), (0.8 + g % 5 * 0.1).alias("l"), (0.6 + g % 4 * 0.1).alias("w"), (0.5 + g % 6 * 0.2).alias("h"))
    return planning.pack(items, "route_id", 6.0, 2.4, 2.4)


@query("""
with recursive v as (select s_nationkey as depot, s_suppkey as vehicle_id, s_suppkey * 7 % 1500 as preferred, row_number() over (partition by s_nationkey order by s_suppkey) as n from supplier where s_nationkey in (select c_nationkey from customer)),
d as (select c_nationkey as depot, list(c_custkey order by c_custkey) as drivers from customer group by 1),
w as (
  select depot, 0::bigint as n, null::bigint as vehicle_id, null::bigint as driver_id, []::bigint[] as taken, drivers from d
  union all
  select depot, n, vehicle_id, pick, case when pick is null then taken else list_append(taken, pick) end, drivers
  from (select w.depot, v.n, v.vehicle_id, w.taken, w.drivers, case when list_contains(w.drivers, v.preferred) and not list_contains(w.taken, v.preferred) then v.preferred else list_filter(w.drivers, lambda x: not list_contains(w.taken, x))[1] end as pick
        from w join v on v.depot = w.depot and v.n = w.n + 1))
select vehicle_id, driver_id from w where n > 0
union all select s_suppkey, null from supplier where s_nationkey not in (select c_nationkey from customer)""")
def driver_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("depot"), F.col("s_suppkey").alias("vehicle_id"), (F.col("s_suppkey") * 7 % 1500).alias("preferred"))
    drivers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("depot"), F.col("c_custkey").alias("driver_id"))
    return planning.assign_drivers(vehicles, drivers, "depot")


@query(f"""
with recursive {_SEQ_SQL}, p as (select route_id, seq, 44 + goods_id * 37 % 1000 / 500 as lat, 25 + place * 91 % 1000 / 500 as lon from stops),
s as (select route_id, list({{'seq': seq, 'lat': lat, 'lon': lon}} order by seq) as all_ from p group by 1),
w as (
  select route_id, 1::bigint as visit, all_[1] as now, list_filter(all_, lambda x: x.seq <> 1) as togo from s
  union all
  select route_id, visit + 1, {{'seq': best.seq, 'lat': best.lat, 'lon': best.lon}}, list_filter(togo, lambda x: x.seq <> best.seq)
  from (select route_id, visit, togo, list_sort(list_transform(togo, lambda x: {{'d': power(x.lat - w.now.lat, 2) + power(x.lon - w.now.lon, 2), 'seq': x.seq, 'lat': x.lat, 'lon': x.lon}}))[1] as best from w where len(togo) > 0) b)
select route_id, now.seq as stop_id, visit::int as visit from w""")
def route_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stops(spark, sf_dir)
    return planning.nearest_neighbour_order(s.select("route_id", F.col("seq").cast("long").alias("stop_id"), "seq", (44 + F.col("goods_id") * 37 % 1000 / 500).alias("lat"), (25 + F.col("place") * 91 % 1000 / 500).alias("lon")), "route_id")
