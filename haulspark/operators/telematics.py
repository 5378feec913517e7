"""Vehicle positions: validation, exceptions, idle spells, latest place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.geo import haversine_m
from haulspark.functions.text import clock_minutes
from haulspark.functions.timez import ZONE

#: km/h above which a sample is speeding, and critical.
SPEED, SPEED_CRITICAL = 90.0, 110.0
#: Minutes past the plan from which a stop is late, and critically so, and before its window that are too early.
LATE, LATE_CRITICAL, EARLY = 15, 45, 30
#: Metres from the nearest stop within which a vehicle is there, beyond which it is off route, and critically so.
AT_STOP, OFF_ROUTE, OFF_ROUTE_CRITICAL = 150.0, 800.0, 2400.0
#: km/h up to which a vehicle stands, minutes of standing that count, and that are critical.
IDLE_SPEED, IDLE, IDLE_CRITICAL = 5.0, 20, 40


def rejection(now: Column) -> Column:
    """Why a sample (vehicle_id, lat, lon, ts) cannot be used; null if it can."""
    return (
        F.when(F.col("vehicle_id").isNull(), "no_vehicle")
        .when(F.col("lat").isNull() | F.col("lon").isNull() | ~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180), "bad_coordinates")
        .when(F.col("ts").isNull(), "no_time")
        .when(F.col("ts") > now + F.expr("interval 24 hours"), "in_future")
    )


def nearest_stop(positions: DataFrame, stops: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Each position with the nearest stop of its vehicle: ``stop_id, stop_m``; a vehicle's stops travel as one array."""
    arrays = stops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stop_id", F.col("lat").alias("slat"), F.col("lon").alias("slon")))).alias("_stops"))
    joined = positions.join(arrays, key, "left")
    metres = F.transform("_stops", lambda s: F.struct(haversine_m(F.col("lat"), F.col("lon"), s["slat"], s["slon"]).alias("m"), s["stop_id"].alias("id")))
    best = F.array_min(metres)
    return joined.withColumn("_best", best).select(*positions.columns, F.col("_best.id").alias("stop_id"), F.col("_best.m").alias("stop_m"))


def idle_minutes(positions: DataFrame, key: str = "vehicle_id", ts: str = "ts") -> DataFrame:
    """Minutes a vehicle has stood away from any stop, up to each sample; any other sample resets the clock."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    idle = F.coalesce((F.col("speed") <= IDLE_SPEED) & (F.col("stop_m").isNull() | (F.col("stop_m") > AT_STOP)), F.lit(False))
    marked = positions.withColumn("_idle", idle).withColumn("_spell", F.sum((~idle).cast("int")).over(w))
    start = F.min(F.when(F.col("_idle"), F.col(ts))).over(Window.partitionBy(key, "_spell"))
    minutes = F.when(F.col("_idle"), (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60_000_000)
    return marked.withColumn("idle_min", minutes).drop("_idle", "_spell")


def next_open_stops(stops: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Each vehicle's next stop that is owed: ``route_id, next_stop_id, next_lat, next_lon, planned_at, window_start``, the first by ``seq`` that is not closed and no pause."""
    owed = stops.where(F.col("kind").isin("livrare", "ridicare", "schimb", "depot_end") & ~F.coalesce(F.col("status"), F.lit("")).isin("finalizat", "esuat", "sarit"))
    first = owed.groupBy(key).agg(F.min(F.struct("seq", "stop_id", "route_id", "lat", "lon", "planned_at", "window_start")).alias("s"))
    return first.select(key, "s.route_id", F.col("s.stop_id").alias("next_stop_id"), F.col("s.lat").alias("next_lat"), F.col("s.lon").alias("next_lon"), "s.planned_at", "s.window_start")


def exceptions_of(positions: DataFrame, zone: str = ZONE) -> DataFrame:
    """``event_id, vehicle_id, route_id, stop_id, ts, type, severity``, none or more a sample.

    Samples have speed, lat, lon, stop_m (metres to the nearest stop of the route), idle_min and the columns of
    ``next_open_stops``, null where nothing is owed. Speeding; late for the next stop and not there; there too early for its window; off the route while something is owed;
    standing far from the plan, which away from every stop is an unplanned stop and else mere standing.
    """
    c = F.col
    one = lambda when, kind, severity, stop: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("type"), severity.alias("severity"), stop.alias("stop_id")))
    level = lambda critical: F.when(critical, "critical").otherwise("warning")
    none = F.lit(None).cast("long")
    owed = c("next_stop_id").isNotNull()
    there = F.coalesce(haversine_m(c("lat"), c("lon"), c("next_lat"), c("next_lon")) <= AT_STOP, F.lit(False))
    behind = (F.unix_micros(c("ts")) - F.unix_micros(c("planned_at"))) / 60_000_000
    local = F.from_utc_timestamp(c("ts"), zone)
    opens = clock_minutes(F.regexp_extract(c("window_start"), r"^\d{1,2}:\d{2}", 0))
    far, idle = c("stop_m") > OFF_ROUTE, F.floor(c("idle_min") + 0.5)
    found = F.array(
        one(c("speed") > SPEED, "viteza", level(c("speed") > SPEED_CRITICAL), none),
        one(owed & (behind > LATE) & ~there, "intarziere", level(F.floor(behind + 0.5) >= LATE_CRITICAL), c("next_stop_id")),
        one(owed & there & c("planned_at").isNotNull() & (F.hour(local) * 60 + F.minute(local) + EARLY < opens), "prea_devreme", F.lit("info"), c("next_stop_id")),
        one(far & owed, "abatere_traseu", level(c("stop_m") > OFF_ROUTE_CRITICAL), c("next_stop_id")),
        one((c("speed") <= IDLE_SPEED) & far & (idle >= IDLE), "oprire_neplanificata", level(idle >= IDLE_CRITICAL), none),
        one((c("speed") <= IDLE_SPEED) & c("stop_m").isNull() & (idle >= IDLE), "stationare", level(idle >= IDLE_CRITICAL), none),
    )
    out = positions.select("event_id", "vehicle_id", "route_id", "ts", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e"))
    return out.select("event_id", "vehicle_id", "route_id", "e.stop_id", "ts", "e.type", "e.severity")


def new_exceptions(found: DataFrame, open_: DataFrame) -> DataFrame:
    """First of each (type, vehicle, route, stop) that is not open already; nulls are equal to each other."""
    key = ["type", "vehicle_id", "route_id", "stop_id"]
    first = found.groupBy(*key).agg(F.min(F.struct("ts", "event_id", "severity")).alias("e"))
    o = open_.select(*[F.col(k).alias(f"o_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    return first.join(o, same, "left_anti").select(*key, "e.*")


def latest_positions(positions: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """The newest sample of each vehicle by event time, then id; maxima are partial before the shuffle."""
    rest = [c for c in positions.columns if c not in (key, "ts", "event_id")]
    return positions.groupBy(key).agg(F.max(F.struct("ts", "event_id", *rest)).alias("p")).select(key, "p.*")
