"""Fleet and desk lists: plates and vehicles, coordinates, replays, summaries, loads by stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.numeric import exact_sum, half_up
from haulspark.functions.text import canonical_plate
from haulspark.operators.joins import keep_newest

CLOSED = ("finalizat", "esuat", "sarit")
NOT_VISITED = ("depot_start", "depot_end", "pauza", "repaus")


def first_plate(text: Column) -> Column:
    """The tractor's plate of ``tractor / trailer``, canonical; null for blanks."""
    return F.nullif(canonical_plate(F.coalesce(F.get(F.filter(F.split(text, "/"), lambda p: F.trim(p) != ""), F.lit(0)), F.lit(""))), F.lit(""))


def plate_status(rows: DataFrame, vehicles: DataFrame, plate: str = "plate") -> DataFrame:
    """``known, vehicle_id, mma_kg, verified`` of each row's first plate.

    Of vehicles (vehicle_id, plate, mma_kg, added_by_scan, created_at) that share a plate one with a weight is taken, then the oldest; a
    vehicle is verified if it has a weight and was not added by a scan.
    """
    one = keep_newest(vehicles.withColumn("_p", canonical_plate(F.col("plate"))).where("_p <> ''").select("_p", "vehicle_id", "mma_kg", "added_by_scan", "created_at"), ["_p"], [F.col("mma_kg").isNull(), F.col("created_at"), F.col("vehicle_id")])
    joined = rows.withColumn("_k", first_plate(F.col(plate))).join(one, F.col("_k") == F.col("_p"), "left")
    known = F.col("vehicle_id").isNotNull()
    return joined.select(*rows.columns, known.alias("known"), "vehicle_id", "mma_kg", (known & F.col("mma_kg").isNotNull() & ~F.coalesce("added_by_scan", F.lit(False))).alias("verified"))


def known_coordinates(rows: DataFrame, locations: DataFrame, cache: DataFrame, key: str = "address_key") -> DataFrame:
    """``lat, lon, coordinate_source`` by address key: a location's own, else a cached hit, else nulls; of several the smallest id."""
    own = keep_newest(locations.where("lat is not null and lon is not null").select(key, "id", F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1")), [key], [F.col("id")])
    hit = keep_newest(cache.where("status = 'hit' and lat is not null and lon is not null").select(key, "id", F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2")), [key], [F.col("id")])
    joined = rows.join(own.drop("id"), key, "left").join(hit.drop("id"), key, "left")
    source = F.when(F.col("_lat1").isNotNull(), "locations").when(F.col("_lat2").isNotNull(), "geocode_cache")
    return joined.select(*rows.columns, F.coalesce("_lat1", "_lat2").alias("lat"), F.coalesce("_lon1", "_lon2").alias("lon"), source.alias("coordinate_source"))


def replay_kpis(routes: DataFrame, stops: DataFrame, trails: DataFrame, key: str = "route_id") -> DataFrame:
    """``planned_km, actual_km, delta_km, stops_done, stops_total`` of routes (planned_m), their stops (kind, status) and trails (trail_m).

    Kilometres have one decimal; what is not known stays null. Depots, breaks and rests are no stops.
    """
    counted = ~F.col("kind").isin(*NOT_VISITED)
    per = stops.groupBy(key).agg(F.count_if(counted & F.col("status").isin(*CLOSED)).alias("stops_done"), F.count_if(counted).alias("stops_total"))
    km = lambda c: half_up(F.col(c) / 1000, 1)
    joined = routes.join(trails.select(key, "trail_m"), key, "left").join(per, key, "left").withColumns({"planned_km": km("planned_m"), "actual_km": km("trail_m")})
    return joined.select(key, "planned_km", "actual_km", half_up(F.col("actual_km") - F.col("planned_km"), 1).alias("delta_km"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stops_done", "stops_total")])


def place_tier(lat: Column, lon: Column, verified: Column, confidence: Column) -> Column:
    """Where a place stands in the review queue: missing, poor, review, good or verified."""
    return (
        F.when(lat.isNull() | lon.isNull(), "missing").when(F.coalesce(verified, F.lit(False)), "verified").when(confidence.isNull(), "review")
        .when(confidence >= 0.8, "good").when(confidence >= 0.45, "review").otherwise("poor")
    )


TIERS = ("missing", "poor", "review", "good", "verified")


def by_urgency(tier: Column, name: Column) -> list[Column]:
    """The queue's order: worst tier first, then by name."""
    return [F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier), F.lower(F.coalesce(name, F.lit("")))]


ROLES = ("admin", "dispatcher", "finance", "driver")


def by_role(active: Column, role: Column, name: Column) -> list[Column]:
    """The order of accounts: active ones first, then by role, unknown roles before known ones, then by name."""
    return [~F.coalesce(active, F.lit(False)), F.array_position(F.array(*[F.lit(r) for r in ROLES]), role), F.lower(F.coalesce(name, F.lit("")))]


def queue_summary(places: DataFrame, tier: str = "tier") -> DataFrame:
    """Places a tier, all, and those that a person still has to see."""
    return places.agg(*[F.count_if(F.col(tier) == t).alias(t) for t in TIERS], F.count("*").alias("total"), F.count_if(F.col(tier) != "verified").alias("todo"))


def inspection_status(expiry: Column, today: Column, horizon: int = 30) -> Column:
    """missing, expired, soon (within the horizon) or ok."""
    left = F.datediff(expiry, today)
    return F.when(left.isNull(), "missing").when(left < 0, "expired").when(left <= horizon, "soon").otherwise("ok")


def inspection_summary(vehicles: DataFrame, today: str, horizon: int = 30) -> DataFrame:
    """Active vehicles (expiry, is_active) a status, and all."""
    status = inspection_status(F.col("expiry"), F.lit(today).cast("date"), horizon)
    rows = vehicles.where(F.coalesce("is_active", F.lit(True))).select(status.alias("s"))
    return rows.agg(*[F.count_if(F.col("s") == s).alias(s) for s in ("missing", "expired", "soon", "ok")], F.count("*").alias("total"))


def compare_scenarios(scenarios: DataFrame, kpis: Sequence[str]) -> DataFrame:
    """Scenarios (scenario_id, name, kpis as JSON) with each of ``kpis`` as a column, null where it lacks."""
    return scenarios.select("scenario_id", "name", *[F.get_json_object("kpis", f"$.{k}").try_cast("double").alias(k) for k in kpis])


def lookup_tally(results: DataFrame) -> DataFrame:
    """Searches (action, cached, error) counted: all, accepted, for review, rejected, from the cache, failed."""
    action = F.col("action")
    return results.agg(
        F.count("*").alias("total"), F.count_if(action == "accept").alias("accepted"), F.count_if(action == "review").alias("review"), F.count_if(~F.coalesce(action, F.lit("")).isin("accept", "review")).alias("rejected"),
        F.count_if(F.coalesce("cached", F.lit(False))).alias("cached"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def unplanned(orders: DataFrame, day: str | None = None, text: str = "") -> DataFrame:
    """Orders (order_number, status, requested_date, client_name, goods) that wait for a plan, of a day if one is given, that hold ``text``, by number."""
    rows = orders.where("status = 'nou'")
    if day:
        rows = rows.where(F.col("requested_date").cast("date") == F.lit(day).cast("date"))
    needle = text.strip().lower()
    if needle:
        hit = F.lit(False)
        for c in ("order_number", "client_name", "goods"):
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle))
        rows = rows.where(hit)
    return rows.orderBy("order_number")


def load_by_stop(items: DataFrame, plan: str = "plan_id") -> DataFrame:
    """``item_count, weight_kg, volume_m3`` of each stop of a plan, the last to be unloaded first in ``load_order``."""
    sums = items.groupBy(plan, F.coalesce("stop_seq", F.lit(0)).alias("stop_seq")).agg(
        F.count("*").alias("item_count"), half_up(exact_sum(F.coalesce("weight_kg", F.lit(0.0))), 1).alias("weight_kg"),
        half_up(exact_sum(F.coalesce(F.col("l") * F.col("w") * F.col("h"), F.lit(0.0)), 6), 3).alias("volume_m3"),
    )
    return sums.withColumn("load_order", F.row_number().over(Window.partitionBy(plan).orderBy(F.desc("stop_seq"))))


def article_rows(items: DataFrame, plan: str = "plan_id") -> DataFrame:
    """One row a distinct article of a stop: ``sku, quantity, weight_kg``; items without a name are pallets."""
    return items.groupBy(plan, "stop_seq", F.coalesce("sku", F.lit("palet")).alias("sku")).agg(F.count("*").alias("quantity"), half_up(exact_sum(F.coalesce("weight_kg", F.lit(0.0))), 1).alias("weight_kg"))


#: Metres of a euro pallet's floor.
EURO_L, EURO_W = 1.2, 0.8


def load_statistics(placed: DataFrame, vehicles: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Volume, weight and pallet places of each plan against its vehicle (hold_l, hold_w, hold_h, payload_kg).

    Boxes (x, y, z, l, w, h, weight_kg) that were not placed have a null x and count for nothing; only those on the floor take
    pallet places. Places that a hold offers are whole pallets, along, across, or rows of one kind and then of the other, whichever are most.
    """
    there = placed.where("x is not null").groupBy(plan).agg(
        F.count("*").alias("placed_count"), half_up(exact_sum(F.col("l") * F.col("w") * F.col("h"), 6), 2).alias("used_m3"), half_up(exact_sum(F.col("weight_kg")), 1).alias("used_kg"),
        half_up(exact_sum(F.when(F.col("z") <= 0.001, F.col("l") * F.col("w")).otherwise(0.0), 6) / (EURO_L * EURO_W), 1).alias("pallets_used"),
    )
    fits = lambda room, size: F.floor(room / size + 1e-9)
    whole = lambda a, b: fits(F.col("hold_l"), a) * fits(F.col("hold_w"), b)
    mixed = lambda a, b: whole(a, b) + fits(F.col("hold_l") - fits(F.col("hold_l"), a) * a, b) * fits(F.col("hold_w"), a)
    joined = vehicles.join(there, plan, "left").withColumns({
        "capacity_m3": half_up(F.col("hold_l") * F.col("hold_w") * F.col("hold_h"), 2), "pallets": F.greatest(mixed(EURO_L, EURO_W), mixed(EURO_W, EURO_L)),
        **{c: F.coalesce(c, F.lit(0)) for c in ("placed_count", "used_m3", "used_kg", "pallets_used")},
    })
    share = lambda a, b: F.when(F.col(b) > 0, half_up(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return joined.select(
        plan, "placed_count", "used_m3", "capacity_m3", share("used_m3", "capacity_m3").alias("volume_share"), "used_kg", share("used_kg", "payload_kg").alias("weight_share"),
        "pallets_used", F.col("pallets").cast("long").alias("pallets"), share("pallets_used", "pallets").alias("pallet_share"),
    )


def axle_loads(placed: DataFrame, vehicles: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Kilograms that a plan's boxes put on the front and rear axle of its vehicle (front_x, rear_x: metres from the front wall).

    The load acts at its boxes' centres; the two axles carry it by the lever. Boxes that were not placed do not count.
    """
    at = placed.where("x is not null").groupBy(plan).agg(exact_sum(F.col("weight_kg")).alias("kg"), exact_sum(F.col("weight_kg") * (F.col("x") + F.col("l") / 2)).alias("moment"))
    joined = vehicles.join(at, plan, "left")
    rear = F.coalesce((F.col("moment") - F.col("kg") * F.col("front_x")) / (F.col("rear_x") - F.col("front_x")), F.lit(0.0))
    return joined.select(plan, half_up(F.coalesce("kg", F.lit(0.0)) - rear, 1).alias("front_kg"), half_up(rear, 1).alias("rear_kg"))


def collisions(placed: DataFrame, plan: str = "plan_id", step: float = 2.0) -> DataFrame:
    """``plan, a, b``: pairs of boxes of a plan that overlap. Boxes meet only in the cells of ``step`` metres of the hold that both touch."""
    cells = lambda lo, size: F.explode(F.sequence(F.floor(F.col(lo) / step).cast("int"), F.floor((F.col(lo) + F.col(size) - 1e-6) / step).cast("int")))
    boxes = placed.where("x is not null").select(plan, "item_id", "x", "y", "z", "l", "w", "h").withColumn("cell", cells("x", "l"))
    a, b = (boxes.select(plan, "cell", *[F.col(c).alias(f"{s}_{c}") for c in ("item_id", "x", "y", "z", "l", "w", "h")]) for s in "ab")
    over = lambda c, n: (F.col(f"a_{c}") < F.col(f"b_{c}") + F.col(f"b_{n}") - 1e-9) & (F.col(f"b_{c}") < F.col(f"a_{c}") + F.col(f"a_{n}") - 1e-9)
    met = a.join(b, [plan, "cell"]).where((F.col("a_item_id") < F.col("b_item_id")) & over("x", "l") & over("y", "w") & over("z", "h"))
    return met.select(plan, F.col("a_item_id").alias("a"), F.col("b_item_id").alias("b")).distinct()
