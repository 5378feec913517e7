"""Plans for a solver and back: stops edited by hand, problems built, solutions read, scenarios put in force."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.numeric import half_up
from haulspark.functions.text import clock_minutes

DEPOTS = {"depot_start": 0, "depot_end": 2}


def _pinned(rows: DataFrame, route: str, place: Column, tie: str) -> DataFrame:
    """Rows numbered anew by ``place``, depots of departure always first and of return last."""
    pin = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in DEPOTS.items() for x in p]), F.col("kind")), F.lit(1))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(route).orderBy(pin, place, tie)))


def insert_stops(stops: DataFrame, new: DataFrame, route: str = "route_id") -> DataFrame:
    """``stops`` (route, stop_id, seq from 1, kind) with one of ``new`` (route, stop_id, kind, at from 0) put in each route before the stop at that place.

    A place beyond the end is the end, one below 0 the beginning. Rows are numbered anew.
    """
    old = stops.select(route, "stop_id", "kind", F.row_number().over(Window.partitionBy(route).orderBy("seq", "stop_id")).alias("_p").cast("double"))
    added = new.select(route, "stop_id", "kind", (F.greatest(F.col("at"), F.lit(0)) + 0.5).alias("_p"))
    return _pinned(old.unionByName(added), route, F.col("_p"), "stop_id").select(route, "stop_id", "kind", "seq")


def remove_stops(stops: DataFrame, gone: DataFrame, route: str = "route_id") -> DataFrame:
    """``stops`` without those of ``gone`` (route, stop_id), numbered anew."""
    return _pinned(stops.join(gone.select(route, "stop_id"), [route, "stop_id"], "left_anti"), route, F.col("seq"), "stop_id").select(route, "stop_id", "kind", "seq")


def move_stops(stops: DataFrame, moves: DataFrame, route: str = "route_id") -> DataFrame:
    """``stops`` with one stop a route put at another place (moves: route, stop_id, to from 0), numbered anew; unknown stops move nothing."""
    placed = stops.withColumn("_i", F.row_number().over(Window.partitionBy(route).orderBy("seq", "stop_id")) - 1)
    known = placed.join(moves.select(route, "stop_id", "to"), [route, "stop_id"]).select(route, F.col("stop_id").alias("_m"), F.col("_i").alias("_from"), "to")
    joined = placed.join(known, route, "left")
    left = F.col("_i") - F.when(F.col("_i") > F.col("_from"), 1).otherwise(0)  # places once the stop is taken out
    place = F.when(F.col("stop_id") == F.col("_m"), F.greatest(F.col("to"), F.lit(0)) - 0.5).otherwise(F.coalesce(left, F.col("_i")).cast("double"))
    return _pinned(joined.withColumn("_p", place), route, F.col("_p"), "stop_id").select(route, "stop_id", "kind", "seq")


def apply_order(stops: DataFrame, order: DataFrame, route: str = "route_id") -> DataFrame:
    """``stops`` in the order that ``order`` (route, ids) names, those it forgot after them in their old order; unknown ids name nothing."""
    joined = stops.join(order.select(route, "ids"), route, "left").withColumn("_n", F.array_position("ids", F.col("stop_id")))
    place = F.when(F.col("_n") > 0, F.col("_n").cast("double")).otherwise(1e9 + F.col("seq"))
    return _pinned(joined.withColumn("_p", place), route, F.col("_p"), "stop_id").select(route, "stop_id", "kind", "seq")


# What an order takes and a vehicle offers, and the whole units it is counted in.
DIMENSIONS = (("weight_kg", "capacity_kg", 1), ("volume_m3", "capacity_m3", 100), ("pallets", "capacity_pallets", 1))
SHIFT, SERVICE_MIN, COST_UNITS = ("06:00", "22:00"), 15, 100
UNREACHABLE_S, UNREACHABLE_M = 1_000_000, 10_000_000


def demand() -> Column:
    """What an order takes, as whole numbers in the fixed order; nothing is below 0."""
    return F.array(*[F.greatest(F.lit(0), half_up(F.coalesce(F.col(d), F.lit(0.0)) * scale)).cast("long") for d, _, scale in DIMENSIONS])


def capacity(totals: Column) -> Column:
    """What a vehicle holds; a dimension that nobody entered limits nothing and holds all there is."""
    return F.array(*[F.when(F.col(c).isNull(), F.get(totals, F.lit(i))).otherwise(F.greatest(F.lit(0), half_up(F.col(c) * scale)).cast("long")) for i, (_, c, scale) in enumerate(DIMENSIONS)])


def time_window(opens: Column, closes: Column) -> Column:
    """Seconds of the day from which to which a stop may be reached, null if neither is known; an end at or before the beginning is the day's."""
    a, b = clock_minutes(opens) * 60, clock_minutes(closes) * 60
    start = F.coalesce(a, F.lit(0))
    return F.when(a.isNotNull() | b.isNotNull(), F.array(start, F.when(b.isNull() | (b <= start), 86_400).otherwise(b)))


def solver_jobs(orders: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs of the orders a solver can serve, and the others with their reason.

    Orders (order_id, lat, lon, type, weight_kg, volume_m3, pallets, service_min, window_start, window_end) without a place are dropped as
    ``fara_coordonate``, those that ``reachable`` (order_id) does not name as ``fara_drum``. A pick-up only collects, a
    delivery only delivers, an exchange does both.
    """
    told = orders.join(reachable.select("order_id").distinct().withColumn("_road", F.lit(True)), "order_id", "left")
    reason = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "fara_coordonate").when(F.col("_road").isNull(), "fara_drum")
    told = told.withColumn("reason", reason)
    none = F.lit(None).cast("array<bigint>")
    jobs = told.where("reason is null").select(
        "order_id", F.greatest(F.lit(0), half_up(F.coalesce("service_min", F.lit(float(SERVICE_MIN))) * 60)).cast("long").alias("service"),
        F.when(F.col("type") != "ridicare", demand()).otherwise(none).alias("delivery"), F.when(F.col("type") != "livrare", demand()).otherwise(none).alias("pickup"),
        time_window(F.col("window_start"), F.col("window_end")).alias("time_window"),
    )
    return jobs, told.where("reason is not null").select("order_id", "reason")


def solver_vehicles(vehicles: DataFrame, jobs: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``vehicle_id, capacity, time_window, per_hour, per_km`` of vehicles that have a depot; costs are in hundredths, unknown ones the fleet's mean."""
    each = F.coalesce("delivery", "pickup")
    totals = jobs.agg(F.array(*[F.coalesce(F.sum(F.get(each, F.lit(i))), F.lit(0)) for i in range(len(DIMENSIONS))]).alias("_totals"))
    means = (fallback or vehicles).agg(F.avg("cost_per_hour").alias("_h"), F.avg("cost_per_km").alias("_k"))
    rows = vehicles.where("depot_lat is not null and depot_lon is not null").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(means))  # one row each
    cost = lambda c, mean: F.when(F.col("_h").isNotNull() | F.col("_k").isNotNull(), F.greatest(F.lit(0.0), half_up(F.coalesce(F.col(c), F.col(mean), F.lit(0.0)) * COST_UNITS)).cast("long"))
    return rows.select(
        "vehicle_id", capacity(F.col("_totals")).alias("capacity"), time_window(F.coalesce("shift_start", F.lit(SHIFT[0])), F.coalesce("shift_end", F.lit(SHIFT[1]))).alias("time_window"),
        cost("cost_per_hour", "_h").alias("per_hour"), cost("cost_per_km", "_k").alias("per_km"),
    )


def encoded_matrix(pairs: DataFrame) -> DataFrame:
    """Minutes and kilometres of pairs as whole seconds and metres; unknown ones are so far that none is chosen."""
    return pairs.select("from_key", "to_key", F.when(F.col("minutes").isNull(), UNREACHABLE_S).otherwise(F.greatest(F.lit(0.0), half_up(F.col("minutes") * 60))).cast("long").alias("seconds"), F.when(F.col("km").isNull(), UNREACHABLE_M).otherwise(F.greatest(F.lit(0.0), half_up(F.col("km") * 1000))).cast("long").alias("metres"))


def stranded(matrix: DataFrame) -> DataFrame:
    """``key`` of places that no other can reach and that reach no other."""
    ends = matrix.where("from_key <> to_key").select(F.explode(F.array("from_key", "to_key")).alias("key"), (F.col("seconds") < UNREACHABLE_S).alias("ok"))
    return ends.groupBy("key").agg(F.max("ok").alias("ok")).where("not ok").select("key")


def solution_stops(steps: DataFrame, orders: DataFrame, route: str = "route_id") -> DataFrame:
    """Stops of a solver's steps (route, n, type, order_id, arrival, service, waiting, distance, duration), running totals taken apart.

    Seconds become minutes and metres kilometres. Steps are depots, breaks or jobs; a job is a pick-up if its order (order_id, type) is one.
    """
    w = Window.partitionBy(route).orderBy("n")
    told = steps.join(orders.select("order_id", F.col("type").alias("_t")), "order_id", "left")
    kind = F.when(F.col("type") == "start", "depot_start").when(F.col("type") == "end", "depot_end").when(F.col("type") == "break", "pauza").when(F.col("_t") == "ridicare", "ridicare").otherwise("livrare")
    upto = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0))
    told = told.withColumns({"_d": upto("distance"), "_s": upto("duration")})
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    minutes = lambda c: half_up(F.coalesce(c, F.lit(0)) / 60).cast("long")
    return told.select(
        route, F.row_number().over(w).alias("seq"), kind.alias("kind"), F.when(F.col("type") == "job", F.col("order_id")).alias("order_id"), F.col("arrival").alias("arrival_sec"),
        (F.col("arrival") + F.coalesce("service", F.lit(0))).alias("departure_sec"), minutes(F.col("service")).alias("service_min"), minutes(F.col("waiting")).alias("waiting_min"),
        (step("_d") / 1000).alias("leg_km"), minutes(step("_s")).alias("leg_min"),
    )


def scenario_kpis(stops: DataFrame, unassigned: DataFrame, scenario: str = "scenario_id", route: str = "route_id") -> DataFrame:
    """``routes, distance_km, duration_min, service_min, waiting_min, unassigned`` of each scenario."""
    sums = stops.groupBy(scenario).agg(
        F.count_distinct(route).alias("routes"), half_up(F.sum(F.col("leg_km").cast("decimal(28,3)")).cast("double"), 3).alias("distance_km"),
        F.sum("leg_min").alias("duration_min"), F.sum("service_min").alias("service_min"), F.sum("waiting_min").alias("waiting_min"),
    )
    left = unassigned.groupBy(scenario).agg(F.count("*").alias("unassigned"))
    return sums.join(left, scenario, "left").withColumn("unassigned", F.coalesce("unassigned", F.lit(0)))


#: States in which a route is on the road and stays as it is.
LOCKED = ("lansata", "in_executie", "finalizata")


def promote(routes: DataFrame, scenarios: DataFrame, chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """``routes`` (route_id, route_date, status, scenario_id) after scenarios (scenario_id, route_date, status) are put in force.

    Of ``chosen`` (scenario_id), one a day, those that were solved replace the drafts of their day by their own routes of ``planned`` (scenario_id, route_id);
    a day with a route on the road stays as it is.
    """
    busy = routes.where(F.col("status").isin(*LOCKED)).select("route_date").distinct()
    solved = scenarios.where(F.col("status").isin("rulat", "promovat")).join(chosen.select("scenario_id"), "scenario_id", "left_semi").join(busy, "route_date", "left_anti").select("scenario_id", "route_date")
    kept = routes.join(solved.select("route_date").distinct(), "route_date", "left_anti").select("route_id", "route_date", "status", "scenario_id")
    new = planned.join(solved, "scenario_id").select("route_id", "route_date", F.lit("planificata").alias("status"), "scenario_id")
    return kept.unionByName(new)


def shift_after_delay(stops: DataFrame, delays: DataFrame, route: str = "route_id") -> DataFrame:
    """``stops`` (route, seq, status, planned_at, eta_delay_min) after delays (route, from_seq, delay_min): open ones from there on come later."""
    joined = stops.join(delays.where("delay_min > 0").select(route, "from_seq", "delay_min"), route, "left")
    on = F.coalesce((F.col("seq") >= F.col("from_seq")) & ~F.coalesce(F.col("status"), F.lit("")).isin("finalizat", "esuat", "sarit"), F.lit(False))
    return joined.withColumns({
        "planned_at": F.when(on, F.col("planned_at") + F.make_dt_interval(mins=F.col("delay_min").cast("int"))).otherwise(F.col("planned_at")),
        "eta_delay_min": F.coalesce("eta_delay_min", F.lit(0)) + F.when(on, F.col("delay_min")).otherwise(0), "shifted": on,
    }).select(*stops.columns, "shifted")


def delay_mails(stops: DataFrame, delays: DataFrame, route: str = "route_id") -> DataFrame:
    """One mail a client and route: the first open stop from the delay on that has the address; ``eta`` is its new time."""
    moved = shift_after_delay(stops, delays, route).where(F.col("shifted") & (F.coalesce(F.trim("client_email"), F.lit("")) != ""))
    first = moved.groupBy(route, F.lower(F.trim("client_email")).alias("mail_to")).agg(F.min(F.struct("seq", "stop_id", F.col("planned_at").alias("eta"))).alias("s"))
    return first.join(delays.select(route, "delay_min"), route).select(route, "mail_to", "s.seq", "s.stop_id", "s.eta", "delay_min")


def declaration(routes: DataFrame, stops: DataFrame, company: Mapping[str, str], route: str = "route_id") -> DataFrame:
    """The transport declaration of each route, and ``missing``, the required fields it lacks."""
    ends = stops.groupBy(route).agg(F.min(F.struct("seq", "name")).alias("a"), F.max(F.struct("seq", "name")).alias("b"), F.nullif(F.count_if(F.col("kind") == "livrare"), F.lit(0)).alias("unloading_places"))
    out = routes.join(ends, route, "left").select(
        route, F.lit(company.get("fiscal_code")).alias("declarant_code"), F.lit(company.get("name")).alias("declarant_name"), F.lit("AIC").alias("operation"), F.date_format("route_date", "yyyy-MM-dd").alias("transport_date"),
        F.col("plate").alias("vehicle"), F.coalesce("code", F.col(route).cast("string")).alias("reference"), F.col("a.name").alias("place_start"), F.col("b.name").alias("place_end"), "unloading_places",
    )
    needed = ("declarant_code", "transport_date", "vehicle", "place_start", "place_end", "unloading_places")
    return out.withColumn("missing", F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]), lambda x: x.isNotNull()))


def invoice_errors(number: Column, issued: Column, client: Column, tax_id: Column, total: Column) -> Column:
    """What keeps an invoice from being sent, in order."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    pairs = (("number_missing", blank(number)), ("date_missing", issued.isNull()), ("client_missing", blank(client)), ("tax_id_missing", blank(tax_id)), ("total_invalid", total.isNull() | (total < 0)))
    return F.filter(F.array(*[F.when(when, F.lit(name)) for name, when in pairs]), lambda x: x.isNotNull())
