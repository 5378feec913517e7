"""Operating figures: the cockpit, punctuality, vehicle costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.numeric import exact_sum, half_up, percent

NOT_A_CALL = ("depot_start", "depot_end", "pauza", "repaus")


def on_time(planned: Column, actual: Column, grace_min: int = 15) -> Column:
    """Reached no later than ``grace_min`` after plan; what cannot be read counts as late."""
    return F.coalesce(actual <= planned + F.make_interval(mins=F.lit(grace_min)), F.lit(False))


def punctuality(stops: DataFrame, *keys: str) -> DataFrame:
    """Stops with both clocks, those on time, and the percentage; depot and break rows are left out."""
    sample = stops.where(~F.col("kind").isin(*NOT_A_CALL) & F.col("planned_at").isNotNull() & F.col("actual_at").isNotNull())
    counted = sample.groupBy(*keys).agg(F.count("*").alias("measured"), F.count_if(on_time(F.col("planned_at"), F.col("actual_at"))).alias("on_time"))
    return counted.withColumn("on_time_pct", percent(F.col("on_time"), F.col("measured")))


def empty_km(stops: DataFrame, *keys: str) -> DataFrame:
    """Kilometres driven without load and their share; null and negative distances are skipped."""
    good = stops.where("km >= 0")
    sums = good.groupBy(*keys).agg(exact_sum(F.col("km")).alias("total_km"), exact_sum(F.when(F.coalesce("load_kg", F.lit(0.0)) <= 0, F.col("km")).otherwise(0.0)).alias("empty_km"))
    return sums.withColumn("empty_pct", percent(F.col("empty_km"), F.col("total_km")))


def cost_rates(vehicles: DataFrame) -> DataFrame:
    """``per_km`` and ``per_hour`` of each vehicle: its own, else composed of parts or the company's.

    Parts are fuel price times consumption a kilometre, toll, depreciation and maintenance; those missing are left
    out, and no part at all gives null.
    """
    fuel = half_up(F.col("fuel_price") * F.col("consumption") / 100, 4)
    parts = F.filter(F.array(fuel, "toll_km", "depreciation_km", "maintenance_km"), lambda p: p.isNotNull())
    composed = F.when(F.size(parts) > 0, half_up(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p), 4))
    return vehicles.withColumns({"per_km": F.coalesce("cost_per_km", composed), "per_hour": F.coalesce("hourly_wage", "company_wage", "cost_per_hour")})


def activity_cost(runs: DataFrame) -> DataFrame:
    """Cost of ``km`` and ``minutes`` at the rates given, also a stop and a kilogram; null without any rate."""
    by_km, by_hour = half_up(F.col("per_km") * F.greatest(F.lit(0.0), "km"), 2), half_up(F.col("per_hour") * F.greatest(F.lit(0.0), F.col("minutes") / 60), 2)
    raw = F.coalesce(F.col("per_km") * F.greatest(F.lit(0.0), "km"), F.lit(0.0)) + F.coalesce(F.col("per_hour") * F.greatest(F.lit(0.0), F.col("minutes") / 60), F.lit(0.0))
    total = F.when(F.col("per_km").isNotNull() | F.col("per_hour").isNotNull(), half_up(raw, 2))
    out = runs.withColumns({"km_cost": by_km, "hour_cost": by_hour, "total_cost": total})
    return out.withColumns({"per_stop": F.when(F.col("stops") > 0, half_up(F.col("total_cost") / F.col("stops"), 2)), "per_kg": F.when(F.col("kg") > 0, half_up(F.col("total_cost") / F.col("kg"), 3))})


def plan_against_actual(routes: DataFrame) -> DataFrame:
    """Differences of kilometres and minutes, null unless both are known."""
    return routes.withColumns({"delta_km": half_up(F.col("actual_km") - F.col("planned_km"), 1), "delta_min": (F.col("actual_min") - F.col("planned_min"))})


def cockpit(routes: DataFrame, stops: DataFrame, orders: DataFrame, first: str, last: str) -> DataFrame:
    """One row of figures for the days ``first`` to ``last``: routes, distances, hours, cost, punctuality, orders.

    Routes that were cancelled do not count; a distance that is missing adds nothing. Stops are reduced to a row
    a route before they meet the routes, so that only one row a route is moved.
    """
    chosen = routes.where(F.col("route_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("status") != "anulata"))
    calls = stops.where(~F.col("kind").isin(*NOT_A_CALL) & F.col("planned_at").isNotNull() & F.col("actual_at").isNotNull())
    per_route = calls.groupBy("route_id").agg(F.count("*").alias("measured"), F.count_if(on_time(F.col("planned_at"), F.col("actual_at"))).alias("on_time"))
    sums = chosen.join(per_route, "route_id", "left").agg(
        F.count("*").alias("routes"),
        exact_sum(F.col("planned_km")).alias("pk"), exact_sum(F.col("actual_km")).alias("ak"),
        exact_sum(F.col("planned_min")).alias("pm"), exact_sum(F.col("actual_min")).alias("am"),
        exact_sum(F.col("cost")).alias("c"), F.count("cost").alias("costed"),
        F.coalesce(F.sum("measured"), F.lit(0)).alias("measured"), F.coalesce(F.sum("on_time"), F.lit(0)).alias("on_time"),
    )
    wanted = orders.where(F.col("requested_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    counts = wanted.agg(F.count_if(F.col("status") == "livrat").alias("orders_delivered"), F.count_if(~F.col("status").isin("livrat", "esuat", "anulat")).alias("orders_open"))
    return sums.crossJoin(counts).select(  # a row each
        "routes", half_up(F.col("pk"), 1).alias("planned_km"), half_up(F.col("ak"), 1).alias("actual_km"), half_up(F.col("ak") - F.col("pk"), 1).alias("delta_km"),
        half_up(F.col("pm") / 60, 1).alias("planned_hours"), half_up(F.col("am") / 60, 1).alias("actual_hours"),
        F.when(F.col("costed") > 0, half_up(F.col("c"), 2)).alias("cost_total"), F.when(F.col("costed") > 0, half_up(F.col("c") / F.col("costed"), 2)).alias("cost_per_route"),
        "measured", "on_time", percent(F.col("on_time"), F.col("measured")).alias("on_time_pct"), "orders_delivered", "orders_open",
    )
