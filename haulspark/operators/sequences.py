"""Operators over ordered rows of a route: windows where a row needs its neighbours, pandas where state is sequential."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.geo import haversine_m
from haulspark.functions.numeric import exact_sum
from haulspark.functions.text import clock_minutes
from haulspark.operators.grouped import Rows, walk_groups


def resequence(rows: DataFrame, group: str, order: Sequence[Column], name: str = "seq") -> DataFrame:
    """Number the rows of each group 1, 2, ... in ``order``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def legs(stops: DataFrame, group: str = "route_id", order: str = "seq", place: str = "place") -> DataFrame:
    """Each stop with the place before it; null at the first."""
    w = Window.partitionBy(group).orderBy(order)
    return stops.withColumn("from_place", F.lag(place).over(w))


def schedule(stops: DataFrame, group: str = "route_id", order: str = "seq", leg: str = "leg_min", service: str = "service_min", start: int = 0, default_service: int = 15) -> DataFrame:
    """Clocks in minutes: arrival is the way there, departure adds the service; the first stop is reached at the start.

    A leg of unknown length stops the clock for that stop and all later ones.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    way = F.when(first, F.lit(0.0)).otherwise(F.col(leg).cast("double"))
    stay = F.coalesce(F.col(service).cast("double"), F.lit(float(default_service)))
    out = stops.withColumn("_way", way).withColumn("_stay", stay)
    unknown = F.max(F.col("_way").isNull()).over(w)
    departure = F.sum(F.coalesce("_way", F.lit(0.0)) + F.col("_stay")).over(w) + start
    out = out.withColumn("departure", F.when(~unknown, departure))
    return out.withColumn("arrival", F.col("departure") - F.col("_stay")).drop("_way", "_stay")


def window_violations(stops: DataFrame, arrival: str = "arrival", opens: str = "opens", closes: str = "closes") -> DataFrame:
    """Minutes late after the window closes and early before it opens; null where nothing is known, 0 within."""
    a = F.col(arrival)
    return stops.withColumns(
        {
            "late_min": F.when(a.isNotNull() & F.col(closes).isNotNull(), F.greatest(a - F.col(closes), F.lit(0.0))),
            "early_min": F.when(a.isNotNull() & F.col(opens).isNotNull(), F.greatest(F.col(opens) - a, F.lit(0.0))),
        }
    )


def run_lengths(rows: DataFrame, order: Sequence[Column], key: str, group: str) -> DataFrame:
    """Spans of equal, non-empty neighbouring keys longer than one row: ``group, key, first_row, last_row, n_rows``."""
    w = Window.partitionBy(group).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w)).withColumn("_new", (~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"))
    island = numbered.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "").groupBy(group, "_island", key).agg(F.min("_n").alias("first_row"), F.max("_n").alias("last_row"), F.count("*").alias("n_rows"))
    return spans.where("n_rows > 1").select(group, key, "first_row", "last_row", "n_rows")


def differences(rows: DataFrame, group: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Running totals back to what each row adds."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumns({f"{c}_step": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0)) for c in columns})


def shift_clocks(stops: DataFrame, from_seq: Column, delay: Column, open_: Column, clock: str = "planned") -> DataFrame:
    """Planned clocks of the open stops from ``from_seq`` on, ``delay`` minutes later."""
    return stops.withColumn("eta", F.when((F.col("seq") >= from_seq) & open_, F.col(clock) + delay).otherwise(F.col(clock)))


def overlaps(dim: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """Rows that are still open when the next of their key begins."""
    w = Window.partitionBy(*keys).orderBy("valid_from", position)
    following = dim.withColumn("next_from", F.lead("valid_from").over(w))
    return following.where("next_from is not null and (valid_to is null or valid_to >= next_from)")


def trail_metres(points: DataFrame, group: str, order: Sequence[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Length of each group's trail, in whole metres."""
    w = Window.partitionBy(group).orderBy(*order)
    step = points.withColumn("_m", haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)))
    return step.groupBy(group).agg(F.count("*").alias("n_points"), F.floor(F.coalesce(F.sum(F.col("_m").cast("decimal(20,6)")).cast("double"), F.lit(0.0)) + 0.5).cast("long").alias("trail_m"))


def thin_trail(points: DataFrame, group: str, order: Sequence[str], least_m: float = 40.0, most: int = 1500) -> DataFrame:
    """Points at least ``least_m`` from the last kept one, first and last always; then every n-th beyond ``most``.

    What is kept depends on what was kept before, so each group is walked in order.
    """
    names = points.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)

    def walk(_: object, rows: Rows) -> list[tuple]:
        lat, lon = np.radians(rows["lat"]), np.radians(rows["lon"])
        kept = [0]
        for i in range(1, len(lat)):
            k = kept[-1]
            h = np.sin((lat[i] - lat[k]) / 2) ** 2 + np.cos(lat[k]) * np.cos(lat[i]) * np.sin((lon[i] - lon[k]) / 2) ** 2
            if 2 * 6_371_000 * np.arcsin(min(1.0, np.sqrt(h))) >= least_m:
                kept.append(i)
        if kept[-1] != len(lat) - 1:
            kept.append(len(lat) - 1)
        if len(kept) > most:
            step = -(-len(kept) // most)
            kept = kept[::step] + ([kept[-1]] if (len(kept) - 1) % step else [])
        return [tuple(rows[c][i] for c in names) for i in kept]

    return walk_groups(points, group, order, walk, schema)


#: Minutes of driving before a break, of a break, of driving a day, and of a night's rest.
DRIVE_LIMIT, BREAK, DAY_LIMIT, REST = 270.0, 45.0, 540.0, 660.0


def driving_rules(stops: DataFrame, group: str = "route_id", start: float = 480.0) -> DataFrame:
    """Stops (seq, leg_min, leg_km, service_min) with the breaks and rests that driving times demand between them.

    A break of 45 minutes falls when 4.5 hours were driven without one, a rest of 11 hours when 9 hours were driven
    in the day; a leg is split where the limit is reached, its kilometres in proportion. A leg of unknown length counts
    no minutes, one of unknown kilometres keeps them unknown. Returns ``kind`` (stop, break or rest), clocks in minutes
    and the kilometres driven up to each row since the one before.
    """
    known = lambda v: v is not None and v == v

    def walk(key: object, rows: Rows) -> list[tuple]:
        out, clock, since_break, today = [], start, 0.0, 0.0
        for seq, leg_min, leg_km, service_min in zip(rows["seq"], rows["leg_min"], rows["leg_km"], rows["service_min"], strict=True):
            left = whole = max(0.0, float(leg_min)) if known(leg_min) else 0.0
            km = float(leg_km) if known(leg_km) else None
            while left > 0:
                room = min(DRIVE_LIMIT - since_break, DAY_LIMIT - today)
                if left <= room:
                    break
                clock, left = clock + room, left - room
                part = float(np.floor(leg_km * room / whole * 1000 + 0.5) / 1000) if km is not None else None
                km = max(0.0, round(km - part, 3)) if km is not None else None
                rest = today + room >= DAY_LIMIT
                stay = REST if rest else BREAK
                out.append((key, int(seq), "rest" if rest else "break", clock, clock + stay, part))
                clock += stay
                since_break, today = 0.0, 0.0 if rest else today + room
            clock, since_break, today = clock + left, since_break + left, today + left
            service = float(service_min) if known(service_min) else 15.0
            out.append((key, int(seq), "stop", clock, clock + service, km))
            clock += service
        return out

    return walk_groups(stops, group, ["seq"], walk, f"{group} long, seq int, kind string, arrival double, departure double, km double")


def missed_windows(walked: DataFrame, windows: DataFrame, group: str = "route_id") -> DataFrame:
    """``group, seq, type, by_min`` of stops that a walk with breaks and rests (``driving_rules``) reaches after their window closes or, on the first day, before it opens.

    ``windows`` (group, seq, opens, closes) are clocks as text, either of which may be missing; arrivals count in whole minutes since the first day began.
    """
    told = windows.select(group, "seq", clock_minutes(F.col("opens")).alias("_from"), clock_minutes(F.col("closes")).alias("_to"))
    at = F.floor("arrival").cast("long")
    both = walked.where("kind = 'stop'").join(told, [group, "seq"]).withColumn("_at", at)
    late, early = F.col("_at") - F.col("_to"), F.col("_from") - F.col("_at")
    kind = F.when(late > 0, "intarziere").when((early > 0) & (F.col("_at") < 1440), "prea_devreme")
    return both.withColumn("type", kind).where("type is not null").select(group, "seq", "type", F.when(late > 0, late).otherwise(early).alias("by_min"))


def walk_totals(walked: DataFrame, missed: DataFrame, group: str = "route_id", start: float = 480.0) -> DataFrame:
    """``group, km, span_min, breaks, rests, missed`` of each walk: kilometres known, minutes from its start to its last departure, and how often it stops and misses a window."""
    sums = walked.groupBy(group).agg(exact_sum(F.col("km"), 3).alias("km"), F.floor(F.max("departure") - start + 0.5).alias("span_min"), F.count_if(F.col("kind") == "break").alias("breaks"), F.count_if(F.col("kind") == "rest").alias("rests"))
    hits = missed.groupBy(group).agg(F.count("*").alias("missed"))
    return sums.join(hits, group, "left").select(group, F.coalesce("km", F.lit(0.0)).alias("km"), "span_min", "breaks", "rests", F.coalesce("missed", F.lit(0)).alias("missed"))
