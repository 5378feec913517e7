"""Planning: territories, load packing, driver assignment. Heuristics whose steps depend on each other, one group a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.geo import haversine_km
from haulspark.functions.numeric import exact_sum, percent
from haulspark.operators.grouped import Rows, dealt, walk_groups
from haulspark.operators.relational import top_rows
from haulspark.sources.shared import settled
from haulspark.sources.shipping import ship_package


def location_weight(m3: Column, kg: Column, stops: Column) -> Column:
    """Work at a location: ten a cubic metre, one a hundred kilograms, one a stop; 1 if that is not positive."""
    w = F.coalesce(m3, F.lit(0.0)) * 10 + F.coalesce(kg, F.lit(0.0)) / 100 + F.coalesce(stops, F.lit(0))
    return F.when(w > 0, w).otherwise(1.0)


#: Points of a depot from which its seeds are chosen, those of smallest hash.
SEED_POINTS = 256


def _seeds(locations: DataFrame, depot: str, k: int) -> DataFrame:
    """Up to ``k`` centres a depot, each the sampled point farthest from those before it; the sample is bounded."""

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        places = np.radians(pdf.sort_values(["_h", "lat", "lon"])[["lat", "lon"]].drop_duplicates().to_numpy())
        flat = places * [1, np.cos(places[:, 0].mean())]
        chosen, nearest = [0], np.full(len(flat), np.inf)
        while len(chosen) < min(k, len(flat)):
            nearest = np.minimum(nearest, ((flat - flat[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(nearest.argmax()))
        at = np.degrees(places[chosen])
        return pd.DataFrame({depot: pdf[depot].iloc[0], "cluster": np.arange(len(at), dtype=np.int32), "clat": at[:, 0], "clon": at[:, 1]})

    hashed = locations.select(depot, "lat", "lon", F.xxhash64("location_id", "lat", "lon").alias("_h"))
    sample = top_rows(hashed, [depot], [F.col("_h"), F.col("lat"), F.col("lon")], SEED_POINTS)
    return sample.groupBy(depot).applyInPandas(spread, f"{depot} int, cluster int, clat double, clon double")


def territories(locations: DataFrame, depot: str, k: int, rounds: int = 36) -> DataFrame:
    """Each depot's locations (location_id, lat, lon, weight) in ``k`` clusters of about equal weight: ``depot, location_id, weight, cluster``.

    A location goes where its squared distance in km plus the cluster's price is least. Every round is one job over the locations, which meet their depot's few centres and prices: a
    cluster's price rises where it has more than its share and falls where it has less, at first while centres move to the middle of what they have, then with centres at rest; a price
    that overshot takes smaller steps. Of all rounds each depot keeps the one whose heaviest deviation was smallest. Only centres, prices and loads are gathered, as small tables; locations are never brought together, so a depot may
    hold any share of all rows. A depot with fewer places than ``k`` has as many clusters. Locations without a place are left out.
    """
    ship_package(locations.sparkSession)
    placed = locations.where("lat is not null and lon is not null").select(F.col(depot).cast("int").alias(depot), "location_id", "lat", "lon", F.col("weight").cast("double").alias("weight"))
    points = settled(dealt(placed, "location_id"))  # a small file of many rows would be one task's in every round
    state = settled(_seeds(points, depot, k).withColumns({"price": F.lit(0.0), "gain": F.lit(1.0), "before": F.lit(0.0), "round": F.lit(0)}))
    kept = []

    def nearest(state: DataFrame) -> DataFrame:
        few = state.groupBy(depot).agg(F.array_sort(F.collect_list(F.struct("cluster", "clat", "clon", "price"))).alias("_c"))
        squared = lambda c: F.pow(haversine_km(F.col("lat"), F.col("lon"), c["clat"], c["clon"]), F.lit(2.0))
        apart = F.transform("_c", lambda c: F.struct(squared(c).alias("km2"), c["price"].alias("price"), c["cluster"].alias("cluster")))  # worked out once
        best = F.array_min(F.transform(apart, lambda c: F.struct((c["km2"] + c["price"]).alias("score"), c["cluster"].alias("cluster"), c["km2"].alias("km2"))))
        return points.join(few, depot).withColumn("_b", best).select(*points.columns, F.col("_b.cluster").alias("cluster"), F.col("_b.km2").alias("km2"))

    for r in range(1, rounds + 1):
        kg = F.col("weight")
        loads = nearest(state).groupBy(depot, "cluster").agg(exact_sum(kg, 6).alias("load"), exact_sum(kg * F.col("lat"), 9).alias("y"), exact_sum(kg * F.col("lon"), 9).alias("x"), exact_sum(kg * F.col("km2"), 6).alias("spread"))
        w = Window.partitionBy(depot)  # of a depot's clusters
        told = state.join(loads, [depot, "cluster"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
        told = told.withColumns({"share": F.sum("load").over(w) / F.count("*").over(w), "scale": F.sum("spread").over(w) / F.sum("load").over(w)})
        told = settled(told.withColumn("off", F.coalesce(F.col("load") / F.col("share") - 1, F.lit(0.0))).withColumn("worst", F.max(F.abs("off")).over(w)))
        kept.append(told.select(depot, "cluster", "clat", "clon", "price", "round", "worst"))
        moving = r <= rounds // 3
        # a price that overshot takes half the step, one that did not a longer one
        gain = F.when(F.col("off") * F.col("before") < 0, F.col("gain") / 2).otherwise(F.least(F.col("gain") * 1.3, F.lit(2.0)))
        price = F.col("price") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("off"))) * F.greatest("scale", F.lit(1e-6)) * gain
        centre = lambda old, new: F.when((F.col("load") > 0) & F.lit(moving), F.col(new) / F.col("load")).otherwise(F.col(old))  # noqa: B023, E731
        state = told.select(depot, "cluster", centre("clat", "y").alias("clat"), centre("clon", "x").alias("clon"), price.alias("price"), gain.alias("gain"), F.col("off").alias("before"), F.lit(r).alias("round"))
    every = settled(reduce(DataFrame.unionByName, kept))
    chosen = every.groupBy(depot).agg(F.min(F.struct("worst", "round"))["round"].alias("round"))
    return nearest(settled(every.join(chosen, [depot, "round"]).select(depot, "cluster", "clat", "clon", "price"))).select(depot, "location_id", "weight", "cluster")


def balance_report(clusters: DataFrame, depot: str, limit_pct: float = 15.0) -> DataFrame:
    """Load of each cluster, its deviation from its depot's mean in percent, and whether the depot is balanced."""
    load = clusters.groupBy(depot, "cluster").agg(F.sum(F.col("weight").cast("decimal(28,4)")).cast("double").alias("load"))
    w = Window.partitionBy(depot)
    out = load.withColumn("mean_load", F.avg("load").over(w)).withColumn("deviation_pct", percent(F.abs(F.col("load") - F.col("mean_load")), F.col("mean_load")))
    return out.withColumn("balanced", F.max("deviation_pct").over(w) <= limit_pct)


def hull(points: DataFrame, group: str, pad_km: float = 0.0) -> DataFrame:
    """Convex hull of each group's points (x: longitude, y: latitude) as an array of (x, y), counter-clockwise from the lowest left, its corners moved ``pad_km`` out from their middle.

    Each task first reduces its own points to the hull of every group they belong to, so what is shuffled is hulls and no group is brought together whole.
    A point alone is a small diamond when it is padded.
    """
    ship_package(points.sparkSession)

    def corners(pts: np.ndarray) -> list[tuple[float, float]]:
        def half(seq) -> list:
            out: list = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 1e-12:
                    out.pop()
                out.append(p)
            return out

        pts = sorted(set(map(tuple, pts.tolist())))
        return pts if len(pts) < 3 else half(pts)[:-1] + half(reversed(pts))[:-1]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby(group):
                pts = part[["x", "y"]].to_numpy()
                held[g] = np.array(corners(np.vstack([held[g], pts]) if g in held else pts))
        for g, pts in held.items():
            yield pd.DataFrame({group: g, "x": pts[:, 0], "y": pts[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = np.array(corners(pdf[["x", "y"]].to_numpy()))
        if pad_km and len(ring) == 1:
            ring = ring[0] + 0.01 * np.array([[0, -1], [1, 0], [0, 1], [-1, 0]])
        elif pad_km and len(ring) > 2:
            out = ring - ring.mean(axis=0)
            length = np.hypot(out[:, 0], out[:, 1])
            ring = ring + out / np.where(length > 0, length, 1)[:, None] * (pad_km / 111)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "ring": [[{"x": x, "y": y} for x, y in ring.tolist()]]})

    kind = dict(points.dtypes)[group]
    some = points.where(F.col(group).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(group, "x", "y")
    return some.mapInPandas(own, f"{group} {kind}, x double, y double").groupBy(group).applyInPandas(whole, f"{group} {kind}, ring array<struct<x:double,y:double>>")


def pack(items: DataFrame, route: str, length: float, width: float, height: float) -> DataFrame:
    """Places of a route's boxes (item_id, stop_seq, l, w, h, and perhaps tip) in a hold; what does not fit has nulls.

    Last stops are loaded first. A box takes, of two rotations, or of six if it may tip, the free corner with the smallest
    height, then depth, then side, where at least half its base is carried. Returns ``item_id, x, y, z, dl, dw, dh``;
    one route is one group.
    """

    def load(key: object, rows: Rows) -> list[tuple]:
        placed: list[tuple] = []
        corners = [(0.0, 0.0, 0.0)]
        out = []
        order = sorted(range(len(rows["item_id"])), key=lambda i: (-rows["stop_seq"][i], rows["item_id"][i]))
        for i in order:
            l, w, h = rows["l"][i], rows["w"][i], rows["h"][i]  # noqa: E741
            best = None
            tips = "tip" in rows and rows["tip"][i]
            for dl, dw, dh in dict.fromkeys(permutations((l, w, h)) if tips else [(l, w, h), (w, l, h)]):
                for x, y, z in corners:
                    if x + dl > length + 1e-9 or y + dw > width + 1e-9 or z + dh > height + 1e-9:
                        continue
                    score = (z * 1e6 + x * 1e3 + y, dl, dw)
                    if best is not None and score >= best[0]:
                        continue
                    if any(x < q[0] + q[3] - 1e-9 and q[0] < x + dl - 1e-9 and y < q[1] + q[4] - 1e-9 and q[1] < y + dw - 1e-9 and z < q[2] + q[5] - 1e-9 and q[2] < z + dh - 1e-9 for q in placed):
                        continue
                    carried = sum(max(0, min(x + dl, q[0] + q[3]) - max(x, q[0])) * max(0, min(y + dw, q[1] + q[4]) - max(y, q[1])) for q in placed if abs(q[2] + q[5] - z) <= 0.02)
                    if z <= 0.02 or carried >= 0.5 * dl * dw:
                        best = (score, (x, y, z, dl, dw, dh))
            if best is None:
                out.append((key, rows["item_id"][i], *[None] * 6))
                continue
            x, y, z, dl, dw, dh = best[1]
            placed.append(best[1])
            corners = [c for c in corners if c != (x, y, z)] + [(x + dl, y, z), (x, y + dw, z), (x, y, z + dh)]
            out.append((key, rows["item_id"][i], *best[1]))
        return out

    return walk_groups(items, route, ["stop_seq", "item_id"], load, f"{route} long, item_id long, x double, y double, z double, dl double, dw double, dh double")


def grid_load(items: DataFrame, plan: str, length: float, width: float, height: float, cell: float = 0.2) -> DataFrame:
    """Places of a plan's boxes (item_id, stop_seq, l, w, h, stackable) on a grid of ``cell`` metres, first fit; what does not fit has nulls.

    Last stops are loaded first. A box takes the first cells, front to back and side to side, whose tops are level and may carry, in either of two
    directions. Returns ``item_id, x, y, z, dl, dw, dh``; one plan is one group.
    """
    nx, ny = int(length / cell + 1e-9), int(width / cell + 1e-9)

    def load(key: object, rows: Rows) -> list[tuple]:
        top, open_ = np.zeros((nx, ny)), np.ones((nx, ny), bool)
        out = []
        for i in sorted(range(len(rows["item_id"])), key=lambda i: (-rows["stop_seq"][i], rows["item_id"][i])):
            l, w, h = rows["l"][i], rows["w"][i], rows["h"][i]  # noqa: E741
            place = None
            for dl, dw in dict.fromkeys([(l, w), (w, l)]):
                a, b = int(np.ceil(dl / cell - 1e-9)), int(np.ceil(dw / cell - 1e-9))
                if a > nx or b > ny:
                    continue
                tops = np.lib.stride_tricks.sliding_window_view(top, (a, b))
                fits = (tops.max(axis=(2, 3)) == tops.min(axis=(2, 3))) & np.lib.stride_tricks.sliding_window_view(open_, (a, b)).all(axis=(2, 3)) & (tops[:, :, 0, 0] + h <= height + 1e-9)
                at = np.argwhere(fits)
                if len(at) and (place is None or tuple(at[0]) < place[0]):
                    place = (tuple(at[0]), a, b, dl, dw)
            if place is None:
                out.append((key, rows["item_id"][i], *[None] * 6))
                continue
            (x, y), a, b, dl, dw = place
            z = float(top[x, y])
            top[x : x + a, y : y + b] = z + h
            open_[x : x + a, y : y + b] = bool(rows["stackable"][i])
            out.append((key, rows["item_id"][i], round(x * cell, 6), round(y * cell, 6), z, dl, dw, h))
        return out

    return walk_groups(items, plan, ["stop_seq", "item_id"], load, f"{plan} long, item_id long, x double, y double, z double, dl double, dw double, dh double")


def assign_drivers(vehicles: DataFrame, drivers: DataFrame, depot: str) -> DataFrame:
    """One pass over a depot's vehicles in order: the preferred driver if still free, else the next free one."""
    ship_package(vehicles.sparkSession)

    def give(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        drivers_ = right.sort_values("driver_id")["driver_id"].tolist()
        free, following, out = set(drivers_), iter(drivers_), []
        for v in left.sort_values("vehicle_id").itertuples():
            wanted = v.preferred if v.known else None
            chosen = wanted if wanted in free else next((d for d in following if d in free), None)
            free.discard(chosen)
            out.append((v.vehicle_id, chosen))
        return pd.DataFrame(out, columns=["vehicle_id", "driver_id"]).astype({"driver_id": "Int64"})

    # a null among longs would reach pandas as doubles
    vehicles = vehicles.withColumns({"known": F.col("preferred").isNotNull(), "preferred": F.coalesce("preferred", F.lit(0))})
    return vehicles.groupBy(depot).cogroup(drivers.groupBy(depot)).applyInPandas(give, "vehicle_id long, driver_id long")


def nearest_neighbour_order(stops: DataFrame, route: str) -> DataFrame:
    """Visiting order by always going to the nearest stop left, from the first; a stand-in for an outside solver."""

    def walk(key: object, rows: Rows) -> list[tuple]:
        xy = list(zip(rows["lat"], rows["lon"], strict=True))
        left, now, order = set(range(1, len(xy))), 0, [0]
        while left:
            x, y = xy[now]
            now = min(left, key=lambda j: ((xy[j][0] - x) ** 2 + (xy[j][1] - y) ** 2, j))
            left.remove(now)
            order.append(now)
        return [(key, rows["stop_id"][i], n + 1) for n, i in enumerate(order)]

    return walk_groups(stops, route, ["seq"], walk, f"{route} long, stop_id long, visit int")
