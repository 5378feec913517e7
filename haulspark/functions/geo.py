"""Distances and areas on the globe as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule for a ring given as an array of (lon, lat) structs, first point repeated at the end."""
    steps = F.sequence(F.lit(0), F.size(ring) - 2)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return spans & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(spans, b["lat"] - a["lat"]) + a["lon"])

    return F.aggregate(steps, F.lit(False), lambda inside, i: F.when(F.coalesce(crosses(i), F.lit(False)), ~inside).otherwise(inside))


def in_polygons(lon: Column, lat: Column, polygons: Column) -> Column:
    """Whether a point lies in one of ``polygons``, arrays of rings of which all but the first are holes."""
    return F.exists(polygons, lambda rings: in_ring(lon, lat, F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda hole: in_ring(lon, lat, hole)))


def geojson_polygons(geometry: Column) -> Column:
    """Polygons of a GeoJSON Polygon or MultiPolygon as arrays of rings of (lon, lat); other kinds are null."""
    kind, text = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    single, multi = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    nested = F.when(kind == "Polygon", F.array(F.from_json(text, single))).when(kind == "MultiPolygon", F.from_json(text, multi))
    return F.transform(nested, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))


# Metres a degree of longitude at the equator and of latitude.
METRES_LON, METRES_LAT = 111_320.0, 110_540.0


def ring_metrics(ring: Column) -> Column:
    """``area`` (square metres), ``perimeter`` (metres) and ``compactness`` (1 for a circle) of a closed ring; zeros below four points.

    Metres are counted from the ring's first point: products of metres from the equator would cost the area its last digits.
    """
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    flat = F.transform(F.array(F.cos(F.radians(mean)) * METRES_LON), lambda mx: F.transform(ring, lambda p: F.struct(((p["lon"] - F.get(ring, F.lit(0))["lon"]) * mx).alias("x"), ((p["lat"] - F.get(ring, F.lit(0))["lat"]) * METRES_LAT).alias("y"))))[0]
    sides = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: i)
    sums = F.transform(
        F.array(flat),
        lambda f: F.aggregate(
            sides, F.struct(F.lit(0.0).alias("twice"), F.lit(0.0).alias("around")),
            lambda s, i: F.struct(
                (s["twice"] + F.get(f, i)["x"] * F.get(f, i + 1)["y"] - F.get(f, i + 1)["x"] * F.get(f, i)["y"]).alias("twice"),
                (s["around"] + F.hypot(F.get(f, i + 1)["x"] - F.get(f, i)["x"], F.get(f, i + 1)["y"] - F.get(f, i)["y"])).alias("around"),
            ),
        ),
    )[0]
    enough = F.size(ring) >= 4
    area, around = F.when(enough, F.abs(sums["twice"]) / 2).otherwise(0.0), F.when(enough, sums["around"]).otherwise(0.0)
    return F.transform(F.array(F.struct(area.alias("a"), around.alias("p"))), lambda m: F.struct(m["a"].alias("area"), m["p"].alias("perimeter"), F.when(m["p"] > 0, 4 * F.pi() * m["a"] / (m["p"] * m["p"])).otherwise(0.0).alias("compactness")))[0]


def ring_bounds(ring: Column) -> Column:
    """``south, west, north, east`` of a ring."""
    side = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(side(F.array_min, "lat").alias("south"), side(F.array_min, "lon").alias("west"), side(F.array_max, "lat").alias("north"), side(F.array_max, "lon").alias("east"))


def ring_spikes(ring: Column, most_degrees: float = 20.0, least_leg_m: float = 50.0) -> Column:
    """Places (from 0) of vertices where the ring shoots out and comes back: a sharp angle between two long legs."""
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    mx = F.cos(F.radians(mean)) * METRES_LON

    def angle(i: Column) -> Column:
        a, b, c = F.get(ring, i - 1), F.get(ring, i), F.get(ring, i + 1)
        ax, ay, bx, by = (a["lon"] - b["lon"]) * mx, (a["lat"] - b["lat"]) * METRES_LAT, (c["lon"] - b["lon"]) * mx, (c["lat"] - b["lat"]) * METRES_LAT
        la, lb = F.hypot(ax, ay), F.hypot(bx, by)
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (la * lb)))
        return (la >= least_leg_m) & (lb >= least_leg_m) & (F.degrees(F.acos(cos)) < most_degrees)

    inner = F.when(F.size(ring) >= 4, F.sequence(F.lit(1), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: F.coalesce(angle(i), F.lit(False)))


def coordinate_key(lat: Column, lon: Column, decimals: int = 5) -> Column:
    """A point as text with a fixed number of decimals, the same for equal points."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string(f"%.{decimals}f,%.{decimals}f", lat, lon))
