"""Joins that facts need: as-of, bracket, zone, nearest, fuzzy. Dimension rows of a key travel as one sorted array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.address import plausible_leg
from haulspark.functions.address import postcode as postcode_of
from haulspark.functions.geo import haversine_km, in_polygons
from haulspark.functions.numeric import half_up
from haulspark.functions.text import fold, hamming, once, similarity, unmarked
from haulspark.operators.grouped import dealt
from haulspark.sources.shared import settled

#: Bytes of a dimension's rows, written as JSON, up to which it is sent to every task.
SMALL_BYTES = 32 << 20


def small(packed: DataFrame, rows: DataFrame | None = None, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """``packed``, made of ``rows`` (or those itself), with a broadcast hint if these take no more than ``most_bytes``; above, Spark joins by shuffle.

    The rows are measured, not counted: they may hold arrays and texts of any length. One pass without a shuffle decides.
    """
    rows = packed if rows is None else rows
    size = rows.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*rows.columns)))), F.lit(0))).first()[0]
    return F.broadcast(packed) if size <= most_bytes else packed


def trusted(disabled: Column, verified: Column, source: Column, seen: Column) -> Column:
    """Not disabled, and verified, typed by a person, or seen on two documents."""
    return ~F.coalesce(disabled, F.lit(False)) & (F.coalesce(verified, F.lit(False)) | F.coalesce(source.isin("corrected", "manual"), F.lit(False)) | (F.coalesce(seen, F.lit(0)) >= 2))


def asof(facts: DataFrame, dim: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], position: str = "pos") -> DataFrame:
    """Newest row of ``dim`` valid on ``day``: ``valid_from <= day <= valid_to`` (null: open), first position wins a tie.

    A key's rows become one array, newest first, so a fact meets its key once and is neither multiplied nor
    shuffled by its own id. Facts without a valid row keep nulls.
    """
    order = F.struct((-F.datediff("valid_from", F.lit("1970-01-01"))).alias("age"), F.col(position).alias("pos"), "valid_from", "valid_to", *values)
    arrays = dim.where("valid_from is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_rows"))
    joined = facts.join(small(arrays, dim), list(keys), "left")
    ok = lambda r: (r["valid_from"] <= F.col(day)) & (r["valid_to"].isNull() | (r["valid_to"] >= F.col(day)))
    return joined.withColumn("_hit", F.get(F.filter("_rows", ok), F.lit(0))).select(*facts.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


def asof_with_fallback(facts: DataFrame, dim: DataFrame, keys: Sequence[str], day: str, cls: str, values: Sequence[str], position: str = "pos") -> DataFrame:
    """As-of join that prefers rows of the fact's class and falls back on rows without one.

    A fact without a class matches the rows without one in the first place.
    """
    rank = F.struct((-F.datediff("valid_from", F.lit("1970-01-01"))).alias("age"), F.col(position).alias("pos"), "valid_from", "valid_to", F.coalesce(F.trim(F.lower("cls")), F.lit("")).alias("cls"), *values)
    arrays = dim.where("valid_from is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(rank)).alias("_rows"))
    joined = facts.join(small(arrays, dim), list(keys), "left")
    wanted = F.coalesce(F.trim(F.lower(F.col(cls))), F.lit(""))
    ok = lambda r: (r["valid_from"] <= F.col(day)) & (r["valid_to"].isNull() | (r["valid_to"] >= F.col(day)))
    valid = F.filter("_rows", ok)
    hit = F.coalesce(F.get(F.filter(valid, lambda r: r["cls"] == wanted), F.lit(0)), F.get(F.filter(valid, lambda r: r["cls"] == ""), F.lit(0)))
    return joined.withColumn("_hit", hit).select(*facts.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


def bracket(facts: DataFrame, dim: DataFrame, keys: Sequence[str], amount: str, day: str, values: Sequence[str], position: str = "pos") -> DataFrame:
    """Row of ``dim`` whose closed interval [low, high] (null: no limit) holds ``amount`` on ``day``; the narrowest wins.

    Of equally narrow brackets the newest wins, then the first position.
    """
    width = F.coalesce(F.col("high") - F.coalesce("low", F.lit(0.0)), F.lit(float("inf")))
    rank = F.struct(width.alias("width"), (-F.datediff("valid_from", F.lit("1970-01-01"))).alias("age"), F.col(position).alias("pos"), "low", "high", "valid_from", "valid_to", *values)
    arrays = dim.groupBy(*keys).agg(F.array_sort(F.collect_list(rank)).alias("_rows"))
    joined = facts.join(small(arrays, dim), list(keys), "left")
    x, d = F.col(amount), F.col(day)
    ok = lambda r: (x >= F.coalesce(r["low"], F.lit(0.0))) & (r["high"].isNull() | (x <= r["high"])) & (r["valid_from"] <= d) & (r["valid_to"].isNull() | (r["valid_to"] >= d))
    return joined.withColumn("_hit", F.get(F.filter("_rows", ok), F.lit(0))).select(*facts.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


#: Degrees of a cell of the grid by which points meet the zones around them.
CELL = 0.05


def zone_of(points: DataFrame, zones: DataFrame, lon: str = "lon", lat: str = "lat", county: str = "county", city: str = "city", postcode: str = "postcode") -> DataFrame:
    """``zone_id`` and ``matched_by`` for every point: any polygon hit beats any text hit, then priority, then position.

    Zones have zone_id, priority, pos, active, polygons (arrays of rings, of which all but the first are holes) and the lists counties,
    cities and postcodes. A text hit needs every list that is not empty to hold the point's value, postcodes by how they begin. A cell
    of the grid, a town, a county or a first digit brings its zones as one array, so that points are not multiplied and
    no table is sent out whole.
    """
    active = zones.where(F.coalesce("active", F.lit(True))).select("zone_id", (-F.col("priority")).alias("rank"), "pos", "polygons", *[F.transform(F.coalesce(c, F.array().cast("array<string>")), f).alias(c) for c, f in (("counties", F.upper), ("cities", fold), ("postcodes", lambda v: F.trim(v)))])
    vertices = lambda c: F.transform(F.flatten(F.transform("polygons", lambda rings: F.get(rings, F.lit(0)))), lambda v: v[c])
    span = lambda c: F.sequence(F.floor(F.array_min(vertices(c)) / CELL).cast("long"), F.floor(F.array_max(vertices(c)) / CELL).cast("long"))
    drawn = active.where("polygons is not null and size(polygons) > 0").withColumn("_cx", F.explode(span("lon"))).withColumn("_cy", F.explode(span("lat")))
    by_cell = drawn.groupBy("_cx", "_cy").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "zone_id", "polygons"))).alias("_drawn"))
    # a zone is found by one of its lists, and then held against all
    keys = F.when(F.size("cities") > 0, F.transform("cities", lambda v: F.concat(F.lit("t:"), v))).when(F.size("counties") > 0, F.transform("counties", lambda v: F.concat(F.lit("c:"), v))).otherwise(
        F.array_distinct(F.transform("postcodes", lambda v: F.concat(F.lit("p:"), F.substring(v, 1, 1))))
    )
    named = active.withColumn("_key", F.explode(keys)).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "zone_id", "counties", "cities", "postcodes"))).alias("_named"))
    x, y = F.col(lon), F.col(lat)
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = points.withColumns({
        "_cx": F.floor(x / CELL).cast("long"), "_cy": F.floor(y / CELL).cast("long"), "_t": fold(blank(city)), "_c": F.upper(blank(county)), "_p": blank(postcode),
    }).join(by_cell, ["_cx", "_cy"], "left")
    for name, key in (("_n1", F.concat(F.lit("t:"), F.col("_t"))), ("_n2", F.concat(F.lit("c:"), F.col("_c"))), ("_n3", F.concat(F.lit("p:"), F.substring("_p", 1, 1)))):
        out = out.withColumn("_key", key).join(named.withColumnRenamed("_named", name), "_key", "left").drop("_key")
    fits = lambda z: (
        ((F.size(z["counties"]) == 0) | F.array_contains(z["counties"], F.col("_c"))) & ((F.size(z["cities"]) == 0) | F.array_contains(z["cities"], F.col("_t")))
        & ((F.size(z["postcodes"]) == 0) | F.exists(z["postcodes"], lambda v: F.col("_p").startswith(v)))
    )
    none = F.array().cast("array<struct<rank:int,pos:int,zone_id:int>>")
    short = lambda zones_: F.transform(zones_, lambda z: F.struct(z["rank"].cast("int").alias("rank"), z["pos"].cast("int").alias("pos"), z["zone_id"].cast("int").alias("zone_id")))
    inside = F.get(F.filter("_drawn", lambda z: in_polygons(x, y, z["polygons"])), F.lit(0))
    texts = F.array_min(F.concat(*[F.coalesce(short(F.filter(n, fits)), none) for n in ("_n1", "_n2", "_n3")]))
    out = out.withColumns({"_in": inside, "_tx": texts})
    return out.select(
        *points.columns, F.coalesce(F.col("_in.zone_id").cast("int"), F.col("_tx.zone_id")).alias("zone_id"),
        F.when(F.col("_in").isNotNull(), "polygon").when(F.col("_tx").isNotNull(), "text").alias("matched_by"),
    )


def known_address(rows: DataFrame, addresses: DataFrame, least: float = 0.6, lead: float = 0.15) -> DataFrame:
    """``address_id, reason, candidates`` of rows (postcode, locality, hints): the stored address of the postcode that may fill them.

    Addresses (address_id, postcode, locality, street_name, display, disabled, verified, source, seen_count) must be trusted, of the same town
    if both are known, and, unless a person confirmed them, look like one; confirmed ones go first. Of several the one whose street a hint resembles
    clearly best is taken; else the first rule that left none is the reason.
    """
    a = addresses.select(
        postcode_of(F.col("postcode")).alias("_pc"), "address_id", fold(F.coalesce("locality", F.lit(""))).alias("town"), F.split(fold(F.coalesce("street_name", F.lit(""))), " ").alias("words"),
        trusted(F.col("disabled"), F.col("verified"), F.col("source"), F.col("seen_count")).alias("trusted"), (F.coalesce("verified", F.lit(False)) | F.coalesce(F.col("source").isin("corrected", "manual"), F.lit(False))).alias("human"),
        plausible_leg(F.col("display")).alias("plausible"),
    ).where("_pc is not null")
    packed = a.groupBy("_pc").agg(F.array_sort(F.collect_list(F.struct("address_id", "town", "words", "trusted", "human", "plausible"))).alias("_all"))
    town = fold(F.coalesce("locality", F.lit("")))
    out = rows.withColumns({"_pc": postcode_of(F.col("postcode")), "_town": town}).join(packed, "_pc", "left")
    out = out.withColumn("_t1", F.filter("_all", lambda x: F.coalesce(x["trusted"], F.lit(False))))
    out = out.withColumn("_t2", F.filter("_t1", lambda x: (F.col("_town") == "") | (x["town"] == "") | (x["town"] == F.col("_town"))))
    out = out.withColumn("_t3", F.filter("_t2", lambda x: x["human"] | x["plausible"]))
    out = out.withColumn("_t4", F.when(F.exists("_t3", lambda x: x["human"]), F.filter("_t3", lambda x: x["human"])).otherwise(F.col("_t3")))
    best_of = lambda w: F.array_max(F.transform("hints", lambda h: similarity(w, h)))
    score = lambda x: F.coalesce(F.array_max(F.transform(F.filter(x["words"], lambda w: F.length(w) >= 3), best_of)), F.lit(0.0))
    out = out.withColumn("_s", F.array_sort(F.transform("_t4", lambda x: F.struct((-score(x)).alias("s"), x["address_id"].alias("id")))))
    top, second = -F.get("_s", F.lit(0))["s"], -F.get("_s", F.lit(1))["s"]
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    empty = lambda c: n(c) <= 0
    reason = (
        F.when(F.col("_pc").isNull(), "no_postcode").when(empty("_all"), "unknown_postcode").when(empty("_t1"), "no_trusted").when(empty("_t2"), "locality_mismatch").when(empty("_t3"), "junk_filtered")
        .when(n("_t4") == 1, F.lit(None)).when(top < least, "below_threshold").when(second.isNotNull() & (top - second < lead), "ambiguous")
    )
    out = out.withColumn("reason", reason)
    candidates = F.when(F.col("_pc").isNull() | empty("_all"), 0).when(empty("_t3"), n("_all")).otherwise(n("_t4"))
    return out.select(*rows.columns, F.when(F.col("reason").isNull(), F.get("_s", F.lit(0))["id"]).alias("address_id"), "reason", candidates.alias("candidates"))


def distance_matrix(places: DataFrame, most: int = 200) -> DataFrame:
    """``from_id, to_id, km`` between all places (id, lat, lon) of one plan, with one decimal. More than ``most`` places are an error.

    A plan's places are one list, which each of them is held against.
    """
    listed = places.agg(F.collect_list(F.struct("id", "lat", "lon")).alias("p")) if places.limit(most + 1).count() <= most else None
    if listed is None:
        raise ValueError(f"a plan has {most} places at most")
    ends = lambda p: F.transform(F.filter("p", lambda q: q["id"] != p["id"]), lambda q: F.struct(p["id"].alias("from_id"), q["id"].alias("to_id"), half_up(haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]), 1).alias("km")))
    return listed.select(F.inline(F.flatten(F.transform("p", ends))))


def best_match(facts: DataFrame, names: DataFrame, key: str, text: str, least: float = 0.6, lead: float = 0.15) -> DataFrame:
    """The known name of the same ``key`` most like ``text``, if similar enough and clear of the next; else the reason.

    ``names`` (key, name) are those of a key; they travel with it as one array, of which the two best are kept while it
    is read once. Facts that ask for one text under one key are answered once. Names are folded once, and one whose length
    alone keeps it from the two best is not compared. Ties go to the name in order.
    """
    arrays = names.groupBy(key).agg(F.collect_set("name").alias("_set")).select(key, F.transform(F.array_sort("_set"), lambda n: F.struct(n.alias("name"), F.coalesce(unmarked(n), F.lit("")).alias("low"))).alias("_names"))
    asked = dealt(facts.select(key, F.col(text).alias("_text")).distinct(), "_text").withColumn("_low", F.coalesce(unmarked(F.col("_text")), F.lit("")))
    joined = asked.join(small(arrays, names), key, "left")
    row = "struct<s:double,name:string>"
    none = F.lit(None).cast(row)
    low = F.col("_low")
    rounded = lambda s: F.floor(s * 10000 + 0.5) / 10000
    longer = lambda n: F.greatest(F.length(low), F.length(n["low"]))
    scored = lambda n: F.struct(rounded(F.when((low == "") | (n["low"] == ""), 0.0).otherwise(1 - F.levenshtein(low, n["low"]) / longer(n))).alias("s"), n["name"].alias("name"))
    most = lambda n: rounded(F.when(longer(n) > 0, 1 - F.abs(F.length(low) - F.length(n["low"])) / longer(n)).otherwise(0.0))

    def better(held: Column, n: Column) -> Column:
        def told(new: Column) -> Column:
            first = held["first"].isNull() | (new["s"] > held["first"]["s"])
            second = held["second"].isNull() | (new["s"] > held["second"]["s"])
            return F.struct(F.when(first, new).otherwise(held["first"]).cast(row).alias("first"), F.when(first, held["first"]).when(second, new).otherwise(held["second"]).cast(row).alias("second"))

        beaten = held["second"].isNotNull() & (most(n) <= held["second"]["s"])
        return F.when(beaten, held).otherwise(once(scored(n), told))

    out = joined.withColumn("_b", F.aggregate("_names", F.struct(none.alias("first"), none.alias("second")), better))
    top, second = F.col("_b.first.s"), F.col("_b.second.s")
    reason = F.when(top.isNull(), "no_candidate").when(top < least, "too_different").when(second.isNotNull() & (top - second < lead), "ambiguous").otherwise("matched")
    out = out.select(F.col(key).alias("_key"), "_text", F.when(reason == "matched", F.col("_b.first.name")).alias("matched_name"), top.alias("score"), reason.alias("reason"))
    out = settled(out)
    told = facts.join(small(out), F.col(key).eqNullSafe(F.col("_key")) & F.col(text).eqNullSafe(F.col("_text")), "left")
    return told.select(*facts.columns, "matched_name", "score", "reason")


def one_digit_off(plates: DataFrame, fleet: DataFrame, series: str = "series", digits: str = "digits") -> DataFrame:
    """Fleet plate of the same series that differs in exactly one digit, if there is just one such plate."""
    arrays = fleet.groupBy(series).agg(F.array_sort(F.collect_set(digits)).alias("_fleet"))
    joined = plates.join(small(arrays, fleet), series, "left")
    near = F.filter("_fleet", lambda d: hamming(d, F.col(digits)) == 1)
    known = F.array_contains("_fleet", F.col(digits))
    fixed = F.when(known, F.col(digits)).when(F.size(near) == 1, F.get(near, F.lit(0)))
    return joined.select(*plates.columns, fixed.alias("fixed_digits"))


def keep_newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in ``order``: what an upsert of the rows would leave.

    Partial maxima are taken before the shuffle, which a window would not do.
    """
    rest = [c for c in rows.columns if c not in keys]
    named = [o.alias(f"o{i}") for i, o in enumerate(order)]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*named, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
