"""Smaller rules of the office screens: outlines, streets, codes, inboxes, caches, drafts."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.numeric import half_up
from haulspark.functions.text import fold
from haulspark.operators.joins import trusted  # noqa: F401
from haulspark.operators.relational import numbered
from haulspark.sources.shipping import ship_package


def polygon_ring(geojson: Column) -> Column:
    """Outer ring of a GeoJSON Polygon, or of the first of a MultiPolygon, as an array of (lon, lat)."""
    single = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<double>>>")
    multi = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<array<double>>>>")
    ring = F.when(F.get_json_object(geojson, "$.type") == "MultiPolygon", multi[0][0]).otherwise(single[0])
    return F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def kml_ring(kml: Column) -> Column:
    """Ring of the first ``coordinates`` of a KML text."""
    body = F.trim(F.regexp_extract(kml, r"(?s)<coordinates>\s*(.*?)\s*</coordinates>", 1))
    return F.transform(F.split(body, r"\s+"), lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("lon"), F.split(p, ",")[1].try_cast("double").alias("lat")))


def tag_length_value(files: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """``id, seq, tag, length, text`` of records of two bytes tag, one byte kind and two bytes length, big endian.

    ``text`` is the record's longest run of printable characters, if it has four. A record that ends past the file
    closes the walk.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, data in zip(pdf[id_col], pdf[content], strict=True):
                at, seq = 0, 0
                while data is not None and at + 5 <= len(data):
                    tag, _, size = struct.unpack_from(">HBH", data, at)
                    if at + 5 + size > len(data):
                        break
                    runs = re.findall(rb"[\x20-\x7e]{4,}", data[at + 5 : at + 5 + size])
                    seq += 1
                    out.append((key, seq, tag, size, max(runs, key=len).decode() if runs else None))
                    at += 5 + size
            yield pd.DataFrame(out, columns=["id", "seq", "tag", "length", "text"])

    return files.select(id_col, content).mapInPandas(run, "id long, seq int, tag int, length int, text string")


def merge_order(rows: DataFrame, key: str, day: str, index: str) -> DataFrame:
    """``row_no`` by key (blank last), then day, then the order they came in."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    return numbered(rows, [blank, F.trim(F.col(key)), F.col(day).asc_nulls_last(), index], "row_no")


def street_zone(houses: DataFrame, ranges: DataFrame) -> DataFrame:
    """``zone`` of (street, number): that of the range of its side (odd or even) that holds it.

    In a gap the zone is given only if the ranges before and after agree; ranges (street, odd, low, high, zone) of a
    street travel as one array.
    """
    arrays = ranges.groupBy("street", "odd").agg(F.array_sort(F.collect_list(F.struct("low", "high", "zone"))).alias("_r"))
    joined = houses.withColumn("odd", F.col("number") % 2 == 1).join(arrays, ["street", "odd"], "left")
    n = F.col("number")
    inside = F.get(F.filter("_r", lambda r: (r["low"] <= n) & (n <= r["high"])), F.lit(0))["zone"]
    before = F.try_element_at(F.filter("_r", lambda r: r["high"] < n), F.lit(-1))["zone"]
    after = F.get(F.filter("_r", lambda r: r["low"] > n), F.lit(0))["zone"]
    return joined.select(*houses.columns, F.coalesce(inside, F.when(before == after, before)).alias("zone"))


def join_codes(codes: Column) -> Column:
    """Codes trimmed, upper case, each once, in the order they first stand, joined by a comma."""
    clean = F.filter(F.transform(codes, lambda c: F.upper(F.trim(c))), lambda c: c != "")
    return F.array_join(F.array_distinct(clean), ", ")


def transport_code(text: Column) -> Column:
    """A transport declaration's code: 8 to 32 letters and digits once spaces and dashes are out, else null."""
    clean = F.upper(F.regexp_replace(text, r"[\s-]", ""))
    return F.when(clean.rlike("^[A-Z0-9]{8,32}$"), clean)


def margin(revenue: Column, cost: Column) -> Column:
    return F.when(revenue.isNotNull() & cost.isNotNull(), half_up(revenue - cost, 2))


def skill_ids(rows: DataFrame, id_col: str, skills: str) -> DataFrame:
    """``id, skill_ids``: the folded skills of each row as numbers by their order among all skills.

    The vocabulary's ranks are counted range by range and joined.
    """
    one = rows.select(F.col(id_col).alias("id"), F.explode(F.transform(skills, fold)).alias("skill")).distinct()
    ranks = numbered(one.select("skill").distinct(), ["skill"], "n").withColumn("n", F.col("n").cast("int"))
    found = one.join(ranks, "skill").groupBy("id").agg(F.array_sort(F.collect_list("n")).alias("skill_ids"))
    return rows.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("skill_ids", F.array().cast("array<int>")).alias("skill_ids"))


def matrix_misses(pairs: DataFrame, cache: DataFrame, now: str) -> DataFrame:
    """Pairs (from_key, to_key) that the cache does not hold, or only beyond its time; from equals to needs none."""
    fresh = cache.where(F.col("expires_at") > F.lit(now).cast("timestamp")).select("from_key", "to_key")
    return pairs.where("from_key <> to_key").distinct().join(fresh, ["from_key", "to_key"], "left_anti")


def best_block(values: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """The text block of the same document that shares most words with each value: ``block_no, shared``.

    Blocks (key, block_no, text) of a document travel as one array; no shared word gives null.
    """
    arrays = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_no", F.array_distinct(F.split(fold(F.col("text")), " ")).alias("words")))).alias("_b"))
    joined = values.join(arrays, key, "left")
    mine = F.array_distinct(F.split(fold(F.col("value")), " "))
    scored = F.transform("_b", lambda b: F.struct((-F.size(F.array_intersect(b["words"], mine))).alias("s"), b["block_no"].alias("no")))
    top = F.array_min(scored)
    return joined.withColumn("_t", top).select(*values.columns, F.when(F.col("_t.s") < 0, F.col("_t.no")).alias("block_no"), F.greatest(-F.col("_t.s"), F.lit(0)).alias("shared"))


def inbox(rows: DataFrame, dismissed: DataFrame, user: str | None = None) -> DataFrame:
    """Notifications not deleted, unread first, then newest: ``key, created_at, is_read, pos``; with ``user``, numbered for each user, whose column comes first."""
    state = dismissed.select(F.col("key").alias("_k"), "read_at", "deleted_at")
    out = rows.join(state, F.col("key") == F.col("_k"), "left").where("deleted_at is null").withColumn("is_read", F.col("read_at").isNotNull())
    out, order = out.select(*([user] if user else []), "key", "created_at", "is_read"), [F.col("is_read"), F.desc("created_at"), F.col("key")]
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(user).orderBy(*order))) if user else numbered(out, order, "pos")


def waybill_drafts(routes: DataFrame, stops: DataFrame, existing: DataFrame, kinds: Sequence[str] = ("livrare", "schimb")) -> DataFrame:
    """One draft a stop that delivers and has no waybill yet: ``route_id, seq, reference``."""
    wanted = stops.where(F.col("kind").isin(*kinds)).join(existing.select("route_id", "seq"), ["route_id", "seq"], "left_anti")
    return wanted.join(routes.select("route_id", "code"), "route_id").select("route_id", "seq", F.concat_ws("-", "code", F.lpad(F.col("seq").cast("string"), 2, "0")).alias("reference"))
