"""Pricing of transport orders: lines, zone taxes, charges, invoice drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.functions.numeric import exact_sum, half_up


def price_lines(trips: DataFrame, zone_taxes: DataFrame, surcharges: DataFrame, manual: DataFrame) -> DataFrame:
    """All lines of each order: ``tpo_id, kind, quantity, unit_rate, amount, warning``.

    ``trips`` (tpo_id, trip_rate, km_rate, min_km, driven_km) give the flat rate and the kilometres, billed at least
    at the minimum; ``zone_taxes`` (tpo_id, zone_id, place, rate) count once a zone, in order of place, and a zone
    without a rate is a line of 0 with a warning; ``surcharges`` (tpo_id, code, rate, quantity) without a rate are
    left out; ``manual`` (tpo_id, amount) are carried over.
    """
    none = F.lit(None).cast("string")
    flat = trips.where("trip_rate is not null").select("tpo_id", F.lit("trip_rate").alias("kind"), F.lit(1.0).alias("quantity"), F.col("trip_rate").alias("unit_rate"), half_up(F.col("trip_rate"), 2).alias("amount"), none.alias("warning"))
    billed = F.greatest(half_up(F.col("driven_km"), 2), F.coalesce("min_km", F.lit(0.0)))
    by_km = trips.where("km_rate is not null and driven_km is not null").select("tpo_id", F.lit("km_rate").alias("kind"), billed.alias("quantity"), F.col("km_rate").alias("unit_rate"), half_up(billed * F.col("km_rate"), 2).alias("amount"), none.alias("warning"))
    first = zone_taxes.groupBy("tpo_id", "zone_id").agg(F.min_by("rate", "place").alias("rate"))
    zones = first.select("tpo_id", F.lit("zone_tax").alias("kind"), F.lit(1.0).alias("quantity"), F.col("rate").alias("unit_rate"), half_up(F.coalesce("rate", F.lit(0.0)), 2).alias("amount"), F.when(F.col("rate").isNull(), "zone_without_rate").alias("warning"))
    amount = F.coalesce(F.when(F.col("quantity") != 0, F.col("quantity")), F.lit(1.0))
    extra = surcharges.where("rate is not null").select("tpo_id", F.lit("surcharge").alias("kind"), amount.alias("quantity"), F.col("rate").alias("unit_rate"), half_up(F.col("rate") * amount, 2).alias("amount"), none.alias("warning"))
    own = manual.select("tpo_id", F.lit("manual").alias("kind"), F.lit(1.0).alias("quantity"), F.col("amount").alias("unit_rate"), half_up(F.col("amount"), 2).alias("amount"), none.alias("warning"))
    return flat.unionByName(by_km).unionByName(zones).unionByName(extra).unionByName(own)


def totals(lines: DataFrame) -> DataFrame:
    """``tpo_id, n_lines, total, warnings`` of priced lines."""
    return lines.groupBy("tpo_id").agg(F.count("*").alias("n_lines"), half_up(exact_sum(F.col("amount")), 2).alias("total"), F.count("warning").alias("warnings"))


def charge_summary(lines: DataFrame, key: str = "tpo_id") -> DataFrame:
    """A column of sums for each kind of line."""
    kinds = ("trip_rate", "km_rate", "zone_tax", "surcharge", "manual")
    sums = [half_up(F.coalesce(exact_sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0.0)), 2).alias(k) for k in kinds]
    return lines.groupBy(key).agg(*sums, half_up(exact_sum(F.col("amount")), 2).alias("total"))


def invoice_draft(lines: DataFrame, clients: DataFrame, stored: DataFrame) -> DataFrame:
    """Subtotal, tax and total a client (client_id, amount; client_id, vat_pct), and whether the stored total differs."""
    subtotal = lines.groupBy("client_id").agg(F.count("*").alias("n_lines"), half_up(exact_sum(half_up(F.col("amount"), 2)), 2).alias("subtotal"))
    out = subtotal.join(clients, "client_id").withColumn("vat", half_up(F.col("subtotal") * F.col("vat_pct") / 100, 2))
    out = out.withColumn("total", half_up(F.col("subtotal") + F.col("vat"), 2)).join(stored, "client_id", "left")
    return out.withColumn("mismatch", F.col("stored_total").isNotNull() & (F.abs(F.col("stored_total") - F.col("total")) > 0.005))


def zone_tax_status(rows: DataFrame) -> DataFrame:
    """The first condition that settles whether a run pays a zone's tax; ``ok`` if it does.

    Reads weight_kg, supported (whether zones exist in the address's town; null: yes), zone_id, address, address_known, address_sure, plate, plate_ok, vehicle_known, mma, threshold and
    rate; a missing flag counts as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(F.col("weight_kg").isNull(), "no_weight")
        .when((F.col("weight_kg") <= 0) | (F.col("weight_kg") > 60_000), "weight_implausible")
        .when(~F.coalesce("supported", F.lit(True)), "outside_city")
        .when(F.coalesce(F.trim("address"), F.lit("")) == "", "no_address")
        .when(~flag("address_known"), "address_unknown")
        .when(~flag("address_sure"), "address_unsure")
        .when(F.col("zone_id").isNull(), "outside")
        .when(F.coalesce(F.trim("plate"), F.lit("")) == "", "plate_missing")
        .when(~flag("plate_ok"), "plate_invalid")
        .when(~flag("vehicle_known"), "vehicle_unknown")
        .when(F.col("mma").isNull(), "mma_missing")
        .when((F.col("mma") < 1) | (F.col("mma") > 60), "mma_suspect")
        .when(F.col("mma") <= F.col("threshold"), "under_threshold")
        .when(F.col("rate").isNull(), "no_bracket")
        .otherwise("ok")
    )
    return rows.withColumn("status", status)
