"""Places from what is on file: candidates of clients and trips, assessed, made one an address, written as locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.functions.address import address_key, parse, quality
from haulspark.functions.numeric import exact_sum, half_up
from haulspark.functions.text import once, unmarked
from haulspark.operators.grouped import dealt
from haulspark.operators.joins import small
from haulspark.sources.shared import settled


def candidates(clients: DataFrame, trips: DataFrame) -> DataFrame:
    """``source, source_id, client_id, name, address, contact, phone, n`` of clients (client_id, name, tax_id, address, contact, phone) and of the two ends of trips.

    Trips (trip_id, and of shipper and consignee _name, _address, _tax_id, _contact, _phone) find their client by tax number, else by name, of several by the
    smallest id. Blank addresses are none. ``n`` orders clients before trips.
    """
    digits = lambda c: F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), F.lit(""))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    own = clients.where(filled(F.col("address"))).select(F.lit("client").alias("source"), F.col("client_id").alias("source_id"), "client_id", F.coalesce("name", F.lit("Client fără nume")).alias("name"), "address", "contact", "phone", F.lit(0).alias("n"))
    by_tax = clients.groupBy(digits(F.col("tax_id")).alias("_tax")).agg(F.min("client_id").alias("_c1")).where("_tax is not null")
    by_name = clients.groupBy(F.nullif(unmarked(F.col("name")), F.lit("")).alias("_name")).agg(F.min("client_id").alias("_c2")).where("_name is not null")
    out = own
    for n, role in enumerate(("shipper", "consignee"), 1):
        c = lambda name, role=role: F.col(f"{role}_{name}")
        party = trips.where(filled(c("address"))).select(
            F.lit(f"trip_{role}").alias("source"), F.col("trip_id").alias("source_id"), F.coalesce(c("name"), F.lit(f"Adresă {role}")).alias("name"), c("address").alias("address"), c("contact").alias("contact"), c("phone").alias("phone"),
            digits(c("tax_id")).alias("_tax"), F.nullif(unmarked(c("name")), F.lit("")).alias("_name"),
        )
        party = party.join(by_tax, "_tax", "left").join(by_name, "_name", "left")
        out = out.unionByName(party.select("source", "source_id", F.coalesce("_c1", "_c2").alias("client_id"), "name", "address", "contact", "phone", F.lit(n).alias("n")))
    return out


def assessed(rows: DataFrame) -> DataFrame:
    """Candidates with ``parsed``, ``address_key``, ``score``, ``tier`` and ``flags``, as a table in the shared folder: what follows reads it more than once.

    An address that many rows have is read once.
    """
    told = once(parse(F.col("_address")), lambda p: F.struct(p.alias("parsed"), address_key(p).alias("address_key"), quality(p).alias("q")))
    each = settled(dealt(rows.select(F.col("address").alias("_address")).distinct(), "_address").withColumn("_a", told))
    out = rows.join(small(each), F.col("address").eqNullSafe(F.col("_address")))
    return settled(out.select(*rows.columns, "_a.parsed", "_a.address_key", "_a.q.score", "_a.q.tier", "_a.q.flags"))


def one_an_address(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Assessed candidates made one an ``address_key`` that ``existing`` (address_key) does not have; those without a key fall away.

    A client's name goes before a trip's; the first client, contact and phone that any of them has are kept. ``sources`` counts them.
    """
    new = rows.where("address_key is not null").join(existing.select("address_key").distinct(), "address_key", "left_anti")
    order = F.struct("n", "source_id")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v")))).getField("v").alias(c)
    best = F.min(F.struct(order.alias("o"), "name", "address", "source", "parsed")).alias("b")
    packed = new.groupBy("address_key").agg(best, first("client_id"), first("contact"), first("phone"), F.count("*").alias("sources"))
    return packed.select("address_key", "b.name", "b.address", "b.source", "b.parsed", "client_id", "contact", "phone", "sources")


def location_rows(rows: DataFrame) -> DataFrame:
    """Rows for the table of locations, without coordinates: those are for a search to find."""
    p = F.col("parsed")
    return rows.select(
        "client_id", F.substring("name", 1, 200).alias("name"), F.lit("client").alias("kind"), F.coalesce(p["street"], F.col("address")).alias("address"), p["city"].alias("city"), p["county"].alias("county"),
        p["postcode"].alias("postcode"), F.lit("RO").alias("country"), "address_key", "contact", "phone", F.lit("import").alias("geocode_source"), F.lit(False).alias("geocode_verified"),
    )


def summary(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """One row on the assessed candidates: all, distinct new addresses, merged, known already, unusable, mean score, and how many a tier."""
    known = existing.select("address_key").distinct().withColumn("_known", F.lit(True))
    per = rows.join(known, "address_key", "left")
    fresh = F.col("address_key").isNotNull() & F.col("_known").isNull()
    out = per.agg(
        F.count("*").alias("candidates"), F.count_distinct(F.when(fresh, F.col("address_key"))).alias("new_addresses"), F.count_if(fresh).alias("_fresh"), F.count_if(F.col("_known").isNotNull()).alias("skipped_existing"),
        F.count_if(F.col("address_key").isNull()).alias("unusable"), half_up(exact_sum(F.col("score")) / F.count("*"), 2).alias("average_score"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("good", "review", "poor")],
    )
    return out.withColumn("merged", F.col("_fresh") - F.col("new_addresses")).drop("_fresh")
