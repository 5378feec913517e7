"""Lines of imports matched to places by name, else by address; needs of a route that its vehicle does not meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.address import address_key, parse
from haulspark.functions.text import fold, once
from haulspark.operators.grouped import as_told, dealt


def missing_requirements(needs: Column, has: Column) -> Column:
    """Needs that are not among the capabilities, in any case of letters; each once, as it is first spelled, in their order."""
    low = lambda xs: F.transform(F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.lower(x))
    kept = F.filter(F.coalesce(needs, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.filter(kept, lambda x, i: ~F.array_contains(low(has), F.lower(x)) & ~F.array_contains(F.slice(low(needs), F.lit(1), i), F.lower(x)))


def match_locations(lines: DataFrame, locations: DataFrame) -> DataFrame:
    """``id, location_id, reason`` of lines (id, location_name, address, city) among active ``locations`` (location_id, name, address, is_active, pos).

    A folded name that one location has decides (``nume``); one that several have matches none of them (``nume_ambiguu``). Else the address's key decides, the first location by ``pos`` that has it
    (``adresa``); a town given apart is put before an address that does not name it. What was given and not found is ``negasit``, nothing given ``lipsa``.
    """
    keyed = lambda address: once(parse(address), address_key)
    named = F.struct(F.nullif(fold(F.coalesce("name", F.lit(""))), F.lit("")).alias("name"), keyed(F.coalesce("address", F.lit(""))).alias("key"))
    active = dealt(locations.where(F.coalesce("is_active", F.lit(True))), "location_id").select("location_id", "pos", as_told(named, "t")).select("location_id", "pos", "t.*")
    names = active.where("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("location_id").alias("named"))
    keys = active.where("key is not null").groupBy("key").agg(F.min(F.struct("pos", "location_id"))["location_id"].alias("placed"))
    address, city = F.trim(F.coalesce("address", F.lit(""))), fold(F.coalesce("city", F.lit("")))
    whole = F.when((city != "") & ~F.contains(fold(address), city), F.concat_ws(", ", "city", address)).otherwise(address)
    asked = F.struct(F.nullif(fold(F.coalesce("location_name", F.lit(""))), F.lit("")).alias("name"), once(keyed(whole), lambda key: F.when(address != "", key)).alias("key"), (address != "").alias("given"))
    told = dealt(lines, "id").select("id", as_told(asked, "t")).select("id", "t.*")
    both = told.join(names.hint("merge"), "name", "left").join(keys.hint("merge"), "key", "left")
    by_name, unclear = F.col("n") == 1, F.coalesce(F.col("n") > 1, F.lit(False))
    reason = F.when(unclear, "nume_ambiguu").when(by_name, "nume").when(F.col("placed").isNotNull(), "adresa").when(F.col("name").isNotNull() | F.col("given"), "negasit").otherwise("lipsa")
    return both.select("id", F.when(~unclear, F.when(by_name, F.col("named")).otherwise(F.col("placed"))).alias("location_id"), reason.alias("reason"))
