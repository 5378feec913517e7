"""Addresses learned from documents: sightings merged into a stored table, and stops that lost their street filled from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.scans import once
from haulspark.functions.text import unmarked
from haulspark.operators.joins import trusted
from haulspark.operators.lifecycle import merged_into

# How alike a garbled street must be, how far ahead of the next, and words of firms that are no streets.
LEAST_ALIKE, LEAST_AHEAD = 0.6, 0.15
FIRM_WORDS = ("srl", "s r l", "sa", "snc", "scs", "ltd", "gmbh", "pfa")
LABEL_WORDS = ("expeditor", "site", "depozit", "depozite", "pagina", "romania", "strada", "sosea", "soseaua", "bulevardul", "calea", "aleea", "numar", "adresa", "livrare", "aviz", "client", "factura", "sucursala", "bucuresti", "sector", "construct", "build")
ORIGIN, DELIVERY = "origin", "delivery"
ADDRESS = "id string, role string, postcode string, match_key string, locality string, street_name string, display string, source string, first_at timestamp, last_seen_at timestamp, verified boolean, disabled boolean, merged_into string"
_OWN = ("role", "postcode", "match_key", "locality", "street_name", "display", "source", "first_at", "verified", "disabled", "merged_into")


def address_id(role: Column, postcode: Column, match_key: Column) -> Column:
    return F.concat_ws("|", role, postcode, match_key)


def remember(addresses: DataFrame, seen: DataFrame, sightings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(addresses, seen) after ``sightings`` (doc_id, role, postcode, match_key, locality, street_name, display, source, at) are added to them.

    An address is its role, postcode and match key; what is printed of it stays as it was first seen. A person's spelling lifts a parsed row's source and is never
    lowered again. ``seen`` has one row an address and document, however often the document says it, so that a second reading counts nothing.
    Sightings without a postcode or display are none. Parts added one after the other, in order of time, give what all at once give.
    """
    told = sightings.where(F.col("postcode").isNotNull() & (F.coalesce(F.trim("display"), F.lit("")) != "")).withColumn("id", address_id(F.col("role"), F.col("postcode"), F.col("match_key")))
    person = F.when(F.col("source") != "parsed", F.struct("at", "doc_id", "source"))
    new = told.groupBy("id").agg(F.min(F.struct("at", "doc_id", "role", "postcode", "match_key", "locality", "street_name", "display")).alias("f"), F.max("at").alias("last"), F.min(person).alias("p"))
    both = addresses.join(new, "id", "full_outer")
    known = F.col("role").isNotNull()
    source = F.when(F.coalesce(F.col("source"), F.lit("parsed")) == "parsed", F.coalesce("p.source", "source", F.lit("parsed"))).otherwise(F.col("source"))
    value = {c: F.when(known, F.col(c)).otherwise(F.col(f"f.{c}")) for c in ("role", "postcode", "match_key", "locality", "street_name", "display")}
    value |= {"source": source, "first_at": F.coalesce("first_at", "f.at"), "last_seen_at": F.greatest("last_seen_at", "last"), "verified": F.coalesce("verified", F.lit(False)), "disabled": F.coalesce("disabled", F.lit(False)), "merged_into": F.col("merged_into")}
    merged = both.select("id", *[c.alias(n) for n, c in value.items()])
    return merged, seen.select("id", "doc_id").unionByName(told.select("id", "doc_id")).distinct()


def known_addresses(addresses: DataFrame, seen: DataFrame) -> DataFrame:
    """Addresses in use with ``seen_count``, the documents that show them or a misreading that was merged into them, and the newest of those.

    Merges are followed to their end; a document that shows an address in two spellings counts once.
    """
    final = merged_into(addresses.select("id", "merged_into", "last_seen_at"), "id", "merged_into").select("id", F.col("final_id").alias("final"), "last_seen_at")
    counts = seen.join(final.select("id", "final"), "id").select("final", "doc_id").distinct().groupBy("final").agg(F.count("*").alias("seen_count"))
    last = final.groupBy("final").agg(F.max("last_seen_at").alias("last_seen_at"))
    used = addresses.where(F.col("merged_into").isNull() & ~F.coalesce("disabled", F.lit(False))).drop("last_seen_at")
    return used.join(counts, used.id == counts.final, "left").drop("final").join(last, used.id == last.final, "left").drop("final").withColumn("seen_count", F.coalesce("seen_count", F.lit(0)))


def plausible_leg(display: Column) -> Column:
    """Whether a parsed address reads like one: no firm's name, a house number that is one, a town of letters."""
    folded = F.regexp_replace(unmarked(display), "[^a-z0-9]+", " ")
    house, town = F.regexp_extract(display, r"(?i)\bnr\.?\s*([^\s,]+)", 1), F.trim(F.coalesce(F.get(F.split(display, ", ", 2), F.lit(1)), F.lit("")))
    return (
        ~folded.rlike(rf"(?:^| )(?:{'|'.join(FIRM_WORDS)})(?: |$)")
        & ((house == "") | house.rlike(r"(?i)^[0-9]{1,4}[a-z]{0,2}(?:[-/][0-9a-z]{1,6})?$"))
        & ((town == "") | town.rlike(r"^\p{L}[\p{L} .-]*$"))
    )


def street_hints(section: Column, locality: Column) -> Column:
    """Words that may be left of a street in a section of a page: of four letters and more, no labels, not of the town."""
    words, town = F.split(unmarked(F.coalesce(section, F.lit(""))), "[^a-z]+"), F.split(unmarked(F.coalesce(locality, F.lit(""))), r"[\s-]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*LABEL_WORDS) & ~F.array_contains(town, w)))


def fill_stops(stops: DataFrame, known: DataFrame) -> DataFrame:
    """What memory makes of each stop (doc_id, stop_no, role, street_name, postcode, locality, hints: words that are left of its street).

    Adds ``result`` (used, refused or skipped), ``reason``, ``address_id``, ``filled`` (its display), ``candidates``, ``best`` and ``runner_up``. A stop whose street was read is left alone. Of the trusted addresses on its postcode,
    in its town where both are known, one stands; of several, those a person gave are preferred, and the one that a hint resembles clearly is taken. A depot is no delivery. Addresses of one role and postcode
    are one array, so stops are neither multiplied nor shuffled by their own ids.
    """
    depots = known.where(F.col("role") == ORIGIN).select("postcode", "match_key").distinct()
    rows = known.where(F.col("role") != DELIVERY).unionByName(known.where(F.col("role") == DELIVERY).join(depots, ["postcode", "match_key"], "left_anti").select(*known.columns))
    human = F.coalesce("verified", F.lit(False)) | F.col("source").isin("corrected", "manual")
    entry = F.struct(
        (-F.col("seen_count")).alias("often"), F.col("id"), F.col("display"), F.nullif(unmarked(F.coalesce("locality", F.lit(""))), F.lit("")).alias("town"), human.alias("human"), trusted(F.col("disabled"), F.col("verified"), F.col("source"), F.col("seen_count")).alias("trusted"),
        (human | plausible_leg(F.col("display"))).alias("usable"), F.filter(F.split(unmarked(F.coalesce("street_name", F.lit(""))), " "), lambda w: F.length(w) >= 3).alias("words"),
    )
    arrays = rows.groupBy("role", "postcode").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    joined = stops.join(arrays, ["role", "postcode"], "left")
    town = F.nullif(unmarked(F.coalesce("locality", F.lit(""))), F.lit(""))
    hints = F.coalesce(F.transform("hints", unmarked), F.array().cast("array<string>"))
    alike = lambda a, b: F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    score = lambda words: F.coalesce(F.array_max(F.flatten(F.transform(words, lambda w: F.transform(hints, lambda h: alike(w, h))))), F.lit(0.0))
    staged = joined.withColumn("_trusted", F.filter(F.coalesce("_all", F.array().cast(arrays.schema["_all"].dataType)), lambda a: a["trusted"]))
    staged = staged.withColumn("_town", F.filter("_trusted", lambda a: town.isNull() | a["town"].isNull() | (a["town"] == town)))
    staged = staged.withColumn("_usable", F.filter("_town", lambda a: a["usable"]))
    people = lambda pool: once(F.filter(pool, lambda a: a["human"]), lambda h: F.when(F.size(h) > 0, h).otherwise(pool))
    staged = staged.withColumn("_pool", people(F.col("_usable")))
    staged = staged.withColumn("_ranked", F.array_sort(F.transform("_pool", lambda a, i: F.struct((-score(a["words"])).alias("score"), i.alias("i"), a["id"].alias("id"), a["display"].alias("display")))))
    one, two = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    several = F.size("_pool") > 1
    skipped = F.coalesce(F.trim("street_name"), F.lit("")) != ""
    reason = (
        F.when(skipped, "street_read").when(F.col("postcode").isNull(), "no_postcode").when(F.col("_all").isNull(), "unknown_postcode").when(F.size("_trusted") == 0, "no_trusted")
        .when(F.size("_town") == 0, "locality_mismatch").when(F.size("_usable") == 0, "junk_filtered").when(several & (-one["score"] < LEAST_ALIKE), "below_threshold").when(several & (two["score"] - one["score"] < LEAST_AHEAD), "ambiguous")
    )
    told = staged.withColumn("reason", reason)
    weighed = F.col("reason").isNull() | F.col("reason").isin("below_threshold", "ambiguous")
    counted = F.when(skipped | F.col("postcode").isNull() | F.col("_all").isNull(), 0).when(weighed, F.size("_pool")).otherwise(F.size("_all"))
    return told.select(
        *stops.columns, F.when(skipped, "skipped").when(F.col("reason").isNull(), "used").otherwise("refused").alias("result"), "reason", F.when(F.col("reason").isNull(), one["id"]).alias("address_id"), F.when(F.col("reason").isNull(), one["display"]).alias("filled"),
        counted.alias("candidates"), F.when(weighed & several, F.floor(-one["score"] * 100 + 0.5) / 100).alias("best"), F.when(weighed & several, F.floor(-two["score"] * 100 + 0.5) / 100).alias("runner_up"),
    )
