"""Streets looked up by what people type: exactly, then without the kind of street, then by the words they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.text import MARKED, PLAIN

# Kinds of street and how they are shortened.
KINDS = {
    "bulevardul": ("bulevardul", "bulevard", "b-dul", "bdul", "b dul", "bd", "bvd", "blvd", "bld"), "soseaua": ("soseaua", "sosea", "sos"), "calea": ("calea", "cal"), "strada": ("strada", "str"), "piata": ("piata", "pta", "pt"),
    "aleea": ("aleea", "al"), "intrarea": ("intrarea", "intrare", "intr", "int"), "splaiul": ("splaiul", "spl"), "drumul": ("drumul", "dr"), "prelungirea": ("prelungirea", "prel"), "pasajul": ("pasajul", "pasaj"),
}
#: Streets that are weighed when only words of the name match.
MOST_SUGGESTED = 6


def street_key(text: Column) -> Column:
    """Lower case without marks, points and commas, the kind of street at its beginning written out."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[.,]", " "), r"\s+", " "))
    for kind, spelled in KINDS.items():
        key = F.regexp_replace(key, rf"^(?:{'|'.join(spelled)}) (?=\S)", f"{kind} ")
    return key


def bare_name(key: Column) -> Column:
    """A key without its kind of street."""
    return F.regexp_replace(key, rf"^(?:{'|'.join(KINDS)}) (?=\S)", "")


def house_number(text: Column) -> Column:
    """A number at the end of what was typed, that may be of a house: ``street, number``; null without one."""
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    pattern = r"(?i)^(.*?\p{L}.*?)[\s,]+(?:nr\.?\s*)?([0-9]{1,5}[a-z]?(?:[-/][0-9]{1,5}[a-z]?)?)$"
    return F.when(tidy.rlike(pattern), F.struct(F.trim(F.regexp_extract(tidy, pattern, 1)).alias("street"), F.regexp_extract(tidy, pattern, 2).alias("number")))


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _by_words(asked: DataFrame, streets: DataFrame) -> DataFrame:
    """(city, key) of asked names against streets whose key holds every typed word of two letters and more: the nearest in length, ``MOST_SUGGESTED`` of each.

    The inverted index has every run of two and three letters of a key. A name meets only the streets under its rarest run, and none if one of its runs
    stands in no key; so a word that most streets share costs nothing. The index is many times its streets, which a planner that goes by the size of files
    does not see: it is joined by shuffle and sent to no driver.
    """
    index = streets.select("city", "street_id", F.explode(F.array_distinct(F.concat(_grams(F.col("key"), 2), _grams(F.col("key"), 3)))).alias("gram"))
    often = index.groupBy("city", "gram").agg(F.count("*").alias("n"))
    words = F.filter(F.split("key", " "), lambda w: F.length(w) >= 2)
    typed = asked.select("ask", "city", words.alias("words")).where(F.size("words") > 0)
    runs = F.flatten(F.transform("words", lambda w: F.when(F.length(w) == 2, F.array(w)).otherwise(_grams(w, 3))))
    runs = typed.withColumn("gram", F.explode(F.array_distinct(runs))).withColumn("runs", F.lit(1)).join(often.hint("merge"), ["city", "gram"], "left")
    best = runs.groupBy("ask", "city", "words").agg(F.count("*").alias("all"), F.count("n").alias("known"), F.min(F.struct("n", "gram")).alias("rarest")).where(F.col("all") == F.col("known"))
    met = best.select("ask", "city", "words", F.col("rarest.gram").alias("gram")).join(index.hint("merge"), ["city", "gram"]).join(streets.select("street_id", "city", "key", "zones").hint("merge"), ["city", "street_id"])
    held = met.where(F.forall("words", lambda w: F.contains(F.col("key"), w)))
    extra = F.length("key") - F.aggregate("words", F.lit(0), lambda s, w: s + F.length(w))
    order = Window.partitionBy("ask").orderBy(extra, "key")
    return held.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= MOST_SUGGESTED).select("ask", "street_id", "zones", "pos")


def _settled(candidates: DataFrame) -> DataFrame:
    """One answer a name: the first candidate if all lie in the same zones, else none."""
    told = candidates.groupBy("ask").agg(F.count("*").alias("candidates"), F.min("zones").alias("_low"), F.max("zones").alias("_high"), F.min(F.struct("pos", "street_id")).alias("_first"))
    same = F.col("_low") == F.col("_high")
    return told.select("ask", F.when(same, "without-type").otherwise("ambiguous").alias("status"), F.when(same, F.col("_first.street_id")).alias("street_id"), "candidates")


def lookup_streets(asked: DataFrame, streets: DataFrame) -> DataFrame:
    """``id, status, street_id, candidates, house_number`` of what was typed (id, city, text) among ``streets`` (street_id, city, name, zones; a name once a city).

    The status is exact; without-type, if the kind of street was left out or only words of the name were typed and all such streets lie in the same zones (``zones`` as text, empty for none); ambiguous,
    if they do not; or unknown. A number at the end is a house's only if no street has the whole name, as streets may be named by one.
    """
    known = streets.select("street_id", "city", F.coalesce("zones", F.lit("")).alias("zones"), street_key(F.col("name")).alias("key")).withColumn("bare", bare_name(F.col("key")))
    split = house_number(F.col("text"))
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("text").alias("street"), F.lit(None).cast("string").alias("number")), F.struct(F.lit(1).alias("way"), split["street"].alias("street"), split["number"].alias("number")))
    typed = asked.select("id", "city", F.explode(F.filter(ways, lambda w: w["street"].isNotNull())).alias("w")).select("id", "city", "w.*").withColumn("ask", F.struct("id", "way")).withColumn("key", street_key(F.col("street"))).where("key <> ''").withColumn("bare", bare_name(F.col("key")))
    exact = typed.join(known.select("city", "key", "street_id").hint("merge"), ["city", "key"]).select("ask", F.lit("exact").alias("status"), "street_id", F.lit(1).cast("long").alias("candidates"))
    rest = typed.join(exact.select("ask").hint("merge"), "ask", "left_anti")
    named = _settled(rest.join(known.select("city", "bare", "street_id", "zones").hint("merge"), ["city", "bare"]).select("ask", "street_id", "zones", F.col("street_id").alias("pos")))
    named = named.withColumn("status", F.when(F.col("candidates") == 1, "without-type").otherwise(F.col("status")))
    last = rest.join(named.select("ask").hint("merge"), "ask", "left_anti")
    worded = _settled(_by_words(last, known))
    whole = exact.select("*", F.lit(0).alias("found")).unionByName(named.select("*", F.lit(0).alias("found"))).unionByName(worded.select("*", F.lit(1).alias("found")))
    # the whole text as a name, then the text before a number, then words of the whole
    rank = F.when((F.col("ask.way") == 0) & (F.col("found") == 0), 0).when(F.col("ask.way") == 1, 1).otherwise(2)
    best = whole.groupBy(F.col("ask.id").alias("id")).agg(F.min(F.struct(rank.alias("rank"), "ask.way", "status", "street_id", "candidates")).alias("b"))
    number = F.when(F.col("b.rank") == 1, split["number"])
    return asked.join(best.hint("merge"), "id", "left").select("id", F.coalesce("b.status", F.lit("unknown")).alias("status"), "b.street_id", F.coalesce("b.candidates", F.lit(0)).alias("candidates"), number.alias("house_number"))
