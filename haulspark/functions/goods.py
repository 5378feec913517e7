"""Goods of a document: packaging units and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulspark.functions.numeric import half_up
from haulspark.functions.text import MARKED, PLAIN

# Units as they are printed and as they are written.
UNITS = {
    "sac": "saci", "saci": "saci", "galeti": "galeti", "galeata": "galeti", "galeate": "galeti", "paleti": "paleti", "palet": "paleti", "palete": "paleti",
    "bucati": "bucati", "buc": "bucati", "pcs": "bucati", "kg": "kg", "role": "role", "colete": "colete", "mc": "m³", "m3": "m³",
}
MIXED = {"saci/galeti": "saci / galeti", "galeti/saci": "saci / galeti", "saci/bucati": "saci / bucati", "bucati/saci": "saci / bucati"}
STARTS = {"sac": "saci", "gal": "galeti", "pal": "paleti", "buc": "bucati"}


def goods_unit(text: Column) -> Column:
    """The packaging unit that ``text`` is, or null: two units at once, an alias, else by its beginning."""
    folded = F.translate(F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("³"), F.lit("3")), MARKED, PLAIN)
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    by_start = F.when(F.lit(False), F.lit(None).cast("string"))
    for start, unit in STARTS.items():
        by_start = by_start.when(folded.startswith(start), unit)
    return F.coalesce(F.try_element_at(table(MIXED), F.regexp_replace(folded, r"\s+", "")), F.try_element_at(table(UNITS), folded), by_start)


def only_counts(unit: Column) -> Column:
    """Whether a unit says how many and not what."""
    return F.lower(F.trim(F.coalesce(unit, F.lit("")))).rlike(r"^(buc|bucati|bucăți|bucati\.|pcs|pce|pc)$")


def annex_amount(value: Column, km: Column, tariff: Column, rule: str) -> Column:
    """A run's amount: by ``km_tarif`` kilometres times tariff, else the order's value; what is missing counts 0."""
    if rule == "km_tarif":
        return half_up(F.coalesce(km, F.lit(0.0)) * F.coalesce(tariff, F.lit(0.0)), 2)
    return F.coalesce(value, F.lit(0.0))
