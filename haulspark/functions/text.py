"""Text rules: folding, similarity, plates, dates and routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they fold to, place by place.
MARKED = "ăâîșşțţáàäãåéèêëíìïóòôöõúùûüçñýÿ"
PLAIN = "aaissttaaaaaeeeeiiiooooouuuucnyy"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used, also in lambdas."""
    return F.transform(F.array(value), use)[0]


def fold(text: Column) -> Column:
    """Lower case, marks off, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def unmarked(text: Column) -> Column:
    """Lower case, marks off, runs of blanks one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the texts without case and marks; 0 if either is null or empty."""
    x, y = F.coalesce(unmarked(a), F.lit("")), F.coalesce(unmarked(b), F.lit(""))
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def hamming(a: Column, b: Column) -> Column:
    """Places in which texts of one length differ; 99 for other lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, d: s + d)).otherwise(99)


def canonical_plate(text: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def day_first_date(text: Column) -> Column:
    """Date of ``dd.mm.yyyy`` (or ``/``, ``-``), ISO, or a spreadsheet serial; null if the calendar has no such day."""
    t = F.trim(text)
    day_first = F.regexp_extract(t, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", 0) != ""
    part = lambda i: F.lpad(F.regexp_extract(t, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", i), 2, "0")
    year = F.regexp_extract(t, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", 3)
    serial = t.rlike(r"^\d{5}$")
    as_date = lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(day_first, as_date(F.concat_ws("-", year, part(2), part(1))))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), as_date(t))
        .when(serial, F.date_add(F.lit("1899-12-30").cast("date"), F.when(serial, t).otherwise("0").cast("int")))
    )


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of ``h``, ``h:mm`` or a fraction of a day; null if there is no such time."""
    t = F.trim(text)
    h, m = F.regexp_extract(t, r"^(\d{1,2})(?::(\d{2}))?$", 1).try_cast("int"), F.coalesce(F.regexp_extract(t, r"^(\d{1,2})(?::(\d{2}))?$", 2).try_cast("int"), F.lit(0))
    fraction = F.regexp_extract(t, r"^0?\.\d+$", 0).try_cast("double")
    return F.when((h <= 23) & (m <= 59), h * 60 + m).when(fraction.isNotNull(), F.floor(fraction * 1440 + 0.5).cast("int"))


def route_legs(text: Column) -> Column:
    """Places of a route text, split at arrows, spaced dashes and slashes."""
    parts = F.split(F.trim(text), r"\s*(?:->|→|/|\s[-–—]\s)\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def norm_key(text: Column) -> Column:
    """Lower case and trimmed; null for blanks."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def minutes_clock(minutes: Column) -> Column:
    """``HH:MM`` of minutes since midnight, of any day; null stays null."""
    m = F.pmod(minutes.cast("long"), F.lit(1440))
    return F.when(minutes.isNotNull(), F.format_string("%02d:%02d", F.floor(m / 60), m % 60))


# Digits that a scan takes for each other in a year.
YEAR_SWAPS = {"0": "6", "6": "04", "4": "6"}


def resolved_date(day: Column, month: Column, year: Column, today: Column) -> Column:
    """``date, confidence, repaired`` of the parts of a printed date, as near to ``today`` as its digits allow.

    Years of two digits are of this century, 200 to 209 have lost their last digit. A date from 400 days back to
    tomorrow stands; else one swap of digits that scans confuse may bring its year in, the nearest to today's. A date
    that no swap helps is kept as it is. Null if the parts cannot be a date.
    """
    parts = F.struct(day.alias("day"), month.alias("month"), year.alias("year"))
    return once(parts, lambda p: _resolved(p["day"], p["month"], p["year"], today))


def _resolved(day: Column, month: Column, year: Column, today: Column) -> Column:
    cut = year.between(200, 209)
    full = F.when(year < 100, year + 2000).when(cut, year * 10 + F.year(today) % 10).otherwise(year)
    return once(full, lambda y: _of_year(day, month, year, y, cut, today))


def _of_year(day: Column, month: Column, year: Column, y: Column, cut: Column, today: Column) -> Column:
    valid = day.between(1, 31) & month.between(1, 12) & y.between(1990, 2100)
    written = lambda v: F.format_string("%04d-%02d-%02d", v.cast("int"), month.cast("int"), day.cast("int"))
    low, high = F.date_format(F.date_add(today, -400), "yyyy-MM-dd"), F.date_format(F.date_add(today, 1), "yyyy-MM-dd")
    fits = lambda v: written(v).between(low, high)

    def swapped(digits: Column, at: int, old: str, new: str) -> Column:
        there = F.substring(digits, at, 1) == old
        return F.when(there, F.concat(F.substring(digits, 1, at - 1), F.lit(new), F.substring(digits, at + 1, 4)).cast("int"))

    every = once(y.cast("int").cast("string"), lambda digits: F.array(*[swapped(digits, at, old, new) for at in range(1, 5) for old, options in YEAR_SWAPS.items() for new in options]))
    others = F.filter(every, lambda v: v.isNotNull() & fits(v))
    nearest = F.array_min(F.transform(others, lambda v: F.struct(F.abs(v - F.year(today)).alias("far"), v.alias("year"))))["year"]
    made = lambda v, confidence, repaired: F.struct(written(v).alias("date"), confidence.cast("double").alias("confidence"), repaired.alias("repaired"))
    return (
        F.when(~valid | day.isNull() | month.isNull() | year.isNull(), F.lit(None))
        .when(fits(y), made(y, F.when(cut, 0.55).otherwise(0.9), cut))
        .otherwise(once(nearest, lambda best: F.when(best.isNotNull(), made(best, F.lit(0.55), F.lit(True))).otherwise(made(y, F.when(cut, 0.5).otherwise(0.9), cut))))
    )


# Mail providers whose addresses are a person's and not a firm's.
PERSONAL_DOMAINS = (
    "aol.com", "gmail.com", "googlemail.com", "gmx.com", "gmx.de", "gmx.net", "hotmail.com", "icloud.com", "live.com", "mac.com", "mail.com", "mail.ru", "me.com", "msn.com", "outlook.com",
    "proton.me", "protonmail.com", "yahoo.co.uk", "yahoo.com", "yahoo.ro", "yandex.com", "yandex.ru", "ymail.com", "zoho.com",
)


def email_kind(email: Column) -> Column:
    """``domain, personal, valid`` of a mail address, trimmed and in lower case."""
    clean = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    domain = F.regexp_extract(clean, "^.+@([^@]*)$", 1)
    return F.struct(domain.alias("domain"), domain.isin(*PERSONAL_DOMAINS).alias("personal"), clean.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$").alias("valid"))
