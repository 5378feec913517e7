"""Number rules: half-up rounding in doubles, percentages, rates, sums of money."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Round half towards plus infinity in double arithmetic; null stays null."""
    scale = float(10**places)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; null unless ``whole`` is positive."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10)


def rate(part: Column, whole: Column) -> Column:
    """Share with three decimals; null unless ``whole`` is positive."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 1000)


def number_or_null(text: Column) -> Column:
    """A finite number, or null for blanks and anything else."""
    x = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def exact_sum(x: Column, places: int = 4, over: WindowSpec | None = None) -> Column:
    """Sum through decimals, so that the order of rows does not show in the last bits; of a window's rows, if one is given."""
    total = F.sum(x.cast(f"decimal(28,{places})"))
    return (total if over is None else total.over(over)).cast("double")


def vat_rate(regime: Column, company_rate: Column, fallback: float = 19.0) -> Column:
    """No tax for exempt regimes, else the company's rate or the fallback."""
    return F.when(F.lower(regime).isin("neplatitor", "scutit"), 0.0).otherwise(F.coalesce(company_rate, F.lit(fallback)))


def locale_number(text: Column) -> Column:
    """Number of a spreadsheet cell: the rightmost separator is the decimal one, a lone ``.ddd`` groups thousands.

    Several commas and no point, or anything but digits, separators, spaces and a sign, give null.
    """
    t = F.regexp_replace(F.trim(text), r"[\s ]", "")
    dots, commas = F.length(t) - F.length(F.replace(t, F.lit("."))), F.length(t) - F.length(F.replace(t, F.lit(",")))
    last_dot, last_comma = F.length(t) - F.instr(F.reverse(t), "."), F.length(t) - F.instr(F.reverse(t), ",")
    comma_decimal = F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit("."))
    point_decimal = F.replace(t, F.lit(","))
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(last_comma > last_dot, comma_decimal).otherwise(point_decimal))
        .when(commas == 1, comma_decimal)
        .when(commas > 1, F.lit(None))
        .when((dots == 1) & t.rlike(r"^-?[0-9]{1,3}\.[0-9]{3}$"), F.replace(t, F.lit(".")))
        .when((dots > 1) & t.rlike(r"\.[0-9]{3}$"), F.replace(t, F.lit(".")))
        .when(dots > 1, F.concat(F.replace(F.regexp_extract(t, r"^(.*)\.[^.]*$", 1), F.lit(".")), F.lit("."), F.regexp_extract(t, r"\.([^.]*)$", 1)))
        .otherwise(t)
    )
    return F.when(t.rlike(r"^-?[0-9.,]+$"), plain.try_cast("double"))


def document_number(text: Column) -> Column:
    """Number of a printed document: with both separators the later is decimal, a lone comma is; nothing is stripped."""
    t = F.trim(text)
    last_dot, last_comma = F.length(t) - F.instr(F.reverse(t), "."), F.length(t) - F.instr(F.reverse(t), ",")
    both = t.contains(".") & t.contains(",")
    plain = (
        F.when(both & (last_comma > last_dot), F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit(".")))
        .when(both, F.replace(t, F.lit(",")))
        .otherwise(F.regexp_replace(t, "^([^,]*),", "$1."))
    )
    return plain.try_cast("double")
