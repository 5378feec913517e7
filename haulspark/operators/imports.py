"""Import of orders from spreadsheets: every row is parsed, matched and judged; nothing is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.numeric import locale_number
from haulspark.functions.text import clock_minutes, day_first_date, fold

# How the kinds of order are written.
KINDS = {
    "livrare": ["livrare", "livrari", "delivery", "l"],
    "ridicare": ["ridicare", "colectare", "pickup", "r"],
    "schimb": ["schimb", "exchange", "s"],
}


def order_kind(text: Column) -> Column:
    """Kind of an order; a blank is a delivery, an unknown word null."""
    folded = fold(F.coalesce(text, F.lit("")))
    known = reduce(lambda c, kv: c.when(folded.isin(kv[1]), kv[0]), KINDS.items(), F.when(folded == "", "livrare"))
    return known


def _flags(*pairs: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in pairs]), lambda x: x.isNotNull())


def import_plan(rows: DataFrame, locations: DataFrame, clients: DataFrame, existing: DataFrame, default_date: str | None = None) -> DataFrame:
    """``row_no, order_number, ..., errors, warnings, action`` of rows read from a spreadsheet (with ``row_no``).

    A location is the one whose folded name is unique; a name that several have is an error, as is none. Unreadable
    clocks and numbers, and unknown clients, are warnings; negative numbers and windows that end before they begin
    are errors. A number that exists already, or stands earlier in the file, is skipped. Actions: create, skip, error.
    """
    names = locations.groupBy(fold(F.col("name")).alias("_key")).agg(F.count("*").alias("_places"), F.min("location_id").alias("_location"))
    known = clients.groupBy(fold(F.col("name")).alias("_client_key")).agg(F.min("client_id").alias("_client"))
    old = existing.select(F.trim("order_number").alias("_old")).distinct()
    c = F.col
    out = rows.withColumns({"_key0": fold(c("location_name")), "_client0": fold(c("client_name")), "_number": F.trim("order_number")})
    out = out.join(names, c("_key0") == c("_key"), "left").join(known, c("_client0") == c("_client_key"), "left").join(old, c("_number") == c("_old"), "left")
    fallback = F.lit(default_date).cast("date")
    read = day_first_date(c("requested_date"))
    numbers = {f: locale_number(c(f)) for f in ("weight_kg", "volume_mc", "pallets", "service_time_min")}
    start, end = clock_minutes(c("window_start")), clock_minutes(c("window_end"))
    seen = F.row_number().over(Window.partitionBy("_number").orderBy("row_no"))
    parsed = out.withColumns(
        {
            "kind": order_kind(c("type")), "order_date": F.coalesce(read, fallback), "opens": start, "closes": end, "location_id": F.when(c("_places") == 1, c("_location")), "client_id": c("_client"),
            **{f"n_{f}": n for f, n in numbers.items()}, "_seen": F.when(c("_number").isNotNull(), seen),
        }
    )
    errors = _flags(
        ("number_missing", c("_number").isNull()), ("date_missing", c("order_date").isNull()), ("kind_unknown", c("kind").isNull()),
        ("location_missing", c("location_name").isNull()), ("location_ambiguous", c("_places") > 1), ("location_unknown", c("location_name").isNotNull() & c("_places").isNull()),
        ("window_reversed", c("opens") >= c("closes")), *[(f"{f}_negative", c(f"n_{f}") < 0) for f in numbers],
    )
    warnings = _flags(
        ("date_defaulted", c("requested_date").isNotNull() & day_first_date(c("requested_date")).isNull() & fallback.isNotNull()), ("client_unknown", c("client_name").isNotNull() & c("client_id").isNull()),
        ("opens_unreadable", c("window_start").isNotNull() & c("opens").isNull()), ("closes_unreadable", c("window_end").isNotNull() & c("closes").isNull()),
        *[(f"{f}_unreadable", c(f).isNotNull() & c(f"n_{f}").isNull()) for f in numbers],
    )
    judged = parsed.withColumns({"errors": errors, "warnings": warnings})
    action = F.when(F.size("errors") > 0, "error").when(c("_old").isNotNull() | (c("_seen") > 1), "skip").otherwise("create")
    positive = lambda f, rest: F.coalesce(F.when(c(f"n_{f}") >= 0, c(f"n_{f}")), F.lit(rest))
    return judged.withColumn("action", action).select(
        "row_no", c("_number").alias("order_number"), "client_id", "location_id", F.coalesce("kind", F.lit("livrare")).alias("kind"), "order_date", "opens", "closes",
        F.floor(positive("service_time_min", 15.0) + 0.5).cast("int").alias("service_min"), positive("weight_kg", 0.0).alias("weight_kg"), positive("volume_mc", 0.0).alias("volume_mc"),
        F.floor(positive("pallets", 0.0) + 0.5).cast("int").alias("pallets"), "errors", "warnings", "action",
    )


def import_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("rows"), F.sum(F.size("warnings")).alias("warnings"))
