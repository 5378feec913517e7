"""Keeping tables: upserts into a target, retention, trails of changes, rows as they are sent."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.operators.joins import keep_newest


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column], update: bool = True) -> DataFrame:
    """``target`` after ``rows`` are written to it: of rows that share a key the first in ``order`` counts.

    With ``update`` a known key takes the new row, else it keeps its own; new keys are added either way. A key with a null in it is like no other,
    as a unique constraint has it: such rows are all added and replace none. Other keys must be unique in ``target``, and its columns among those of ``rows``.
    """
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    new = keep_newest(rows.where(whole), keys, order).select(*target.columns)
    lone = rows.where(~whole).select(*target.columns)
    if update:
        kept = target.join(new.select(*keys), list(keys), "left_anti").select(*target.columns)
        return kept.unionByName(new).unionByName(lone)
    return target.unionByName(new.join(target.select(*keys), list(keys), "left_anti").select(*target.columns)).unionByName(lone)


@dataclass(frozen=True)
class Policy:
    """Rows of ``table`` whose ``instant`` is more than ``days`` back are dropped, but for those that ``keep`` tells."""

    table: str
    instant: str
    days: int
    keep: str | None = None

    def old(self, now: str, days: int | None = None) -> Column:
        age = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days if days and days > 0 else self.days))
        old = F.coalesce(F.col(self.instant) < age, F.lit(False))
        return old if self.keep is None else old & ~F.coalesce(F.expr(self.keep), F.lit(False))


# What is dropped, and after how many days.
POLICIES = (
    Policy("telematics_positions", "recorded_at", 90),
    Policy("gps_logs", "created_at", 30, "is_current"),
    Policy("chat_messages", "created_at", 365),
    Policy("office_notification_dismissals", "dismissed_at", 180),
    Policy("refresh_tokens", "expires_at", 30),
    Policy("geocode_cache", "updated_at", 730),
)


def retention_preview(tables: Mapping[str, DataFrame], now: str, days: Mapping[str, int] | None = None, batch: int = 5000) -> DataFrame:
    """``id, days, old_rows, deleted, more`` of each policy: what a run of ``batch`` rows would drop, by the run's own condition."""
    told, out = days or {}, None
    for p in POLICIES:
        n = told.get(p.table) if (told.get(p.table) or 0) > 0 else p.days
        row = tables[p.table].agg(F.count_if(p.old(now, n)).alias("old_rows")).select(F.lit(p.table).alias("id"), F.lit(n).alias("days"), "old_rows")
        out = row if out is None else out.unionByName(row)
    return out.withColumns({"deleted": F.least("old_rows", F.lit(batch).cast("long")), "more": F.col("old_rows") >= batch})


def retained_by(policy: Policy, rows: DataFrame, now: str, days: int | None = None) -> DataFrame:
    """What a table holds once a policy has run to its end."""
    return rows.where(~policy.old(now, days))


# Fields that are no part of a trail, fields whose values are hidden, and the longest value written out.
NOISE = ("updated_at", "created_at", "id", "company_id")
SECRET = "(?i)pass|token|secret|hash|api[_-]?key|credential|signature"
LONGEST = 500


def _is_secret(field: str) -> bool:
    return re.search(SECRET, field) is not None


def presented(field: str, value: Column) -> Column:
    """A value as a trail shows it: secrets hidden, long texts as their length."""
    if _is_secret(field):
        return F.lit("«ascuns»")
    text = value.cast("string")
    return F.when(F.length(text) > LONGEST, F.concat(F.lit("«"), F.length(text).cast("string"), F.lit(" caractere»"))).otherwise(text)


def same_value(a: Column, b: Column) -> Column:
    """Equal, or equal as numbers; an emptied field is no zero."""
    x, y = F.trim(a.cast("string")).try_cast("double"), F.trim(b.cast("string")).try_cast("double")
    return a.cast("string").eqNullSafe(b.cast("string")) | F.coalesce(x == y, F.lit(False))


def row_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, changes``: for rows that differ, a map of field to (from, to) as a trail shows them; rows on one side only are all change."""
    shown = [f for f in fields if f not in NOISE]
    joined = before.select(F.col(key).alias("_bk"), *[F.col(f).alias(f"_b_{f}") for f in shown]).join(after.select(F.col(key).alias("_ak"), *[F.col(f).alias(f"_a_{f}") for f in shown]), F.col("_bk") == F.col("_ak"), "full")
    entry = lambda f: F.when(
        ~same_value(F.col(f"_b_{f}"), F.col(f"_a_{f}")), F.struct(F.lit(f).alias("key"), F.struct(_null_or(f, F.col(f"_b_{f}")).alias("from"), _null_or(f, F.col(f"_a_{f}")).alias("to")).alias("value"))
    )
    out = joined.select(F.coalesce("_bk", "_ak").alias(key), F.filter(F.array(*[entry(f) for f in shown]), lambda e: e.isNotNull()).alias("_c"))
    return out.where(F.size("_c") > 0).select(key, F.map_from_entries("_c").alias("changes"))


def _null_or(field: str, value: Column) -> Column:
    return presented(field, value) if _is_secret(field) else F.when(value.isNotNull(), presented(field, value))


def row_snapshots(rows: DataFrame, key: str) -> DataFrame:
    """``key, snapshot``: each row as JSON with secrets hidden and long texts cut, without the company."""
    cells = [_null_or(c, F.col(c)).alias(c) for c in rows.columns if c != "company_id"]
    return rows.select(key, F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("snapshot"))


#: Names of columns that hold days, times of day and numbers, whatever they are stored as.
DAYS = "(_date|_expiry)$|^data_"
TIMES = "_time$"
NUMBERS = "kg|amount|price|cost|rate|revenue|consumption|latitude|longitude|speed|heading|savings|volume|confidence|mma|_km|^max_vehicle_|^(quantity|tpo_total|valoare_tpo|cantitate_marfa|numar_curse|taxe_suplimentare|km_parcursi)$"


def serialised(rows: DataFrame) -> DataFrame:
    """Rows as they are sent: days as ``yyyy-MM-dd``, times as ``HH:mm``, other instants as ISO in UTC, numeric texts of number columns as numbers.

    ``created_at`` and ``updated_at`` are sent under ``created_date`` and ``updated_date`` as well. A text that is no number stays null in a number column.
    """
    kinds = dict(rows.dtypes)

    def cell(name: str) -> Column:
        c, kind = F.col(name), kinds[name]
        if kind in ("date", "timestamp", "timestamp_ntz"):
            if re.search(DAYS, name) or kind == "date":
                return F.date_format(c, "yyyy-MM-dd")
            return F.date_format(c, "HH:mm") if re.search(TIMES, name) else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        if kind == "string" and re.search(DAYS, name):
            return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.substring(c, 1, 10)).otherwise(c)
        if kind == "string" and re.search(NUMBERS, name):
            return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), c).try_cast("double")
        return c.cast("double") if kind.startswith("decimal") else c

    twins = {"created_at": "created_date", "updated_at": "updated_date"}
    return rows.select(*[cell(c).alias(c) for c in rows.columns], *[cell(a).alias(b) for a, b in twins.items() if a in kinds])


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """``value, n`` by number, most first, then by value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are not blank, trimmed."""
    return rows.select(F.trim(F.col(column).cast("string")).alias("value")).where("value <> ''").distinct()


def acknowledge(exceptions: DataFrame, ids: DataFrame, now: str, user: str, resolve: bool = False) -> DataFrame:
    """``exceptions`` (id, acknowledged_at, acknowledged_by, resolved_at) after those of ``ids`` (id) were seen, or closed with ``resolve``.

    Who saw an exception first stays named; one that is closed does not change.
    """
    hit = exceptions.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    on = F.col("_hit").isNotNull() & F.col("resolved_at").isNull()
    instant = F.lit(now).cast("timestamp")
    told = {
        "acknowledged_at": F.when(on, F.coalesce("acknowledged_at", instant)).otherwise(F.col("acknowledged_at")),
        "acknowledged_by": F.when(on, F.coalesce("acknowledged_by", F.lit(user))).otherwise(F.col("acknowledged_by")),
        "resolved_at": F.when(on & F.lit(resolve), instant).otherwise(F.col("resolved_at")),
    }
    return hit.withColumns(told).select(*exceptions.columns)


def distance_owner(incoming: Column, stored: Column, stored_source: Column) -> Column:
    """``distance_km, source, auto``: a cleared distance goes back to the computer, its own value echoed stays its own, any other is a person's."""
    echoed = (stored_source == "osrm") & stored.isNotNull() & (F.abs(incoming - stored) < 0.5)
    source = F.when(incoming.isNull(), F.lit(None)).when(F.coalesce(echoed, F.lit(False)), "osrm").otherwise("manual")
    return F.struct(incoming.alias("distance_km"), source.alias("source"), (incoming.isNull() | F.coalesce(echoed, F.lit(False))).alias("auto"))
