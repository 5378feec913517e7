"""The list screens' queries: scans, searches, pages, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.sources.shared import settled


def parse_order(text: str, allowed: Sequence[str], fallback: str = "-created_at") -> Column:
    """``-name`` sorts down and ``name`` up, nulls last going up and first going down; unknown names give the fallback."""
    name = text.removeprefix("-")
    if name not in allowed:
        text, name = fallback, fallback.removeprefix("-")
    return F.col(name).desc_nulls_first() if text.startswith("-") else F.col(name).asc_nulls_last()


def entity_scan(rows: DataFrame, filters: Mapping[str, object], allowed: Sequence[str], order: Sequence[Column], limit: int = 200) -> DataFrame:
    """Rows equal to ``filters`` on allowed columns, in ``order``, at most min(limit, 1000); unknown names are ignored.

    A filter value of None matches nothing, as comparing with null does.
    """
    parts = [F.lit(False) if v is None else F.col(k) == v for k, v in filters.items() if k in allowed]
    return rows.where(reduce(lambda a, b: a & b, parts, F.lit(True))).orderBy(*order).limit(min(limit, 1000))


def holds(column: Column, text: str) -> Column:
    """Case-blind substring test in which no character is a wildcard."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(F.lit(text)))


def like_open(column: Column, text: str) -> Column:
    """ILIKE in which ``%`` and ``_`` of the text are wildcards, as some screens allow."""
    return F.lower(column).like(f"%{text.lower()}%")


def like_escaped(column: Column, text: str) -> Column:
    """ILIKE for a text that is taken literally."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.lower(column).like(f"%{safe.lower()}%")


def search_all(tables: Mapping[str, tuple[DataFrame, str, Sequence[str]]], text: str, most: int = 10) -> DataFrame:
    """``entity, id, title`` of up to ``most`` hits a table, by id; fewer than two characters find nothing."""
    if len(text.strip()) < 2:
        tables = {k: (df.limit(0), i, c) for k, (df, i, c) in tables.items()}
    parts = [
        df.where(reduce(lambda a, b: a | b, [like_escaped(F.col(c), text) for c in columns])).orderBy(id_col).limit(most)
        .select(F.lit(name).alias("entity"), F.col(id_col).cast("long").alias("id"), F.col(columns[0]).alias("title"))
        for name, (df, id_col, columns) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) of ``rows`` with the count of all, which one aggregate finds."""
    size = max(1, min(size, 500))
    total = rows.agg(F.count("*").alias("total_rows"))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))


def top_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; Spark drops the others before the shuffle where it can (window group limit)."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``rows`` numbered 1, 2, ... in ``order``, which must tell all rows apart, without a window over all rows in one task.

    Rows are dealt by ranges of the order and kept in the shared folder, so that the ranges are drawn once; each is
    numbered by itself from the count of rows in the ranges before it. The only window in one task has a row a range.
    """
    placed = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return within.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_k")).drop("_range", "_before", "_k")


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, changes``: a map from field to (from, to) of rows that differ; numbers are compared as numbers."""
    b, a = before.alias("b"), after.alias("a")

    def differs(f: str) -> Column:
        x, y = F.col(f"b.{f}"), F.col(f"a.{f}")
        return ~x.eqNullSafe(y)

    entry = lambda f: F.when(differs(f), F.struct(F.lit(f).alias("key"), F.struct(F.col(f"b.{f}").cast("string").alias("from"), F.col(f"a.{f}").cast("string").alias("to")).alias("value")))
    joined = b.join(a, key).select(key, F.filter(F.array(*[entry(f) for f in fields]), lambda e: e.isNotNull()).alias("_c"))
    return joined.where(F.size("_c") > 0).select(key, F.map_from_entries("_c").alias("changes"))


def expiring(rows: DataFrame, id_col: str, dates: Mapping[str, str], today: str, days: int) -> DataFrame:
    """``id, document, expires, days_left`` of every date due within ``days``, overdue ones too; nulls never match."""
    day = F.lit(today).cast("date")
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("document"), F.col(c).cast("date").alias("expires")) for name, c in dates.items()]))
    out = rows.select(F.col(id_col).alias("id"), stacked.alias("d")).select("id", "d.*")
    return out.where(F.col("expires") <= F.date_add(day, days)).withColumn("days_left", F.datediff("expires", day))


def retained(rows: DataFrame, instant: str, now: str, days: int, keep: Column | None = None) -> DataFrame:
    """Rows younger than ``days`` at ``now``, and those that ``keep`` protects; a null instant is kept."""
    old = F.col(instant) < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    old = F.coalesce(old, F.lit(False))
    return rows.where(~old if keep is None else ~old | F.coalesce(keep, F.lit(False)))
