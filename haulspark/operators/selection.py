"""Choosing the documents of a report: stated filters, the guard against none, id lists, and the log of what was exported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.timez import day_start
from haulspark.operators.relational import holds

#: Documents in a selection at most: a report is read by a person.
MOST = 500
STATUSES = ("uploaded", "extracted", "confirmed")
KINDS = ("aviz", "cmr", "other")


def unique_ids(ids: Sequence | None, most: int = MOST) -> list:
    """Ids each once, in the order they first stand, blanks left out, ``most`` at most."""
    return list(dict.fromkeys(i for i in ids or () if i))[:most]


def unique_id_array(ids: Column, most: int = MOST) -> Column:
    """The same of an array column."""
    return F.slice(F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i.cast("string") != ""))), 1, most)


def clean_filters(told: Mapping) -> dict:
    """Filters as they are applied and logged: what is blank, unknown or malformed is dropped, texts are trimmed and cut."""
    text = lambda name, most: str(told.get(name) or "").strip()[:most] or None
    day = lambda name: d if (d := str(told.get(name) or "")[:10]) and len(d) == 10 and d[4] == d[7] == "-" and d.replace("-", "").isdigit() else None
    one_of = lambda name, known: told.get(name) if told.get(name) in known else None
    limit = told.get("limit")
    return {
        "from": day("from"), "to": day("to"), "status": one_of("status", STATUSES), "plate": text("plate", 40), "batch_id": text("batch_id", 64), "q": text("q", 80),
        "kind": one_of("kind", KINDS), "with_weight": told.get("with_weight") is True, "ids": unique_ids(told.get("ids")), "limit": min(max(int(limit), 1), MOST) if limit else MOST,
    }


def is_empty(told: Mapping) -> bool:
    """Whether nothing narrows the selection, which would take the whole archive."""
    return not any(v for k, v in clean_filters(told).items() if k != "limit")


def select_documents(rows: DataFrame, told: Mapping) -> DataFrame:
    """Documents (id, day, created_at, status, plate, batch_id, kind, gross_kg, tpo, doc_no, route, file_name) that fit all filters.

    By day, those without one last, then by creation and id; the filters' limit at most. A document without a day is
    dated by its creation, in local days. An empty selection is an error.
    """
    f, c = clean_filters(told), F.col
    if is_empty(told):
        raise ValueError("a selection needs a filter")
    first = lambda d: F.lit(d).cast("date")
    parts: list[Column] = []
    if f["ids"]:
        parts.append(c("id").isin(f["ids"]))
    if f["from"]:
        parts.append((c("day") >= first(f["from"])) | (c("day").isNull() & (c("created_at") >= day_start(first(f["from"])))))
    if f["to"]:
        parts.append((c("day") <= first(f["to"])) | (c("day").isNull() & (c("created_at") < day_start(F.date_add(first(f["to"]), 1)))))
    parts += [c(name) == f[name] for name in ("status", "batch_id", "kind") if f[name]]
    if f["plate"]:
        parts.append(holds(c("plate"), f["plate"]))
    if f["q"]:
        parts.append(reduce(lambda a, b: a | b, [holds(c(name), f["q"]) for name in ("tpo", "doc_no", "route", "file_name")]))
    if f["with_weight"]:
        parts.append(c("gross_kg").isNotNull())
    return rows.where(reduce(lambda a, b: a & b, parts)).orderBy(c("day").asc_nulls_last(), "created_at", "id").limit(f["limit"])


def snapshot(rows: DataFrame, columns: Sequence[str], order: Sequence[Column | str], **told: Column) -> DataFrame:
    """One row of the export log: ``row_count``, ``ids``, ``snapshot`` (JSON of columns and rows as exported) and what else is ``told``.

    ``rows`` are a selection, which has a limit, so that a snapshot is one value.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    row = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("id"), F.struct(*columns).alias("cells"))
    packed = rows.agg(F.array_sort(F.collect_list(row)).alias("r"), F.count("*").alias("row_count"))
    body = F.struct(F.array(*[F.lit(c) for c in columns]).alias("columns"), F.transform("r", lambda x: x["cells"]).alias("rows"))
    return packed.select(F.lit("xlsx").alias("kind"), "row_count", F.transform("r", lambda x: x["id"]).alias("ids"), F.to_json(body).alias("snapshot"), *[v.alias(k) for k, v in told.items()])


def matches_list(row_day: Column, told: Mapping, text: Sequence[str], equal: Mapping[str, str]) -> Column:
    """The list filter as a predicate, for rows that are already on screen: day from and to, equalities, words anywhere in ``text``."""
    parts: list[Column] = []
    if told.get("from"):
        parts.append(F.coalesce(row_day >= F.lit(told["from"]).cast("date"), F.lit(False)))
    if told.get("to"):
        parts.append(F.coalesce(row_day <= F.lit(told["to"]).cast("date"), F.lit(False)))
    parts += [F.coalesce(F.col(c) == told[name], F.lit(False)) for name, c in equal.items() if told.get(name)]
    needle = str(told.get("q") or "").strip().lower()
    if needle:
        parts.append(F.contains(F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in text])), F.lit(needle)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
