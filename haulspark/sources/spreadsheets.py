"""Spreadsheet exports as tables: delimiter, headers, blank rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions.text import MARKED, PLAIN

# Column headers by which each field is known, folded to lower case without marks.
HEADERS = {
    "order_number": ["numar comanda", "nr comanda", "numar", "nr", "comanda", "order", "order number"],
    "client_name": ["client", "beneficiar", "customer", "client name"],
    "location_name": ["locatie", "punct de lucru", "punct", "destinatie", "location"],
    "address": ["adresa", "adresa livrare", "address"],
    "city": ["oras", "localitate", "city"],
    "type": ["tip", "tip comanda", "type"],
    "requested_date": ["data", "data livrare", "data cursa", "date", "requested date"],
    "window_start": ["fereastra de la", "de la", "ora de la", "interval de la", "window start"],
    "window_end": ["fereastra pana la", "pana la", "ora pana la", "interval pana la", "window end"],
    "service_time_min": ["timp servire", "timp descarcare", "minute servire", "service time"],
    "weight_kg": ["greutate", "greutate kg", "kg", "weight"],
    "volume_mc": ["volum", "volum mc", "mc", "volume"],
    "pallets": ["paleti", "nr paleti", "palets", "pallets"],
    "requires": ["cerinte", "cerinte vehicul", "requires"],
    "goods_description": ["marfa", "descriere", "descriere marfa", "goods"],
    "notes": ["note", "notite", "observatii", "mentiuni", "notes"],
}
FIELD_OF = {alias: field for field, aliases in HEADERS.items() for alias in aliases}


def fold_header(text: str) -> str:
    """Lower case, marks off, words apart by one space."""
    plain = text.lower().translate(str.maketrans(MARKED, PLAIN))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def sniff_delimiter(line: str) -> str:
    """The one of ``;``, comma, tab and ``|`` that stands most often outside quotes; a comma if none does."""
    outside = "".join(line.split('"')[::2])
    counts = {d: outside.count(d) for d in ";,\t|"}
    best = max(counts, key=counts.get)
    return best if counts[best] else ","


def map_headers(columns: list[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """(column by field, columns not known, columns that name a field again); the first column of a field holds."""
    fields, unknown, again = {}, [], []
    for column in columns:
        field = FIELD_OF.get(fold_header(column))
        if field is None:
            unknown.append(column)
        elif field in fields:
            again.append(column)
        else:
            fields[field] = column
    return fields, unknown, again


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Rows of delimited files with one header, by field, trimmed; blank cells are null, blank rows are left out.

    Only the header line comes to the driver. Cells may be quoted and hold line ends; a byte order mark is dropped.
    """
    header = spark.read.text(path).limit(1).first()
    if header is None:
        return spark.createDataFrame([], ", ".join(f"{f} string" for f in HEADERS))
    delimiter = sniff_delimiter(header[0].lstrip("﻿"))
    raw = spark.read.csv(path, sep=delimiter, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    fields, _, _ = map_headers(raw.columns)
    cells = [F.nullif(F.trim(F.col(f"`{fields[f]}`")), F.lit("")).alias(f) if f in fields else F.lit(None).cast("string").alias(f) for f in HEADERS]
    return raw.select(*cells).where(F.coalesce(*[F.col(f) for f in HEADERS]).isNotNull())
