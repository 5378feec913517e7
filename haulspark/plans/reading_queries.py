"""Printed papers of several layouts, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators import profiles, reading
from haulspark.sources.shared import settled
from haulspark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
TODAY = "2026-10-19"
#: A page, {t} its seven digits, and what each field is read as: value, confidence, line. What is not named is not found.
PAGES = [
    (
        "Aviz de expediție: TRO-OOI 1300\nNum de comandă de transport TPO-{t}\nData avizului:\n12.10.2026  și 01.02.2026\nAuto: B 33o SRS / CA 4471 KX\nExpeditor\nStr. Fabricii nr. 20, Balotești\nAdresa de livrare\tClient\nStr. Lungă 4, Arad\tAleea 5\n378.00 sac 9,487.80 kg\nGreutate netă: 9,450.00 kg  Greutate brutä: 9.500,5 kg",
        {"tpo": ("TPO-{t}", 0.9, 2), "doc_no": ("TRO-0011300", 0.9, 1), "doc_date": ("2026-10-12", 0.9, 4), "plate": ("B-330-SRS / CA-4471-KX", 0.88, 5), "route": ("Str. Fabricii nr. 20, Balotești / Str. Lungă 4, Arad", 0.8, None), "quantity": ("378.0 saci", 0.86, 10), "goods": ("saci", 0.9, 10), "gross_kg": ("9500.5", 0.9, 11), "net_kg": ("9450.0", 0.9, 11)},
    ),
    (
        "PSL {t}\ncomanda transport: 31027\n2026-10-02 și 01.01.2020\nTM 12 ABC\nexpeditor: Depozit Cluj\nloc de descarcare - Sibiu\n12 m3 beton\nGreutate bruta, kg 15,744.00\nmasa neta 16 t",
        {"tpo": ("TPO-0031027", 0.72, 2), "doc_no": ("PSL-{t}", 0.78, 1), "doc_date": ("2026-10-02", 0.95, 3), "plate": ("TM-12-ABC", 0.9, 4), "route": ("Depozit Cluj / Sibiu", 0.8, None), "quantity": ("12.0 m³", 0.86, 7), "goods": ("m³", 0.9, 7), "net_kg": ("16000.0", 0.9, 9)},
    ),
    ("TP0-{t}\n3 septembrie 2026\nb 99 xyz\nTM 40 kg\ngaleti 40 galeti 12.345 kg\nPSL-0000012", {"tpo": ("TPO-{t}", 0.9, 1), "doc_no": ("PSL-0000012", 0.78, 6), "doc_date": ("2026-09-03", 0.85, 2), "plate": ("B-99-XYZ", 0.9, 3), "quantity": ("40.0 galeti", 0.86, 5), "goods": ("galeti", 0.9, 5), "gross_kg": ("12345.0", 0.8, 5)}),
    ("05.03.2020\nsaci de ciment\n|12|kg|", {"doc_date": ("2026-03-05", 0.55, 1), "goods": ("saci", 0.7, 2)}),
    (None, {}),
]


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    page = F.get(F.array(*[F.lit(p).cast("string") for p, _ in PAGES]), (k % len(PAGES)).cast("int"))
    docs = table(spark, sf_dir, "customer").select(k.alias("id"), F.replace(page, F.lit("{t}"), F.lpad(k.cast("string"), 7, "0")).alias("text"))
    return reading.read_fields(docs, "id", TODAY)


def read_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of pages of five layouts."""
    return _read(spark, sf_dir)


def reading_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure the pages are as a whole, and what is to be looked at."""
    return reading.reading_summary(settled(_read(spark, sf_dir)))


def _cell(v) -> str:
    return "null" if v is None else f"{v!r}" if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


_ROWS = [(i, f, *told.get(f, (None, 0.0, None)), reading.WEIGHTS[f], f in reading.CRITICAL) for i, (_, told) in enumerate(PAGES) for f in reading.FIELDS]
_SQL = f"""
with f(i, field, value, confidence, line, weight, critical) as (values {', '.join('(' + ', '.join(str(c).lower() if isinstance(c, bool) else _cell(c) for c in row) + ')' for row in _ROWS)}),
r as (select c_custkey as id, field, replace(value, '{{t}}', lpad(c_custkey::varchar, 7, '0')) as value, confidence::double as confidence, case when confidence >= 0.8 then 'ok' when confidence >= 0.5 then 'review' else 'missing' end as status, line::int as line, weight, critical from customer join f on i = c_custkey % {len(PAGES)})"""

QUERIES |= {"read_fields": read_fields, "reading_summary": reading_summary}
ORACLE_SQL["read_fields"] = _SQL + " select id, field, value, confidence, status, line from r"
ORACLE_SQL["reading_summary"] = _SQL + """,
s as (select id, floor(sum(round(confidence * 100) * weight) / sum(weight) + 0.5) / 100 as confidence, bool_or(critical and value is not null and confidence < 0.8) as unsure, coalesce(string_agg(field, ',' order by field) filter (status <> 'ok'), '') as review_fields from r group by id)
select id, confidence, case when confidence >= 0.8 and not unsure then 'ok' else 'review' end as status, review_fields from s"""

#: A page and its layouts with their scores, best first.
LAYOUTS = [
    ("Aviz de expediție: PSL-0012345 Baumit", "aviz_baumit_psl=1.0 aviz_baumit_tro=0.67 aviz_generic=0.14 carnet_bord=0.0 aviz_cmr=0.0 cmr_standard=0.0"),
    ("1. TPO-1\n2. a\n3. b\n4. c\n5. d", "carnet_bord=0.92 aviz_generic=0.14 aviz_cmr=0.0 aviz_baumit_psl=0.0 aviz_baumit_tro=0.0 cmr_standard=0.0"),
    ("CMR\nexpeditor x\nDestinatar y\n1. a\n2. b\n3. c\n4. d\n5. e", "cmr_standard=0.95 aviz_cmr=0.9 carnet_bord=0.22 aviz_generic=0.14 aviz_baumit_psl=0.0 aviz_baumit_tro=0.0"),
    ("tro 123 text", "aviz_baumit_tro=0.88 carnet_bord=0.0 aviz_cmr=0.0 aviz_baumit_psl=0.0 aviz_generic=0.0 cmr_standard=0.0"),
    ("Locul de descărcare: X\nGreutate brută 5", "cmr_standard=0.95 aviz_cmr=0.9 carnet_bord=0.0 aviz_baumit_psl=0.0 aviz_baumit_tro=0.0 aviz_generic=0.0"),
    ("Aviz de expediție rezumat: TPO-0012345\nPaleti la locul de livrare\nGreutate brută 5", "aviz_generic=0.43 aviz_baumit_psl=0.33 aviz_baumit_tro=0.33 carnet_bord=0.0 aviz_cmr=0.0 cmr_standard=0.0"),
    ("1. a\n2. b\n3. c\nNr. auto", "carnet_bord=0.55 aviz_cmr=0.0 aviz_baumit_psl=0.0 aviz_baumit_tro=0.0 aviz_generic=0.0 cmr_standard=0.0"),
    ("nothing", "carnet_bord=0.0 aviz_cmr=0.0 aviz_baumit_psl=0.0 aviz_baumit_tro=0.0 aviz_generic=0.0 cmr_standard=0.0"),
    (None, "carnet_bord=0.0 aviz_cmr=0.0 aviz_baumit_psl=0.0 aviz_baumit_tro=0.0 aviz_generic=0.0 cmr_standard=0.0"),
]


def layout_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of pages that are plainly one, two at once, and none."""
    k = F.col("c_custkey")
    page = F.get(F.array(*[F.lit(p).cast("string") for p, _ in LAYOUTS]), (k % len(LAYOUTS)).cast("int"))
    return profiles.detect_profiles(table(spark, sf_dir, "customer").select(k.alias("id"), page.alias("text")), "id")


QUERIES["layout_detect"] = layout_detect
ORACLE_SQL["layout_detect"] = f"""
with f(i, candidates) as (values {', '.join(f"({i}, '{c}')" for i, (_, c) in enumerate(LAYOUTS))}), t as (select *, split_part(split_part(candidates, ' ', 1), '=', 1) as best, split_part(split_part(candidates, ' ', 1), '=', 2)::double as score from f)
select c_custkey as id, case when score > 0 then best end as profile, score, candidates from customer join t on i = c_custkey % {len(LAYOUTS)}"""
