"""Fields read from printed papers of any layout: candidates line by line, the best of each field, and how sure it is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.scans import scanned_codes
from haulspark.functions.text import once, resolved_date, unmarked
from haulspark.operators.documents import LOAD_HIGH, LOAD_LOW
from haulspark.operators.grouped import dealt
from haulspark.operators.sheets import CEILINGS, CODE_DIGITS, MOST_OF_ANY, UNSURE, hand_number, packaging_word, plate_tokens

# Labels as they are printed, folded; months; how sure a place makes its field; what fields weigh in the whole.
LABELS = {
    "date": ("data aviz", "data efectuarii cursei", "data documentului"), "order": ("comanda de transport", "comanda transport"), "gross": ("greutate bruta", "masa bruta", "gross weight"), "net": ("greutate net", "masa net", "net weight"),
    "from": ("expeditor",), "to": ("adresa de livrare", "loc de descarcare"),
}
MONTHS = ("ian", "feb", "mar", "apr", "mai", "iun", "iul", "aug", "sep", "oct", "noi", "dec")
WEIGHTS = {"tpo": 3.0, "plate": 3.0, "doc_date": 2.0, "doc_no": 1.0, "route": 1.0, "goods": 1.0, "gross_kg": 1.0, "net_kg": 1.0, "quantity": 1.0}
FIELDS, CRITICAL = tuple(WEIGHTS), ("tpo", "plate", "doc_date", "doc_no")
ACCEPT, REJECT = 0.8, 0.5
#: Lines after a label in which its value may stand.
NEAR = 2
_FOUND = "array<struct<field:string,rank:int,far:int,line:int,value:string,confidence:double>>"


def _labelled(lines: Column, i: Column, what: str) -> Column:
    """How many lines above line ``i`` the nearest label stands, null for none within ``NEAR``."""
    has = lambda at: F.coalesce(F.get(lines, at)["folded"].rlike("|".join(LABELS[what])), F.lit(False))
    out = F.lit(None).cast("int")
    for gap in range(NEAR, -1, -1):
        out = F.when((i >= gap) & has(i - gap), gap).otherwise(out)
    return out


def _weight(line: Column, what: str) -> Column:
    """Kilograms after a label on the same line, the unit before or behind the figure; null if no lorry weighs so much."""
    return once(F.regexp_extract(line["folded"], rf"(?:{'|'.join(LABELS[what])})[a-z]*\s*(.*)$", 1), lambda after: F.when(after != "", _kilos(after)))


def _kilos(after: Column) -> Column:
    number, tonnes = hand_number(F.regexp_replace(F.regexp_extract(after, r"([0-9][0-9., ]*[0-9]|[0-9])", 1), " ", "")), after.rlike(r"[0-9) ]\s*t(?:o|on|one)?\b") | after.rlike(r"^\W*\(?t(?:o|on|one)?\b")
    kilos = F.when(after.rlike(r"\b(?:kg|t|to|tone|ton)\b"), F.when(tonnes, number * 1000).otherwise(number))
    return once(kilos, lambda kg: F.when(kg.between(LOAD_LOW, LOAD_HIGH), F.round(kg, 2)))


def _candidates(lines: Column, i: Column, line: Column, today: Column) -> Column:
    """What a line offers to each field: its rank among the field's kinds of places, lines from its label, value and how sure it is."""
    entry = lambda field, rank, value, sure, far=F.lit(0): once(value, lambda v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"), far.cast("int").alias("far"), i.cast("int").alias("line"), v.alias("value"), sure.cast("double").alias("confidence"))))
    raw, folded = line["raw"], line["folded"]
    code = lambda kind: F.regexp_extract(raw, rf"\b{kind}-([0-9]{{4,}})\b", 1)
    padded = lambda d: F.lpad(d, F.greatest(F.length(d), F.lit(CODE_DIGITS)), F.lit("0"))
    sure_code = lambda d, base: F.lit(base) - F.when(F.length(d) <= CODE_DIGITS, 0.0).otherwise(UNSURE)
    bare = F.when(folded.rlike("|".join(LABELS["order"])), F.regexp_extract(folded, r"transport\W*([0-9]{4,7})\b", 1))
    coded = lambda field, rank, found, made, sure: once(found, lambda d: entry(field, rank, F.when(d != "", made(d)), sure(d)))
    part = lambda pattern, n: F.regexp_extract(raw, pattern, n).try_cast("int")
    dmy, iso, named = r"\b(\d{1,2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{2,4})\b", r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})\s+(\p{L}{3,10})\.?\s+(\d{4})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substr(unmarked(F.regexp_extract(raw, named, 2)), F.lit(1), F.lit(3))).cast("int")
    is_iso = raw.rlike(iso)
    when = lambda d, m, y: resolved_date(d, m, y, today)

    def dated(resolved: Column, rank: Column, least: Column, plus: float) -> Column:
        return once(resolved, lambda r: F.when(r["date"].isNotNull(), F.struct(F.lit("doc_date").alias("field"), rank.cast("int").alias("rank"), F.lit(0).alias("far"), i.cast("int").alias("line"), r["date"].alias("value"), F.least(r["confidence"] + plus, least).alias("confidence"))))

    near_label = _labelled(lines, i, "date")
    plates = once(plate_tokens(raw), lambda p: F.when(F.size(p) > 0, F.array_join(p, " / ")))
    amount, unit = hand_number(F.regexp_extract(folded, r"\b([0-9][0-9.,]*)\s*(?:m3|mc|saci?|galeti|pal(?:eti|et)?|buc(?:ati)?|pcs|pce)\b", 1)), packaging_word(F.regexp_extract(folded, r"[0-9]\s*(m3|mc|saci?|galeti|pal(?:eti|et)?|buc(?:ati)?|pcs|pce)\b", 1))
    loaded = F.struct(amount.alias("n"), unit.alias("unit"))
    beside = hand_number(F.regexp_extract(folded, r"\b[0-9][0-9.,]*\s*(?:saci?|galeti|buc(?:ati)?|pcs)\s+([0-9][0-9.,]*)\s*kg\b", 1))
    return F.filter(
        F.array(
            coded("tpo", 0, code("TPO"), lambda d: F.concat(F.lit("TPO-"), padded(d)), lambda d: sure_code(d, 0.9)),
            coded("tpo", 1, bare, lambda d: F.concat(F.lit("TPO-"), padded(d)), lambda d: sure_code(d, 0.72)),
            coded("doc_no", 0, code("TRO"), lambda d: F.concat(F.lit("TRO-"), d), lambda d: F.lit(0.9)),
            coded("doc_no", 1, code("PSL"), lambda d: F.concat(F.lit("PSL-"), d), lambda d: F.lit(0.78)),
            F.when(~is_iso & raw.rlike(dmy), dated(when(part(dmy, 1), part(dmy, 2), part(dmy, 3)), F.when(near_label.isNotNull(), 0).otherwise(2), F.lit(1.0), 0.0)),
            F.when(is_iso, dated(when(part(iso, 3), part(iso, 2), part(iso, 1)), F.lit(1), F.lit(0.95), 0.05)),
            once(month, lambda m: F.when(m > 0, dated(when(part(named, 1), m, part(named, 3)), F.lit(3), F.lit(0.85), 0.0))),
            entry("plate", 0, plates, F.lit(0.9)),
            entry("gross_kg", 0, _weight(line, "gross").cast("string"), F.lit(0.9)),
            once(beside, lambda kg: entry("gross_kg", 1, F.when(kg.between(LOAD_LOW, LOAD_HIGH), kg.cast("string")), F.lit(0.8))),
            entry("net_kg", 0, _weight(line, "net").cast("string"), F.lit(0.9)),
            once(loaded, lambda q: entry("quantity", 0, F.when((q["n"] > 0) & (q["n"] <= F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CEILINGS.items() for x in p]), q["unit"]), F.lit(MOST_OF_ANY))), F.concat_ws(" ", q["n"].cast("string"), q["unit"])), F.lit(0.86))),
            once(loaded, lambda q: entry("goods", 0, F.when(q["n"] > 0, q["unit"]), F.lit(0.9))),
            entry("goods", 1, F.when(~folded.rlike("predare|preluare|locul de livrare"), packaging_word(raw)), F.lit(0.7)),
        ),
        lambda e: e.isNotNull(),
    )


def _leg(lines: Column, what: str) -> Column:
    """What stands behind a label in its own cell, else the cell below it: the left one where a line has several."""
    at = F.array_position(F.transform(lines, lambda x: x["folded"].rlike("|".join(LABELS[what]))), F.lit(True)).cast("int")
    own = F.trim(F.regexp_replace(F.get(lines, at - 1)["left"], r"(?i)^.*?(?:expeditor|livrare|desc[aă]rcare)\s*[:\-]?\s*", ""))
    return F.when(at > 0, F.when(F.length(own) >= 3, own).otherwise(F.trim(F.get(lines, at)["left"])))


def read_fields(docs: DataFrame, id_col: str, today: str, text: str = "text") -> DataFrame:
    """``id, field, value, confidence, status, line`` of every field of every page, those not found too.

    The page is cleaned and its codes read through their look-alikes. Each line offers candidates to fields; of a field's candidates the one in the best kind of place stands, then the one nearest its label, then
    the first on the page. Plates are all that the page has. A gross weight below the net one is no reading. Status is ok from ``ACCEPT`` on, review from ``REJECT`` on, else missing. A page is one row throughout, dealt over all cores by its id.
    """
    day = F.lit(today).cast("date")
    lines = F.transform(F.split(scanned_codes(F.coalesce(F.col("_text"), F.lit(""))), "\n"), lambda x: F.struct(F.replace(x, F.lit("\t"), F.lit("  ")).alias("raw"), unmarked(x).alias("folded"), F.substring_index(x, "\t", 1).alias("left")))
    paged = dealt(docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text")), "id").select("id", lines.alias("_lines"))
    offered = paged.withColumn("_found", once(F.col("_lines"), lambda all_: F.flatten(F.transform(all_, lambda x, i: _candidates(all_, i, x, day)))).cast(_FOUND))

    def best(field: str) -> Column:
        return F.array_min(F.filter("_found", lambda c: (c["field"] == field) & c["confidence"].isNotNull()))

    plates = once(F.array_distinct(F.flatten(F.transform(F.filter("_found", lambda c: c["field"] == "plate"), lambda c: F.split(c["value"], " / ")))), lambda p: F.when(F.size(p) > 0, F.array_join(p, " / ")))
    legs = F.array(_leg(F.col("_lines"), "from"), _leg(F.col("_lines"), "to"))
    route = once(legs, lambda x: F.when((F.length(x[0]) >= 3) & (F.length(x[1]) >= 3), F.array_join(x, " / ")))
    picked = offered.select("id", *[best(f).alias(f) for f in FIELDS if f not in ("plate", "route")], best("plate").alias("plate"), plates.alias("_plates"), route.alias("_route"))
    gross, net = F.col("gross_kg.value").cast("double"), F.col("net_kg.value").cast("double")

    def told(field: str) -> Column:
        value, sure, line = F.col(f"{field}.value") if field != "route" else F.col("_route"), F.col(f"{field}.confidence") if field != "route" else F.lit(0.8), F.col(f"{field}.line") if field != "route" else F.lit(None).cast("int")
        if field == "plate":
            value, sure = F.col("_plates"), F.when(F.contains("_plates", F.lit("/")), 0.88).otherwise(sure)
        if field == "gross_kg":
            value = F.when(~F.coalesce(gross + 0.05 < net, F.lit(False)), value)
        return F.struct(F.lit(field).alias("field"), value.alias("value"), F.round(F.when(value.isNotNull(), sure).otherwise(0.0), 2).alias("confidence"), F.when(value.isNotNull(), line + 1).alias("line"))

    out = picked.select("id", F.explode(F.array(*[told(f) for f in FIELDS])).alias("f")).select("id", "f.*")
    status = F.when(F.col("confidence") >= ACCEPT, "ok").when(F.col("confidence") >= REJECT, "review").otherwise("missing")
    return out.select("id", "field", "value", "confidence", status.alias("status"), "line")


def reading_summary(fields: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``id, confidence, status, review_fields`` of each page: the weighted mean of its fields' confidences, and what a person should look at.

    A page is ok from ``ACCEPT`` on, unless a critical field that was read is below it.
    """
    weight = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("field")]
    unsure = F.col("field").isin(*CRITICAL) & F.col("value").isNotNull() & (F.col("confidence") < ACCEPT)
    cents = (F.round(F.col("confidence") * 100) * weight).cast("decimal(18,2)")  # whole hundredths: sums do not depend on the order
    told = fields.groupBy("id").agg((F.sum(cents) / F.sum(weight.cast("decimal(18,2)"))).cast("double").alias("mean"), F.max(unsure).alias("unsure"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("field")))), ",").alias("review_fields"))
    confidence = F.floor(F.col("mean") + 0.5) / 100
    return told.select("id", confidence.alias("confidence"), F.when((confidence >= ACCEPT) & ~F.col("unsure"), "ok").otherwise("review").alias("status"), "review_fields")
