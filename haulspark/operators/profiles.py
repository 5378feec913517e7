"""Which layout a page has: shares of its markers, lifted or held down by what the page plainly is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.text import unmarked
from haulspark.operators.sheets import numbered_lines

# Layouts in their order, the kind of document each is of, and its markers: a word alone, text as it stands, text without marks, text without marks, blanks and points, or a numbered line.
PROFILES = {
    "carnet_bord": ("aviz", [("tight", "nrauto"), ("tight", "cantmarf"), ("tight", "nrcurse"), ("tight", "tipmarf"), ("tight", "rutatrans"), ("tight", "nrdocument"), ("line", "1"), ("line", "4"), ("plain", "carnet de bord")]),
    "aviz_cmr": ("aviz", [("word", "cmr"), ("plain", "scrisoare de trasur"), ("any", "locul de incarcare|locul de descarcare|locul de preluare"), ("any", "place of taking over|place of delivery"), ("line", "11")]),
    "aviz_baumit_psl": ("aviz", [("word", "psl"), ("text", "baumit"), ("text", "aviz")]),
    "aviz_baumit_tro": ("aviz", [("word", "tro"), ("text", "baumit"), ("text", "aviz")]),
    "aviz_generic": ("aviz", [("text", "aviz"), ("text", "insotire"), ("text", "însoțire"), ("word", "tpo"), ("text", "expeditor"), ("text", "livrare"), ("plain", "comanda de transport")]),
    "cmr_standard": ("cmr", [("word", "cmr"), ("text", "expeditor"), ("text", "destinatar"), ("text", "transportator"), ("plain", "scrisoare de trasur")]),
}
MANY_SLOTS, SOME_SLOTS = 5, 3


def _marker(kind: str, value: str, text: Column, plain: Column, lines: Column) -> Column:
    if kind == "line":
        return text.rlike(rf"(?:^|\n)\s*{value}[.)\-]" + (r"\s*\S" if value != "11" else ""))
    if kind == "word":
        return text.rlike(rf"\b{value}\b")
    if kind == "any":
        return reduce(Column.__or__, [F.contains(plain, F.lit(v)) for v in value.split("|")])
    return F.contains({"text": text, "plain": plain, "tight": F.regexp_replace(plain, r"[\s.]+", "")}[kind], F.lit(value))


def looks_like_waybill(text: Column, plain: Column) -> Column:
    """Whether a page is an international waybill: it says so, or it has the boxes of one and is no titled shipping note."""
    says = text.rlike(r"\bcmr\b") | F.contains(plain, F.lit("scrisoare de trasur")) | F.contains(plain, F.lit("letter of consignment"))
    titled = plain.rlike(r"aviz de expedi\S*(?: rezumat)? ?[:#]? ?(?:psl|tro|tpo)[\s\-._/:]*[0-9]{3,}")
    boxes = F.regexp_replace(plain, r"palet\S* \S{0,3} ?locul de livrare", " ")
    placed = boxes.rlike("locul de (?:incarcare|descarcare|preluare|livrare)")
    weighed = boxes.rlike("greutate ?bruta|gross ?weight") | text.rlike(r"(?:^|\n)\s*11[.)\-]")
    return says | (~titled & placed & weighed)


def detect_profiles(docs: DataFrame, id_col: str, text: str = "text", document_type: str | None = None) -> DataFrame:
    """``id, profile, score, candidates`` of each page: the layout of the highest score, of equal ones the first, null if nothing speaks for any; ``candidates`` are all, best first.

    A score is the share of the layout's markers on the page. A sheet of five filled numbered lines is a driver's, one of three may be; a waybill is none, and is an international one before a shipping note; a
    code of a maker's notes lifts that maker's layout. ``document_type`` narrows the layouts.
    """
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    page = docs.select(F.col(id_col).alias("id"), lower.alias("_t"), unmarked(lower).alias("_p"), F.size(numbered_lines(F.col(text))).alias("_slots"))
    page = page.withColumn("_cmr", looks_like_waybill(F.col("_t"), F.col("_p")))
    t, p, slots, cmr = F.col("_t"), F.col("_p"), F.col("_slots"), F.col("_cmr")
    found = []
    for i, (name, (kind, markers)) in enumerate(PROFILES.items()):
        if document_type and kind != document_type:
            continue
        score = reduce(Column.__add__, [_marker(k, v, t, p, slots).cast("int") for k, v in markers]) / len(markers)
        if name == "carnet_bord":
            score = F.when(cmr, F.least(score, F.lit(0.25))).when(slots >= MANY_SLOTS, F.greatest(score, F.lit(0.92))).when(slots >= SOME_SLOTS, F.greatest(score, F.lit(0.55))).otherwise(score)
        elif name in ("aviz_cmr", "cmr_standard"):
            lifted = F.greatest(score, F.lit(0.93 if name == "aviz_cmr" else 0.95))
            score = F.when(cmr, F.least(lifted, F.lit(0.9)) if name == "aviz_cmr" and not document_type else lifted).otherwise(score)
        elif name.startswith("aviz_baumit_"):
            score = F.when(t.rlike(rf"\b{name[-3:]}[\s\-._/:]*[0-9]{{3,}}"), F.greatest(score, F.lit(0.88))).otherwise(score)
        found.append(F.struct((-F.round(score, 2)).alias("minus"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    ranked = page.withColumn("_r", F.array_sort(F.array(*found)))
    best = F.get("_r", F.lit(0))
    score = lambda x: F.abs(x["minus"])
    return ranked.select("id", F.when(best["minus"] < 0, best["name"]).alias("profile"), score(best).alias("score"), F.array_join(F.transform("_r", lambda x: F.concat_ws("=", x["name"], score(x).cast("string"))), " ").alias("candidates"))
