"""Numbered sheets that drivers write: what each line is, and which field it fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.address import COUNTIES
from haulspark.functions.goods import MIXED, UNITS
from haulspark.functions.text import MARKED, PLAIN, once, resolved_date
from haulspark.operators.documents import LOAD_HIGH, LOAD_LOW, NO_SERIES
from haulspark.operators.grouped import as_told, dealt

# The guide that drivers are given, line by line, and the kind of line that each field wants.
GUIDE = ("tpo", "doc_date", "order_value", "plate", "route", "goods", "quantity", "gross_kg", "net_kg", "doc_no", "runs", "taxes", "km", "tariff")
KIND_OF = {f: f for f in GUIDE} | {"gross_kg": "weight", "net_kg": "weight", "order_value": "money", "taxes": "money", "tariff": "money"}
#: Other kinds that a field takes from its own line, and fields that are filled from no other line.
ALSO = {"km": ("money", "runs"), "runs": ("money",), "quantity": ("money",)}
ONLY_GUIDE = ("order_value", "taxes", "tariff")
BLANKS = ("", "-", "–", "—", "x", "gol", "n/a", "na")
ORDER_SEEN_AS = ("TPO", "TP0", "TPQ", "TPD", "IPO", "7PO")
NOTE_PREFIXES = ("PSL", "TRO", "TEST-AVZ")
QUANTITY_WORDS = ("m3", "m³", "mc", "t", "tone", "to", "sac", "saci", "galeti", "găleți", "gale", "buc", "bucati", "pal", "paleti", "pce")
GOODS_WORDS = ("nisip", "balast", "beton", "ciment", "apa", "apă", "lemn", "fier", "oteland", "otelu", "oteli", "pietris", "pietriș", "sort", "agregat", "moloz", "pamant", "pământ")
STREET_WORDS = ("b-dul", "bdul", "bd", "bud", "str", "so", "sos", "șos", "calea", "aleea")
CEILINGS = {"bucati": 200_000, "buc": 200_000, "pce": 100_000, "paleti": 2000, "palet": 2000, "t": 100, "to": 100, "ton": 100, "tone": 100, "mc": 500, "m3": 500}
MOST_OF_ANY = 100_000
UNIT_RANKS = {"m³": 5, "galeti": 4, "saci": 3, "paleti": 2, "bucati": 1}
#: Digits of a full code; others are less sure by as much.
CODE_DIGITS, UNSURE = 7, 0.35
SURE, SURE_ELSEWHERE, FEWEST = 0.92, 0.84, 3


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _word(words) -> str:
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(words, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"


def hand_number(text: Column) -> Column:
    """A number as a hand writes it: of several separators the last is the decimal one, unless all are alike and three digits follow it.

    One point before three digits parts thousands; one comma is the decimal. What is no number is null.
    """
    return once(F.regexp_replace(text, r"\s", ""), _hand_number)


def _hand_number(t: Column) -> Column:
    signs = F.regexp_replace(t, "[^.,]", "")
    head, tail = F.regexp_replace(F.regexp_replace(t, r"[.,][^.,]*$", ""), "[.,]", ""), F.regexp_extract(t, r"[.,]([^.,]*)$", 1)
    alike = (F.replace(signs, F.lit(".")) == "") | (F.replace(signs, F.lit(",")) == "")
    many = F.when((F.length(tail) == 3) & alike, F.concat(head, tail)).otherwise(F.concat(head, F.lit("."), tail, F.lit("0")))
    one = F.when(t.rlike(r"\.[0-9]{3}$"), F.replace(t, F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    told = F.when(F.length(signs) > 1, many).otherwise(one)
    return once(told, lambda number: F.when(number.rlike(r"^[0-9]*\.?[0-9]*$") & number.rlike("[0-9]"), number).try_cast("double"))


def plate_tokens(text: Column) -> Column:
    """Every plate in ``text`` as ``X-000-YYY``, each once, in their order: of the country, or of a neighbour with four digits."""
    home = rf"\b(?:{'|'.join(COUNTIES)})[\s-]?[0-9]{{2,3}}[\s-]?[A-Z]{{2,3}}\b"
    found = F.regexp_extract_all(F.upper(F.regexp_replace(text, r"\s+", " ")), F.lit(rf"{home}|\b[A-Z]{{1,2}}[\s-]?[0-9]{{4}}[\s-]?[A-Z]{{2}}\b"), F.lit(0))
    part = lambda p, n: F.regexp_extract(p, r"^([A-Z]+)[\s-]?([0-9]+)[\s-]?([A-Z]+)$", n)
    plates = F.filter(found, lambda p: ~part(p, 3).isin(*NO_SERIES))
    return F.array_distinct(F.transform(plates, lambda p: F.concat_ws("-", part(p, 1), part(p, 2), part(p, 3))))


def packaging_word(text: Column) -> Column:
    """The packaging that ``text`` names: two kinds at once, else the one that says most; null without any."""
    return once(F.translate(F.replace(F.lower(text), F.lit("³"), F.lit("3")), MARKED, PLAIN), _packaging)


def _packaging(folded: Column) -> Column:
    def of(tight: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, unit in MIXED.items():
            out = F.when(F.contains(tight, F.lit(name)), unit).otherwise(out)
        return out

    mixed = F.when(F.contains(folded, F.lit("/")), once(F.regexp_replace(folded, r"\s*/\s*", "/"), of))
    units = F.transform(F.split(folded, "[^a-z0-9]+"), lambda w: F.try_element_at(_map(UNITS), w))
    ranked = F.filter(F.transform(units, lambda u, i: F.struct((-F.coalesce(F.try_element_at(_map(UNIT_RANKS), u), F.lit(0))).alias("r"), i.alias("i"), u.alias("u"))), lambda s: s["u"].isNotNull())
    return F.coalesce(mixed, F.array_min(ranked)["u"])



def line_of(raw: Column) -> Column:
    """What a line holds, as a struct from which its kind and its values are read."""
    tight = F.regexp_replace(raw, r"\s*-\s*", "-")
    digits = lambda prefixes: F.regexp_extract(raw, rf"(?i)\b(?:{'|'.join(prefixes)})[\s\-._/:]*([0-9]{{3,}})", 1)
    date = lambda n: F.regexp_extract(raw, r"^(\d{1,2})\s*[.:\-/]\s*(\d{1,2})\s*[.:\-/]\s*(\d{2,4})$", n).try_cast("int")
    unit = F.lower(F.regexp_extract(raw, _word(QUANTITY_WORDS), 0))
    return F.struct(
        raw.alias("raw"), digits(ORDER_SEEN_AS).alias("order"), digits(NOTE_PREFIXES).alias("note"), F.upper(F.regexp_extract(raw, rf"(?i)\b({'|'.join(NOTE_PREFIXES)})[\s\-._/:]*[0-9]{{3,}}", 1)).alias("prefix"),
        F.when(raw.rlike("[0-9]{2}"), F.array_join(once(plate_tokens(tight), lambda found: F.when(F.size(found) > 0, found).otherwise(plate_tokens(raw))), " / ")).otherwise("").alias("plate"),
        date(1).alias("d"), date(2).alias("m"), date(3).alias("y"), hand_number(F.regexp_extract(raw, r"[0-9]+(?:[.,][0-9]+)?", 0)).alias("n"), hand_number(F.regexp_extract(raw, "[0-9][0-9.,]*", 0)).alias("whole"),
        hand_number(F.regexp_replace(raw, "[^0-9.,]", "")).alias("all"), F.replace(unit, F.lit("³"), F.lit("3")).alias("unit"), packaging_word(raw).alias("packaging"),
        raw.rlike(_word(("kg", "greutate"))).alias("weighs"), raw.rlike(_word(("cursa", "curse", "cursă"))).alias("trips"), raw.rlike(_word(("lei", "ron", "eur"))).alias("money"),
        raw.rlike("[0-9]").alias("digits"), raw.rlike(r"→|->|–|(?i:\s(?:catre|către)\s)").alias("arrow"), raw.rlike(_word(STREET_WORDS)).alias("street"), F.length(raw).alias("length"),
    )


def kind_of(line: Column) -> Column:
    """The kind of line, by what it holds and not by its number; null if nothing fits."""
    n, weighed = line["n"], line["weighs"]
    load = n.between(LOAD_LOW, LOAD_HIGH)
    ceiling = F.coalesce(F.try_element_at(_map(CEILINGS), F.translate(line["unit"], MARKED, PLAIN)), F.lit(MOST_OF_ANY))
    measured = (line["unit"] != "") & (n > 0) & (n <= ceiling)
    first = F.lower(F.regexp_extract(line["raw"], r"^\S+", 0))
    return (
        F.when((line["order"] != "") | line["raw"].rlike("^0[0-9]{4,8}$"), "tpo")
        .when(line["note"] != "", "doc_no")
        .when(F.length(line["plate"]) >= 6, "plate")
        .when(line["d"].between(1, 31) & line["m"].between(1, 12), "doc_date")
        .when(weighed & load, "weight")
        .when(line["trips"] & n.between(1, 99), "runs")
        .when(measured, "quantity")
        .when((line["arrow"] | line["street"]) & (line["length"] >= 3) & ~weighed & (line["unit"] == ""), "route")
        .when(~line["digits"] & (line["packaging"].isNotNull() | (first.isin(*GOODS_WORDS) & (line["length"] <= 24)) | (line["length"].between(2, 20) & line["raw"].rlike(r"^[\p{L}\s-]+$"))), "goods")
        .when(n.isNull(), F.when(line["length"] >= 3, "route"))
        .when(~line["money"] & (line["unit"] == "") & (n >= 1000) & load, "weight")
        .when((n < 1000) & (line["length"] < 24) & (line["unit"] == ""), "money")
        .when((n > 0) & (n <= 5000) & line["raw"].rlike(r"^[0-9]{1,4}(?:[.,][0-9]+)?$"), "km")
    )


def values_of(line: Column, today: Column) -> dict[str, Column]:
    """For each field a struct of the value that the line would give it, as text, and how sure it is; nulls where it gives none."""
    raw, plain = line["raw"], line["plate"] == ""
    coded = (line["order"] != "") | (line["note"] != "")
    text = lambda number: number.cast("string")
    bare = F.when(line["order"] != "", line["order"]).otherwise(F.regexp_extract(raw, "[0-9]{4,}", 0))
    penalty = lambda digits: F.when(F.length(digits) == CODE_DIGITS, 0.0).otherwise(UNSURE)
    filled = F.lpad(bare, F.greatest(F.length(bare), F.lit(CODE_DIGITS)), F.lit("0"))
    money = F.when(plain & ~coded & ~line["weighs"] & ~line["trips"] & (line["unit"] == "") & ~F.regexp_replace(raw, _word(("lei", "ron", "eur")), "").rlike(r"\p{L}") & line["whole"].between(0, 1_000_000), text(line["whole"]))
    named = ~line["digits"] & line["length"].between(2, 20)
    pointed = raw.rlike(r"→|->|–|/|(?i:catre|către)") | line["street"]
    route = F.when(plain & ~line["weighs"] & ~raw.rlike(_word(("m3", "m³"))) & (line["length"] >= 3) & (pointed | (line["packaging"].isNull() & (line["digits"] | (line["length"] > 24)))), F.substr(raw, F.lit(1), F.lit(120)))
    goods = F.when(plain & ~line["weighs"] & ~raw.rlike("→|->") & (line["length"] >= 2), F.coalesce(line["packaging"], F.when(named, raw)))
    weight = F.when(plain & ~coded & ~line["trips"] & line["all"].between(LOAD_LOW, LOAD_HIGH), text(line["all"]))
    unit = F.coalesce(line["packaging"], F.when(line["unit"] != "", line["unit"]))
    quantity = F.when(plain & ~coded & ~(line["weighs"] & line["all"].between(LOAD_LOW, LOAD_HIGH)) & (line["whole"] > 0) & (line["whole"] <= F.coalesce(F.try_element_at(_map(CEILINGS), line["unit"]), F.lit(MOST_OF_ANY))), F.concat_ws(" ", text(line["whole"]), unit))
    trips = F.regexp_extract(raw, "[0-9]{1,2}", 0).try_cast("int")
    runs = F.when(plain & ~coded & ~line["weighs"] & trips.between(1, 99), text(trips))
    km = F.when(plain & ~coded & ~line["weighs"] & (line["whole"] > 0) & (line["whole"] <= 5000), text(line["whole"]))
    given = lambda v, c: once(v, lambda x: F.struct(x.alias("value"), F.when(x.isNotNull(), c).cast("double").alias("confidence")))
    fixed = lambda sure: F.lit(sure)
    told = {
        "tpo": (F.when(bare != "", F.concat(F.lit("TPO-"), filled)), F.when(line["order"] != "", F.least(F.lit(0.88) - penalty(filled) + 0.04, F.lit(0.94))).otherwise(F.lit(0.8) - penalty(filled))),
        "order_value": (money, fixed(0.84)), "taxes": (money, fixed(0.84)), "tariff": (money, fixed(0.84)),
        "plate": (F.nullif(line["plate"], F.lit("")), F.when(F.contains(line["plate"], F.lit("/")), 0.88).otherwise(0.9)),
        "route": (route, fixed(0.82)),
        "goods": (goods, F.when(line["packaging"].isNotNull(), 0.9).otherwise(0.82)),
        "quantity": (quantity, fixed(0.86)),
        "gross_kg": (weight, fixed(0.84)), "net_kg": (weight, fixed(0.84)),
        "doc_no": (F.when(line["note"] != "", F.concat_ws("-", line["prefix"], F.lpad(line["note"], F.greatest(F.length(line["note"]), F.lit(CODE_DIGITS)), F.lit("0")))), fixed(0.9)),
        "runs": (runs, fixed(0.86)), "km": (km, fixed(0.84)),
    }
    date = once(resolved_date(line["d"], line["m"], line["y"], today), lambda r: F.struct(text(r["date"]).alias("value"), r["confidence"].alias("confidence")))
    return {f: given(*pair) for f, pair in told.items()} | {"doc_date": date}


def numbered_lines(text: Column) -> Column:
    """``(no, raw)`` of lines ``1.`` to ``14.``; of a number written twice the first line counts, and a line left blank is none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n"), lambda x: F.struct(F.regexp_extract(x, r"^\s*([0-9]{1,2})[.)\-]", 1).try_cast("int").alias("no"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^\s*[0-9]{1,2}[.)\-](.*)$", 1), r"\s+", " ")).alias("raw")))
    told = F.filter(lines, lambda x: x["no"].between(1, len(GUIDE)))
    first = once(told, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda y: y["no"] == x["no"])))
    return F.filter(first, lambda x: ~F.lower(x["raw"]).isin(*BLANKS) & ~x["raw"].rlike(r"^\.+$"))


def numbered_sheets(docs: DataFrame, id_col: str, today: str, text: str = "text") -> DataFrame:
    """``id, field, value, confidence, line`` of the fields that numbered sheets fill; a sheet of fewer than three filled lines fills none.

    A line is classified by what it holds. A field takes the line of its own number if that is of its kind; fields still open take, in the guide's order, the first line of
    their kind that no field has, and are less sure of it. Money is only taken from its own line. All of a sheet is decided within its
    row: two folds over the guide, whose state is the fields filled and the lines used.
    """
    numbered = F.transform(numbered_lines(F.col("_text")), lambda x: F.struct(x["no"].alias("no"), line_of(x["raw"]).alias("line")))
    parsed = dealt(docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text")), "id").select("id", as_told(numbered, "_lines")).where(F.size("_lines") >= FEWEST)
    kinded = parsed.withColumn("_lines", F.transform("_lines", lambda x: F.struct(x["no"].alias("no"), kind_of(x["line"]).alias("kind"), x["line"].alias("line"))))

    def valued(x: Column) -> Column:
        """The line's values for the fields that take its kind; the others are not worked out."""
        values = values_of(x["line"], F.lit(today).cast("date"))
        given = [F.when(x["kind"].isin(KIND_OF[f], *ALSO.get(f, ())), values[f]) for f in GUIDE]
        return F.struct(x["no"].alias("no"), x["kind"].alias("kind"), F.array(*given).alias("values"))

    known = kinded.withColumn("_known", F.transform("_lines", valued)).drop("_lines")
    wants = F.array(*[F.array(*[F.lit(k) for k in (KIND_OF[f], *ALSO.get(f, ()))]) for f in GUIDE])
    kinds, open_ = F.array(*[F.lit(KIND_OF[f]) for f in GUIDE]), F.array(*[F.lit(f not in ONLY_GUIDE) for f in GUIDE])
    slots = F.sequence(F.lit(1), F.lit(len(GUIDE)))
    # the lines are part of the state, so that they are read once and not in every step
    nothing = (F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<slot:int,line:int,value:string,confidence:double>>").alias("got"))

    def take(state: Column, slot: Column, line: Column, sure) -> Column:
        """The state after ``slot`` takes ``line``, which may be null; nothing happens if the line has no value for it."""

        def told(x: Column) -> Column:
            given = x["values"][slot - 1]
            entry = F.struct(slot.cast("int").alias("slot"), x["no"].alias("line"), given["value"].alias("value"), sure(given["confidence"]).alias("confidence"))
            more = F.struct(state["lines"].alias("lines"), F.array_append(state["used"], x["no"]).alias("used"), F.array_append(state["got"], entry).alias("got"))
            return F.when(given["value"].isNotNull() & (given["value"] != ""), more).otherwise(state)

        return once(line, told)

    def at_guide(state: Column, slot: Column) -> Column:
        mine = F.get(F.filter(state["lines"], lambda x: (x["no"] == slot) & F.array_contains(wants[slot - 1], x["kind"])), F.lit(0))
        return take(state, slot, mine, lambda c: F.least(c, F.lit(SURE)))

    def elsewhere(state: Column, slot: Column) -> Column:
        mine = F.get(F.filter(state["lines"], lambda x: ~F.array_contains(state["used"], x["no"]) & (x["kind"] == kinds[slot - 1])), F.lit(0))
        free = open_[slot - 1] & ~F.exists(state["got"], lambda g: g["slot"] == slot)
        return F.when(free, take(state, slot, mine, lambda c: F.least(c - 0.04, F.lit(SURE_ELSEWHERE)))).otherwise(state)

    first = F.aggregate(slots, F.struct(F.col("_known").alias("lines"), *nothing), at_guide)
    filled = known.select("id", F.explode(F.aggregate(slots, first, elsewhere, lambda s: s["got"])).alias("g"))
    return filled.select("id", F.array(*[F.lit(f) for f in GUIDE])[F.col("g.slot") - 1].alias("field"), "g.value", F.round("g.confidence", 2).alias("confidence"), F.col("g.line").alias("line"))
