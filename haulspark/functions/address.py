"""Addresses: parts, keys, quality, and how well a found place fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulspark.functions.numeric import half_up
from haulspark.functions.text import MARKED, PLAIN, once

# Words of an address and what they are written as; "al" and "dr" are left alone, as names hold them.
WORDS = {
    "str": "strada", "stra": "strada", "strada": "strada",
    "bd": "bulevardul", "bvd": "bulevardul", "bdul": "bulevardul", "blv": "bulevardul", "blvd": "bulevardul", "bld": "bulevardul", "bulevard": "bulevardul", "bulevardul": "bulevardul",
    "sos": "soseaua", "soseaua": "soseaua", "cal": "calea", "calea": "calea", "pta": "piata", "piata": "piata",
    "nr": "nr", "no": "nr", "numarul": "nr", "bl": "bl", "blocul": "bl", "sc": "sc", "scara": "sc", "ap": "ap", "apartament": "ap", "apartamentul": "ap", "et": "et", "etaj": "et", "etajul": "et",
    "jud": "jud", "judetul": "jud", "judet": "jud", "com": "com", "comuna": "com", "sat": "sat", "satul": "sat", "mun": "mun", "municipiul": "mun", "or": "oras", "oras": "oras", "orasul": "oras",
}
# Words that name a kind of street, and those after which numbers are no house numbers.
STREET_KINDS = ("strada", "bulevardul", "soseaua", "calea", "aleea", "piata", "intrarea", "drumul", "splaiul", "prelungirea", "zona", "parcul", "cartierul", "dn", "km")
INSIDE = ("bl", "sc", "ap", "et")
# Counties by code.
COUNTIES = {
    "AB": "alba", "AR": "arad", "AG": "arges", "BC": "bacau", "BH": "bihor", "BN": "bistrita nasaud", "BT": "botosani", "BR": "braila", "BV": "brasov", "B": "bucuresti", "BZ": "buzau",
    "CL": "calarasi", "CS": "caras severin", "CJ": "cluj", "CT": "constanta", "CV": "covasna", "DB": "dambovita", "DJ": "dolj", "GL": "galati", "GR": "giurgiu", "GJ": "gorj", "HR": "harghita",
    "HD": "hunedoara", "IL": "ialomita", "IS": "iasi", "IF": "ilfov", "MM": "maramures", "MH": "mehedinti", "MS": "mures", "NT": "neamt", "OT": "olt", "PH": "prahova", "SJ": "salaj", "SM": "satu mare",
    "SB": "sibiu", "SV": "suceava", "TR": "teleorman", "TM": "timis", "TL": "tulcea", "VL": "valcea", "VS": "vaslui", "VN": "vrancea",
}
# Towns known by name and the codes of their counties.
TOWNS = {
    "bucuresti": "B", "otopeni": "IF", "voluntari": "IF", "buftea": "IF", "pantelimon": "IF", "popesti leordeni": "IF", "bragadiru": "IF", "chitila": "IF", "chiajna": "IF",
    "magurele": "IF", "cluj napoca": "CJ", "turda": "CJ", "dej": "CJ", "campia turzii": "CJ", "timisoara": "TM", "lugoj": "TM", "iasi": "IS", "pascani": "IS", "constanta": "CT",
    "mangalia": "CT", "medgidia": "CT", "navodari": "CT", "craiova": "DJ", "calafat": "DJ", "brasov": "BV", "fagaras": "BV", "sacele": "BV", "codlea": "BV", "galati": "GL", "tecuci": "GL",
    "ploiesti": "PH", "campina": "PH", "oradea": "BH", "salonta": "BH", "braila": "BR", "arad": "AR", "pitesti": "AG", "mioveni": "AG", "campulung": "AG", "sibiu": "SB", "medias": "SB",
    "bacau": "BC", "onesti": "BC", "moinesti": "BC", "targu mures": "MS", "reghin": "MS", "sighisoara": "MS", "baia mare": "MM", "sighetu marmatiei": "MM", "buzau": "BZ",
    "ramnicu sarat": "BZ", "botosani": "BT", "dorohoi": "BT", "satu mare": "SM", "carei": "SM", "ramnicu valcea": "VL", "drobeta turnu severin": "MH", "suceava": "SV", "radauti": "SV",
    "falticeni": "SV", "piatra neamt": "NT", "roman": "NT", "targu jiu": "GJ", "motru": "GJ", "targoviste": "DB", "focsani": "VN", "adjud": "VN", "bistrita": "BN", "resita": "CS",
    "caransebes": "CS", "tulcea": "TL", "slatina": "OT", "caracal": "OT", "calarasi": "CL", "oltenita": "CL", "alba iulia": "AB", "sebes": "AB", "aiud": "AB", "giurgiu": "GR", "deva": "HD",
    "hunedoara": "HD", "petrosani": "HD", "orastie": "HD", "zalau": "SJ", "sfantu gheorghe": "CV", "targu secuiesc": "CV", "vaslui": "VS", "barlad": "VS", "husi": "VS", "slobozia": "IL",
    "fetesti": "IL", "urziceni": "IL", "alexandria": "TR", "rosiorii de vede": "TR", "turnu magurele": "TR", "miercurea ciuc": "HR", "odorheiu secuiesc": "HR", "gheorgheni": "HR",
}
# Confidence of what a search found, by how fine it is, and from which a place is taken or flagged.
PRECISION = {"address": 0.55, "street": 0.40, "locality": 0.25}
OTHER_PRECISION, TAKEN, FLAGGED = 0.20, 0.8, 0.45


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def words(text: Column) -> Column:
    """Words of an address without marks and punctuation, each as it is written in full."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), r"[.,;:()/\\\-\s]+", " "))
    table = _table(WORDS)
    return F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(table, w), w))


def _join(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _rest(tokens: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(tokens, n + 1, F.greatest(F.size(tokens) - n, F.lit(0)))


def _town(tokens: Column) -> Column:
    """(town, county, words) of the longest run of leading words that is a known town; null if there is none."""
    table = _table(TOWNS)
    names = F.transform(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda n: F.struct(_join(F.slice(tokens, 1, n)).alias("town"), n.alias("words")))
    found = F.filter(names, lambda x: (x["words"] <= F.size(tokens)) & F.try_element_at(table, x["town"]).isNotNull())
    return F.get(F.transform(found, lambda x: F.struct(x["town"].alias("town"), F.try_element_at(table, x["town"]).alias("county"), x["words"].alias("words"))), F.lit(0))


def house_number(tokens: Column) -> Column:
    """The number after ``nr``, else the last one before block, stair, flat or floor."""
    is_number = lambda w: w.rlike("^[0-9]+[a-z]?$")
    named = F.get(tokens, F.array_position(tokens, F.lit("nr")).cast("int"))
    ends = F.filter(F.transform(tokens, lambda w, i: F.when(w.isin(*INSIDE), i)), lambda i: i.isNotNull())
    outside = F.slice(tokens, 1, F.coalesce(F.get(ends, F.lit(0)), F.size(tokens)))
    last = F.try_element_at(F.filter(outside, is_number), F.lit(-1))
    return F.when(F.array_contains(tokens, "nr") & is_number(named), named).otherwise(last)


def parse(text: Column) -> Column:
    """``street, city, county, postcode, house_number, is_rural, city_known, has_street_kind, raw`` of a free-text address.

    Parts between commas are read in turn: a county by name or code, a village or commune, a town that is named as
    one or known, words with a kind of street, else the first part is the town and later ones belong to the street.
    What is absent is null.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    segments = F.filter(F.transform(F.split(raw, ","), lambda s: F.struct(F.trim(s).alias("raw"), words(s).alias("words"))), lambda s: F.size(s["words"]) > 0)
    county_names, codes = _table({name: code for code, name in COUNTIES.items()}), list(COUNTIES)
    told = F.transform(
        segments,
        lambda s: F.struct(
            s["raw"].alias("raw"), s["words"].alias("words"), _town(s["words"]).alias("town"), _town(_rest(s["words"], 1)).alias("named"),
            _join(_rest(s["words"], 1)).alias("rest"), F.get(s["words"], F.lit(0)).alias("first"),
        ),
    )

    def state(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(c, s[c]).alias(c) for c in ("city", "known", "county", "rural", "streets")])

    def step(s: Column, x: Column) -> Column:
        upper = F.upper(x["first"])
        by_name = F.coalesce(F.try_element_at(county_names, x["rest"]), F.when(F.upper(x["rest"]).isin(*codes), F.upper(x["rest"])), s["county"])
        rest = F.nullif(x["rest"], F.lit(""))
        known = x["town"].isNotNull() & ~s["known"]
        after = _join(_rest(x["words"], x["town"]["words"]))
        more = lambda part: F.concat(s["streets"], F.array(part))
        return (
            F.when(x["first"] == "jud", state(s, county=by_name))
            .when((F.size(x["words"]) == 1) & upper.isin(*codes), state(s, county=F.coalesce(s["county"], upper)))
            .when(x["first"].isin("sat", "com"), state(s, rural=F.lit(True), city=F.coalesce(s["city"], rest)))
            .when(x["first"].isin("mun", "oras"), state(s, city=F.coalesce(x["named"]["town"], rest, s["city"]), county=F.coalesce(s["county"], x["named"]["county"]), known=s["known"] | x["named"].isNotNull()))
            .when(known, state(s, city=x["town"]["town"], county=F.coalesce(s["county"], x["town"]["county"]), known=F.lit(True), streets=F.when(after != "", more(after)).otherwise(s["streets"])))
            .when(F.arrays_overlap(x["words"], F.array(*[F.lit(k) for k in STREET_KINDS])), state(s, streets=more(x["raw"])))
            .when(s["city"].isNull(), state(s, city=_join(x["words"])))
            .otherwise(state(s, streets=more(x["raw"])))
        )

    start = F.struct(F.lit(None).cast("string").alias("city"), F.lit(False).alias("known"), F.lit(None).cast("string").alias("county"), F.lit(False).alias("rural"), F.array().cast("array<string>").alias("streets"))
    # each step is bound to a variable, so that none is written out, or worked out, more than once
    bound = lambda value, f: F.transform(F.array(value), f)[0]
    done = bound(F.aggregate(told, start, step), lambda s: F.struct(F.nullif(F.array_join(s["streets"], ", "), F.lit("")).alias("street"), s["city"].alias("city"), s["county"].alias("county"), s["rural"].alias("rural"), s["known"].alias("known")))
    with_words = bound(done, lambda d: F.struct(d.alias("d"), words(d["street"]).alias("words")))
    return bound(
        with_words,
        lambda x: F.struct(
            x["d"]["street"].alias("street"), x["d"]["city"].alias("city"), x["d"]["county"].alias("county"), F.nullif(F.regexp_extract(raw, r"\b([0-9]{6})\b", 1), F.lit("")).alias("postcode"),
            house_number(x["words"]).alias("house_number"), x["d"]["rural"].alias("is_rural"), x["d"]["known"].alias("city_known"),
            F.arrays_overlap(x["words"], F.array(*[F.lit(k) for k in STREET_KINDS])).alias("has_street_kind"), raw.alias("raw"),
        ),
    )


def address_key(parsed: Column) -> Column:
    """What addresses are the same by: county, town and street without ``nr``; null for an empty address."""
    street = _join(F.filter(words(parsed["street"]), lambda w: w != "nr"))
    parts = F.filter(F.array(F.lower(F.coalesce(parsed["county"], F.lit(""))), _join(words(parsed["city"])), street), lambda p: p != "")
    # both are worked out in any case: in a branch Spark would build the tables of words anew for every row
    told = F.struct(F.array_join(parts, "|").alias("parts"), _join(words(parsed["raw"])).alias("raw"))
    return once(told, lambda t: F.when(t["parts"] != "", t["parts"]).when(t["raw"] != "", t["raw"]))


def quality(parsed: Column) -> Column:
    """``score, tier, flags``: how likely the address is to be found.

    A known town counts 0.4 and another 0.2, kind of street, number and county 0.2 each; at most 0.75 without a number
    and 0.6 in the country. An empty address is 0.
    """
    p, empty = parsed, parsed["raw"] == ""
    town = F.when(p["city_known"], 0.4).when(p["city"].isNotNull(), 0.2).otherwise(0.0)
    part = lambda ok: F.when(ok, 0.2).otherwise(0.0)
    total = town + part(p["has_street_kind"]) + part(p["house_number"].isNotNull()) + part(p["county"].isNotNull())
    capped = F.least(F.lit(1.0), total, F.when(p["house_number"].isNull(), 0.75).otherwise(1.0), F.when(p["is_rural"], 0.6).otherwise(1.0))
    score = F.when(empty, 0.0).otherwise(half_up(capped, 2))
    flags = F.filter(
        F.array(
            F.when(~p["city_known"], F.when(p["city"].isNotNull(), "oras_nerecunoscut").otherwise("fara_oras")), F.when(~p["has_street_kind"], "fara_tip_strada"),
            F.when(p["house_number"].isNull(), "fara_numar"), F.when(p["county"].isNull(), "fara_judet"), F.when(p["is_rural"], "rural"),
        ),
        lambda f: f.isNotNull(),
    )
    return F.struct(score.alias("score"), tier(score).alias("tier"), F.when(empty, F.array(F.lit("fara_adresa"))).otherwise(flags).alias("flags"))


def tier(score: Column) -> Column:
    return F.when(score >= 0.8, "good").when(score >= 0.5, "review").otherwise("poor")


def postcode(text: Column) -> Column:
    """Six digits; five are padded with the zero that was lost; null otherwise."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) == 6, digits).when(F.length(digits) == 5, F.lpad(digits, 6, "0"))


def plausible_leg(display: Column) -> Column:
    """Whether a parsed leg looks like an address: no firm's name, a house number that is one, a town of letters."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(display, F.lit(""))), MARKED, PLAIN), "[^a-z0-9]+", " "))
    house = F.regexp_extract(display, r"(?i)\bnr\.?\s*([^\s,]+)", 1)
    town = F.regexp_extract(display, r"^[^,]*, (.*)$", 1)
    return (
        (plain != "") & ~plain.rlike("(?:^| )(?:srl|s r l|sa|snc|scs|ltd|gmbh|pfa)(?: |$)")
        & ((house == "") | house.rlike("(?i)^[0-9]{1,4}[a-z]{0,2}(?:[-/][0-9a-z]{1,6})?$")) & ((F.trim(town) == "") | F.trim(town).rlike(r"^\p{L}[\p{L} .-]*$"))
    )


def match_score(precision: Column, same_city: Column, same_street: Column, same_number: Column, same_postcode: Column, country: Column) -> Column:
    """Fit of a found place: precision, then what agrees or differs (null: not known); another country is 0."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PRECISION.items() for x in pair]), precision), F.lit(OTHER_PRECISION))
    agree = lambda c, plus, minus: F.when(c, plus).when(~c, minus).otherwise(0.0)
    city = F.when(same_city == "same", 0.2).when(same_city == "partial", 0.1).when(same_city == "different", -0.15).otherwise(0.0)
    total = base + city + agree(same_street, 0.1, -0.3) + agree(same_number, 0.15, -0.1) + F.when(same_postcode, 0.05).otherwise(0.0)
    return F.when(F.upper(F.coalesce(country, F.lit("RO"))) != "RO", 0.0).otherwise(half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 2))


def accept(score: Column) -> Column:
    """From 0.8 a place is taken, from 0.45 it is flagged, below nothing is."""
    return F.when(score >= TAKEN, "accepted").when(score >= FLAGGED, "flagged").otherwise("rejected")
