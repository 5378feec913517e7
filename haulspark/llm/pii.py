"""Format-preserving pseudonyms for personal data, in DataFrame functions alone (operator 9)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
ACCENTED_UPPER = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒ"
EXTENDED = "".join(map(chr, range(0x100, 0x180)))
GREEK, GREEK_UPPER = "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώϊϋΐΰς", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏΪΫ"
CYRILLIC, CYRILLIC_UPPER = "".join(map(chr, range(0x430, 0x460))), "".join(map(chr, range(0x400, 0x430)))
LETTERS_AND_DIGITS = (DIGITS, LOWER, UPPER, ACCENTED, ACCENTED_UPPER, EXTENDED, GREEK, GREEK_UPPER, CYRILLIC, CYRILLIC_UPPER)
#: Letters of no alphabet above move within runs of so many code points.
RUN = 32

#: Country codes of one and two digits in telephone numbers; all others have three.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: What may be a value, by kind and in the order they are tried; look-arounds keep a match from starting within a word.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "secret": r"(?i:(?<![a-z])(?:token|secret|password|api[_\-]?key)\s{0,3}[=:]\s{0,3}(?:\"[A-Za-z0-9+/_\-]{8,200}\"|'[A-Za-z0-9+/_\-]{8,200}'|(?=[A-Za-z+/_\-]{0,199}[0-9])[A-Za-z0-9+/_\-]{16,200}))",
    "key": r"(?<![A-Za-z0-9_\-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64})(?![A-Za-z0-9_\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?<!(?:[Vv]ersion|[Vv]er|[Rr]elease)[ ])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./\-][0-9])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ \-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ \-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())


def _number(hexadecimal: Column, at: Column | int, n: int) -> Column:
    return F.conv(F.substr(hexadecimal, F.lit(at) if isinstance(at, int) else at, F.lit(n)), 16, 10).cast("long")


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of ``message`` in UTF-8 under ``key``, in lower-case hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _moved(half: Column, other: Column, key: str, i: Column, alphabets: tuple[str, ...], always: bool = False) -> Column:
    """Each character of ``half`` moved on in its own alphabet by a byte of the keyed hash of ``other``; an empty half stays.

    With ``always`` no character may stay as it is. Under all alphabets, a letter or digit of a script that has none moves within its run of
    ``RUN`` code points, which may hold signs that are no letters.
    """
    digest = F.array(hmac(key, F.concat_ws("|", i.cast("string"), other)))  # in an array, so that it is made once

    def move(c: Column, j: Column) -> Column:
        step = _number(digest[0], (j % 32) * 2 + 1, 2)
        point = F.ascii(c)
        other = (point - point % RUN + (point % RUN + (step % (RUN - 1) + 1 if always else step)) % RUN).cast("long")
        out = F.when((point > 0xAA) & c.rlike(r"^[\p{L}\p{M}\p{N}]"), F.decode(F.unhex(F.lpad(F.hex(other), 8, "0")), "UTF-32")).otherwise(c) if len(alphabets) > 4 else c
        for letters in reversed(alphabets):
            at = F.instr(F.lit(letters), c)
            by = step % (len(letters) - 1) + 1 if always else step
            out = F.when(at > 0, F.substr(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), move), ""))


def feistel(value: Column, key: str, alphabets: tuple[str, ...] = LETTERS_AND_DIGITS) -> Column:
    """A keyed permutation of strings that keeps length, punctuation and each character's alphabet.

    An alternating Feistel network over the two halves: each round moves one half by a hash of the other, so equal
    values have equal pseudonyms and different ones have different. One character has no halves: it is moved on in
    its alphabet by a keyed step.
    """
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1).alias("r"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.when(i % 2 == 1, F.struct(_moved(s["l"], s["r"], key, i, alphabets).alias("l"), s["r"].alias("r")))
        .otherwise(F.struct(s["l"].alias("l"), _moved(s["r"], s["l"], key, i, alphabets).alias("r"))),
        lambda s: F.concat(s["l"], s["r"]),
    )
    return F.when(F.length(value) == 1, _moved(value, F.lit(""), key, F.lit(0), alphabets, always=True)).otherwise(done)


def feistel_pair(x: Column, y: Column, a: int, b: int, key: str) -> Column:
    """A keyed permutation of pairs (x below ``a``, y below ``b``), as a struct of longs."""
    mix = lambda v, i, n: _number(hmac(key, F.concat_ws("|", i.cast("string"), v.cast("string"))), 1, 12) % n
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")),
        lambda s, i: F.when(i % 2 == 1, F.struct(((s["x"] + mix(s["y"], i, a)) % a).alias("x"), s["y"].alias("y")))
        .otherwise(F.struct(s["x"].alias("x"), ((s["y"] + mix(s["x"], i, b)) % b).alias("y"))),
    )


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum; a whole number is valid if it is a multiple of ten."""
    weighed = F.transform(F.split(F.reverse(digits), ""), lambda c, j: (c.cast("int") * (1 + j % 2)))
    return F.aggregate(weighed, F.lit(0), lambda s, d: s + F.floor(d / 10).cast("int") + d % 10)


def _refill(shape: Column, chars: Column, which: str = "[0-9]") -> Column:
    """``shape`` with its characters of ``which`` replaced in turn by those of ``chars``."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike(which), F.struct(F.concat(s["out"], F.substr(chars, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last becomes the check digit that fits them."""
    digits = digits_of(value)
    body = feistel(F.substr(digits, F.lit(1), F.length(digits) - 1), key, (DIGITS,))
    filled = F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return _refill(value, filled)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a number written in digits and letters (A is 10)."""
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(value(c) > 9, s * 100 + value(c)).otherwise(s * 10 + value(c)) % 97)


def _iban_ok(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)


def _iban(value: Column, key: str) -> Column:
    """The account is permuted, the country kept, and the check digits become those that fit; spaces stay where they are."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substr(plain, F.lit(1), F.lit(2))
    body = feistel(F.substr(plain, F.lit(5)), key, (DIGITS, UPPER))
    whole = F.transform(F.array(body), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))[0]
    return _refill(value, whole, "[A-Z0-9]")


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda o: o.cast("int"))


def _ip(value: Column, key: str) -> Column:
    packed = F.array_join(F.transform(_octets(value), lambda o: F.lower(F.lpad(F.hex(o), 2, "0"))), "")
    return F.transform(F.array(feistel(packed, key, (HEX,))), lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda at: _number(h, at, 2).cast("string")), "."))[0]


#: Dates are permuted within six cycles of 400 years, each of 146,097 days: from 1 January 1600 to 31 December 3999.
FIRST_DAY, CYCLES, CYCLE = "1600-01-01", 6, 146_097


def _day(value: Column) -> Column:
    year_first = value.rlike("^[0-9]{4}-")
    parts = F.split(value, "[-/.]")
    iso = F.when(year_first, value).otherwise(F.concat_ws("-", parts[2], parts[1], parts[0]))
    return F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))


def _date(value: Column, key: str) -> Column:
    n = _day(value)
    pair = feistel_pair(F.floor(n / CYCLE), n % CYCLE, CYCLES, CYCLE, key)
    day = F.transform(F.array(pair), lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * CYCLE + p["y"]).cast("int")))[0]
    return (
        F.when(value.contains("/"), F.date_format(day, "dd/MM/yyyy")).when(value.contains("."), F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def _ssn(value: Column, key: str) -> Column:
    """Area (1 to 899 but 666), group and serial from 1, permuted among the numbers that may be issued."""
    part = lambda at, n: F.substr(value, F.lit(at), F.lit(n)).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    pair = feistel_pair(area, (part(5, 2) - 1) * 9999 + part(8, 4) - 1, 898, 99 * 9999, key)
    text = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    return F.transform(
        F.array(pair),
        lambda p: F.concat_ws("-", text(p["x"] + F.when(p["x"] >= 665, 2).otherwise(1), 3), text(F.floor(p["y"] / 9999) + 1, 2), text(p["y"] % 9999 + 1, 4)),
    )[0]


def kind_of(value: Column) -> Column:
    """The kind of a matched value, null if it does not validate."""
    is_a = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    digits = digits_of(value)
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike("[=:]"), "secret")
        .when(is_a("key"), "secret")
        .when(value.rlike("^[A-Z]"), F.when(_iban_ok(value), "iban"))
        .when(is_a("ip"), F.when(F.forall(_octets(value), lambda o: o <= 255), "ip"))
        .when(is_a("date"), F.when(_day(value).between(0, CYCLES * CYCLE - 1), "date"))
        .when(is_a("ssn"), F.when(~value.rlike("^(000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$"), "ssn"))
        .when(is_a("card"), F.when((luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$"), "card"))
        .when(is_a("phone"), F.when(F.length(digits).between(8, 15), "phone"))
    )


def pseudonym(value: Column, key: str) -> Column:
    """The value's pseudonym by kind; a value that does not validate stays as it is."""
    kind = kind_of(value)
    local, domain = F.regexp_extract(value, "^(.*)@", 1), F.regexp_extract(value, "(@.*)$", 1)
    parts = "^((?:[^=:]*[=:]\\s*|AKIA|gh[pousr]_|sk-)[\"']?)([^\"']*)([\"']?)$"
    head, secret, tail = (F.regexp_extract(value, parts, n) for n in (1, 2, 3))
    code = F.regexp_extract(value, f"^({COUNTRY})?", 0)
    rest = F.substr(value, F.length(code) + 1)
    hexadecimal = (DIGITS, "abcdef", "ABCDEF")
    return (
        F.when(kind == "email", F.concat(feistel(local, key), domain))
        .when(kind == "secret", F.concat(head, F.when(secret.rlike("^[0-9a-fA-F]+$"), feistel(secret, key, hexadecimal)).otherwise(feistel(secret, key)), tail))
        .when(kind == "iban", _iban(value, key))
        .when(kind == "ip", _ip(value, key))
        .when(kind == "date", _date(value, key))
        .when(kind == "ssn", _ssn(value, key))
        .when(kind == "card", _card(value, key))
        .when(kind == "phone", F.concat(code, _refill(rest, feistel(digits_of(rest), key, (DIGITS,)))))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced, and ``pii_kinds``, the kinds found in their order.

    Cards (Luhn), IBANs (mod 97, with or without spaces), IPv4 addresses, dates of the calendar from 1600 to 3999,
    social security numbers, phones, e-mail names, values given to a token, secret, password or key, and keys of
    known shapes are replaced by keyed permutations within their own format: a card stays a valid card of its length,
    a date a date. Equal values have equal pseudonyms in all documents: a phone, card or IBAN however it is grouped,
    a date in each notation. The permutation is a Feistel network whose rounds are HMACs under ``key``, which is to be
    kept secret. Numbers that do not validate, and all other text, stay byte for byte. A null text stays null and has
    no kinds; rows that repeat are treated alike; other columns are kept, and a column named ``pii_kinds`` is
    overwritten. Long texts are replaced whole. Every row is handled on its own, without a shuffle; no rows give no rows.
    """
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(pieces, found, lambda piece, value: F.concat(piece, F.coalesce(pseudonym(value, key), F.lit("")))), "")
    maybe = text.rlike("[0-9@=:]|sk-|gh[pousr]_")  # every value holds one of these
    kinds = F.filter(F.transform(found, kind_of), lambda k: k.isNotNull())
    none = F.array().cast("array<string>")
    return docs.withColumns({"pii_kinds": F.coalesce(F.when(maybe, kinds), none), text_col: F.when(maybe, joined).otherwise(text)})


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of this query is no secret: its result is to be compared, not published."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key="a key for checks").select("doc_id", "text", "pii_kinds")
