"""Text as scans give it: signs that are no content taken out, and printed codes and plates read through look-alikes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulspark.functions.address import COUNTIES
from haulspark.functions.text import once

# What stands for what in scans of these papers.
GLYPHS = {"ä": "ă", "Ä": "Ă", "\0": "\t", "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "«": '"', "»": '"'}
LETTERS_WITH_MARKS = "ăâîșțşţĂÂÎȘȚŞŢäÄéèöüÖÜ"
#: How the letters of code prefixes are misread, and digits of their numbers; what is noise among them.
SEEN_AS = {"P": "P", "S": "S5", "L": "L1I", "T": "T", "R": "R", "O": "O0Q"}
DIGIT_OF = {"I": "1", "L": "1", "O": "0", "C": "0", "P": "0"}
NOISE = "&$SBQ"
PREFIXES = ("PSL", "TPO", "TRO")
PLACES = {"MIMARFA": "MMARFA", "MIIMARFA": "MMARFA", "MMMARFA": "MMARFA", "Bolintin Dina": "Bolintin-Deal", "Bolintin Deal": "Bolintin-Deal", "Bolintin Dea1": "Bolintin-Deal", "Bolintin DeaI": "Bolintin-Deal", "Industriului": "Industriei", "Kepublicii": "Republicii"}
BOULEVARDS = ("Bulevardul", "Blvd", "Bvd", "Bld", "Bd", "B-dul", "Bdul")


def rewritten(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` replaced by what ``by`` makes of it; ``text`` is worked out once."""

    def told(t: Column) -> Column:
        pieces, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        joined = F.array_join(F.zip_with(pieces, found, lambda piece, match: F.concat(piece, F.coalesce(F.when(match.isNotNull(), by(match)), F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return once(text, told)


def _composed(text: Column) -> Column:
    for letter in LETTERS_WITH_MARKS:
        text = F.replace(text, F.lit(unicodedata.normalize("NFD", letter)), F.lit(letter))
    return text


def _cell(cell: Column) -> Column:
    """A cell without bars, boxes, marks of emphasis and runs of one sign, its blanks single."""
    bare = F.regexp_replace(cell, r"\*{2}|_{2}", "")
    bare = F.regexp_replace(bare, r"[|\p{InBoxDrawing}]|([^\p{L}\p{N}_\s])\1{3,}", " ")
    return F.trim(F.regexp_replace(bare, " {2,}", " "))


def _line(line: Column) -> Column:
    """A line, its cells between tabs made plain one by one; a line that only rules a table is empty."""
    signs = F.regexp_replace(line, r"\s", "")
    ruler = (F.length(line) >= 3) & (F.translate(signs, "|:-=_", "") == "")
    return F.when(ruler, "").otherwise(F.array_join(F.transform(F.split(line, "\t"), _cell), "\t"))


def clean_scan(text: Column) -> Column:
    """Text of one spelling: composed letters, plain quotes, dashes and blanks, no invisible or control signs, no table rules.

    A dollar sign within a word is the letter it is misread for. Tabs part cells and stay; of empty lines in a row one stays. Null stays null.
    """
    one = F.translate(_composed(text), "".join(GLYPHS), "".join(GLYPHS.values()))
    one = F.regexp_replace(one, r"(?<=\p{L})\$(?=i\b)", "șt")
    one = F.regexp_replace(one, r"(?<=\p{L})\$(?=\p{L})", "ș")
    one = F.regexp_replace(one, r"[\p{Cf}\p{Cc}&&[^\t\n\r]]", "")
    one = F.regexp_replace(F.regexp_replace(one, r"\p{Zs}", " "), "[\\p{Pd}−]", "-")
    lines = F.transform(F.split(one, "\r\n|\r|\n"), _line)
    kept = once(lines, lambda all_: F.filter(all_, lambda line, i: (line != "") | ((i > 0) & (F.get(all_, i - 1) != ""))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def _spelled(prefix: str) -> str:
    """A pattern for ``prefix`` as it may be read, with a blank between letters; the L that closes one may be lost."""
    letters = [f"[{SEEN_AS[c]}]" for c in prefix]
    if prefix == "TRO":
        letters[0] = "[TI]"
    return r"[ ]?".join(letters[:-1]) + "[ ]?" + letters[-1] + ("?" if prefix == "PSL" else "")


def _digits(tail: Column) -> Column:
    """The digits that a tail stands for."""
    whole = F.translate(F.upper(tail), NOISE, "")
    return F.regexp_replace(F.translate(whole, "".join(DIGIT_OF), "".join(DIGIT_OF.values())), "[^0-9]", "")


def _code(prefix: str, sign: str):
    def by(match: Column) -> Column:
        tail = F.regexp_replace(match, rf"(?i)^{_spelled(prefix)}{sign}*", "")
        return once(_digits(tail), lambda d: F.when(F.length(d) >= 4, F.concat(F.lit(f"{prefix}-"), d)).otherwise(match))

    return by


def _plate(match: Column) -> Column:
    parts = rf"(?i)^({'|'.join(COUNTIES)})[\s.\-]*([0-9OQDIL]{{2,3}})[\s.\-]*([A-Z]{{3}})$"
    county, number, letters = (F.upper(F.regexp_extract(match, parts, n)) for n in (1, 2, 3))
    return F.when(number.rlike("[0-9]"), F.concat_ws(" ", county, F.translate(number, "OQDIL", "00011"), letters)).otherwise(match)


def scanned_codes(text: Column) -> Column:
    """``clean_scan`` with order, document and plate numbers written as they are printed, and words that scans of these papers break.

    Prefixes and digits are read through their look-alikes; a code of fewer than four digits stays as it is, as does a plate without any digit.
    A transfer's order number that is named as a shipping note's is a note number. Null stays null.
    """
    sign, tail, any_code = r"[\s\-._/:]", f"[0-9{''.join(DIGIT_OF)}{NOISE}ilq]", "|".join(PREFIXES)
    out = clean_scan(text)
    out = F.regexp_replace(out, rf"(?i)(?<=\p{{L}}|_)(?=(?:{any_code}){sign}*[0-9OI])", " ")
    out = F.regexp_replace(out, r"_ (?=[TP])", " ")
    note = r"(?i)((?:aviz\s+de\s+expedi[țt]ie(?!\s+rezumat)|comanda\s+de\s+transfer)\s*[:\-]?\s*)TP[O0QD]\b"
    out = F.regexp_replace(out, note, "$1TRO")
    out = F.regexp_replace(out, r"(?i)(?<=[0-9] |[0-9]  )s ?a ?c\b", "sac")
    out = rewritten(out, r"(?i)\b[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][12][0-9O]{3}\b", lambda d: F.translate(d, "Oo", "00"))
    for seen, place in PLACES.items():
        out = F.regexp_replace(out, r"(?i)\b" + r"[\s\-._]*".join(seen.split(" ")) + r"\b", place)
    out = F.regexp_replace(out, rf"(?i)\b((?:{'|'.join(BOULEVARDS)})\.?)\s+Piperii\b", "$1 Pipera")
    out = F.regexp_replace(out, rf"(?im)\b((?:TRO|PSL){sign}*[0-9OI]{{2,8}})\n(?=[0-9]{{3,10}}$)", "$1 ")
    for prefix in PREFIXES:
        more = "" if prefix == "TPO" else rf"(?:[ \t\-]+{tail}{{2,10}})?"
        out = rewritten(out, rf"(?i)(?<![A-Za-z0-9]){_spelled(prefix)}{sign}*{tail}{{3,14}}{more}\b", _code(prefix, sign))
    return rewritten(out, rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(COUNTIES)})[\s.\-]*[0-9OQDIL]{{2,3}}[\s.\-]*[A-Z]{{3}}(?![A-Za-z0-9])", _plate)
