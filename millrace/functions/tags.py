"""Machine tags: canonical form, scanning, kind of machine, readings of misrecognised tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "^[A-Z]{1,4}-[0-9]{2,5}[A-Z]{0,2}$"
#: Prefixes that look like tags and are none; fixed values.
NOT_TAGS = ["ISO", "API", "IEC", "ASME", "DN", "PN", "REV", "RPM", "HW", "OISD", "IS", "SS"]
#: Kinds of machines by prefix; fixed values.
KINDS = {
    "P": "pump", "BP": "pump", "CP": "pump", "C": "compressor", "K": "compressor", "V": "vessel", "D": "vessel", "KOD": "vessel", "E": "heat_exchanger", "HE": "heat_exchanger",
    "TK": "tank", "M": "motor", "R": "reactor", "FL": "filter", "STR": "filter", "CV": "valve", "XV": "valve", "PSV": "valve", "FIC": "instrument", "LIC": "instrument", "PIC": "instrument", "TIC": "instrument",
}
_DASHES = "‐‑‒–—―−"


def canonical_tag(text: Column) -> Column:
    """Upper case, one dash between prefix and number; null for anything that is no tag."""
    plain = F.upper(F.trim(F.translate(text, _DASHES, "-" * len(_DASHES))))
    tag = F.regexp_replace(F.regexp_replace(plain, r"[\s_/.-]+", "-"), "^([A-Z]{1,4})([0-9])", "$1-$2")
    return F.when(tag.rlike(TAG) & ~F.regexp_extract(tag, "^([A-Z]+)", 1).isin(NOT_TAGS), tag)


def scan_tags(text: Column) -> Column:
    """All tags of a text in order of their first appearance, with an explicit separator."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z]{1,4}-[0-9]{2,5}[A-Z]?)\b"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda t: ~F.regexp_extract(t, "^([A-Z]+)", 1).isin(NOT_TAGS))


def kind_of_machine(tag: Column) -> Column:
    prefix = F.regexp_extract(tag, "^([A-Z]+)-", 1)
    out = F.when(F.lit(False), F.lit(""))
    for p, kind in KINDS.items():
        out = out.when(prefix == p, kind)
    return out


#: Digits that stand for letters at the front of a tag, and letters that stand for digits behind; fixed values.
LETTER_GLYPHS, DIGIT_GLYPHS = ("015826", "OISBZG"), ("OQDILZSGTB", "0001125678")


def positional_reading(compact: Column, prefix: int, suffix: int) -> Column:
    """What letters and digits in a row read as if ``prefix`` of them are letters, the last ``suffix`` too, and the rest digits."""
    front = F.translate(F.substring(compact, F.lit(1), F.lit(prefix)), *LETTER_GLYPHS)
    middle = F.translate(F.substring(compact, F.lit(prefix + 1), F.length(compact) - prefix - suffix), *DIGIT_GLYPHS)
    back = F.translate(F.substring(compact, F.length(compact) - suffix + 1, F.lit(suffix)), *LETTER_GLYPHS) if suffix else F.lit("")
    return F.concat(front, F.lit("-"), middle, back)


def kind_by_longest_prefix(tag: Column) -> Column:
    """As :func:`kind_of_machine`, an unknown prefix counting as the longest front of it that is known."""
    prefix = F.regexp_extract(tag, "^([A-Z]+)", 1)
    fronts = [prefix, *[F.substring(prefix, 1, n) for n in (3, 2, 1)]]
    return F.coalesce(*[kind_of_machine(F.concat(front, F.lit("-"))) for front in fronts])
