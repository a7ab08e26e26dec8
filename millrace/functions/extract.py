"""Extractions that keep within expressions: steps, intervals, masks, citations, glyph readings, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.tags import scan_tags

#: Classes of questions: pattern over lower-case text and its weight; fixed values.
QUESTION_CLASSES = {
    "diagnostic": [(r"\bwhy\b", 1.0), (r"\bcause|reason\b", 0.8), (r"\btrip(ped)?\b", 0.6), (r"\bleak(ing|s)?\b", 0.5)],
    "history": [(r"\bwhen\b", 0.7), (r"\bhistory\b", 1.0), (r"\blast\b", 0.5), (r"\bsince\b", 0.6), (r"\bfailures\b", 0.8)],
    "limit": [(r"\blimit\b", 1.0), (r"\bthreshold\b", 1.0), (r"\bmaximum\b", 0.7), (r"\bdegrees\b", 0.4)],
    "safety": [(r"\bsafe\b", 1.0), (r"\bpermit\b", 0.9), (r"\balarm\b", 0.5)],
    "stock": [(r"\bstore\b", 0.9), (r"\bspares?\b", 0.8), (r"\bgasket", 0.4)],
    "status": [(r"\bhow many\b", 0.6), (r"\bclosed\b", 0.7), (r"\bwork order\b", 0.7)],
}
#: Days of the units and adverbs of an interval; fixed values.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}
ADVERB_DAYS = {"daily": 1, "weekly": 7, "fortnightly": 14, "monthly": 30, "quarterly": 91, "annually": 365, "yearly": 365}
_LETTERS, _DIGITS = "OQDILZSGTB", "0001125678"
_BACK_DIGITS, _BACK_LETTERS = "015862", "OISBGZ"


def class_scores(text: Column) -> Column:
    """An array of (class, score), best first, ties by name; the score saturates at 1.2 and is set apart from the second."""
    low = F.lower(text)
    scores = [F.struct(reduce(lambda a, pw: a + F.when(low.rlike(pw[0]), F.lit(pw[1])).otherwise(F.lit(0.0)), patterns, F.lit(0.0)).alias("score"), F.lit(name).alias("name")) for name, patterns in QUESTION_CLASSES.items()]
    return F.array_sort(F.array(*scores), lambda a, b: F.when(a["score"] != b["score"], F.sign(b["score"] - a["score"]).cast("int")).when(a["name"] < b["name"], -1).otherwise(1))


def interval_days(text: Column) -> Column:
    """Days of the first interval a text names, 1 to 3650: an adverb, or a count and unit after every, each or per."""
    low = F.lower(text)
    counted = F.regexp_extract(low, r"\b(?:every|each|per|last)\s+([0-9]+)?\s*(day|week|month|quarter|year)s?\b", 2)
    number = F.regexp_extract(low, r"\b(?:every|each|per|last)\s+([0-9]+)?\s*(day|week|month|quarter|year)s?\b", 1)
    unit = reduce(lambda out, kv: out.when(counted == kv[0], F.lit(kv[1])), UNIT_DAYS.items(), F.when(F.lit(False), F.lit(0)))
    word = F.regexp_extract(low, r"\b(" + "|".join(ADVERB_DAYS) + r")\b", 1)
    adverb = reduce(lambda out, kv: out.when(word == kv[0], F.lit(kv[1])), ADVERB_DAYS.items(), F.when(F.lit(False), F.lit(0)))
    days = F.coalesce(F.when(counted != "", unit * F.coalesce(F.when(number != "", number.cast("int")), F.lit(1))), adverb)
    return F.when(days.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(3650), days)))


def steps(text: Column, least: int = 12) -> Column:
    """All numbered steps of a procedure longer than ``least`` characters, whatever their number."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*[0-9]+[.)][ \t]+([^\r\n]+)"), F.lit(1)), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) > least)


def masked(text: Column) -> Column:
    """(text, tags): tags replaced by __TAG0__, __TAG1__ ... in order of their first appearance."""
    tags = F.array_sort(scan_tags(text), lambda a, b: F.length(b) - F.length(a))
    marks = F.zip_with(tags, F.sequence(F.lit(0), F.size(tags)), lambda t, k: F.struct(t.alias("tag"), F.concat(F.lit("__TAG"), k, F.lit("__")).alias("mark")))
    marks = F.filter(marks, lambda m: m["tag"].isNotNull())
    return F.struct(F.aggregate(marks, text, lambda out, m: F.replace(out, m["tag"], m["mark"])).alias("text"), tags.alias("tags"))


def unmasked(text: Column, tags: Column) -> Column:
    """The text with the marks of :func:`masked` replaced by their tags."""
    marks = F.zip_with(tags, F.sequence(F.lit(0), F.size(tags)), lambda t, k: F.struct(t.alias("tag"), F.concat(F.lit("__TAG"), k, F.lit("__")).alias("mark")))
    return F.aggregate(F.filter(marks, lambda m: m["tag"].isNotNull()), text, lambda out, m: F.replace(out, m["mark"], m["tag"]))


def renumbered(answer: Column, sources: Column) -> Column:
    """(text, cited): citations [n] of 1..sources renumbered by first appearance, others removed."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda n: n.cast("int")))
    valid = F.filter(found, lambda n: (n >= 1) & (n <= sources))
    bad = F.filter(found, lambda n: (n < 1) | (n > sources))
    text = F.aggregate(bad, answer, lambda out, n: F.replace(out, F.concat(F.lit("["), n, F.lit("]")), F.lit("")))
    text = F.aggregate(valid, text, lambda out, n: F.replace(out, F.concat(F.lit("["), n, F.lit("]")), F.concat(F.lit("[#"), F.array_position(valid, n), F.lit("]"))))
    return F.struct(F.replace(text, F.lit("[#"), F.lit("[")).alias("text"), valid.alias("cited"))


def glyph_reading(raw: Column) -> Column:
    """(tag, changes): a tag read with letters before and digits behind the dash, as a scanner confuses them."""
    plain = F.upper(F.trim(raw))
    prefix, rest = F.regexp_extract(plain, "^([A-Z0-9]{1,3})[-_ ./]", 1), F.regexp_extract(plain, "^[A-Z0-9]{1,3}[-_ ./]+([A-Z0-9|]{2,6})$", 1)
    suffix = F.regexp_extract(rest, "^.{2,}([ABC])$", 1)
    number = F.substring(rest, F.lit(1), F.length(rest) - F.length(suffix))
    letters, digits = F.translate(prefix, _BACK_DIGITS, _BACK_LETTERS), F.translate(F.translate(number, "|", "1"), _LETTERS, _DIGITS)
    tag = F.concat(letters, F.lit("-"), digits, suffix)
    changes = F.levenshtein(prefix, letters) + F.levenshtein(number, digits)
    good = (prefix != "") & (rest != "") & digits.rlike("^[0-9]{2,5}$") & letters.rlike("^[A-Z]+$")
    return F.struct(F.when(good, tag).alias("tag"), F.when(good, changes).alias("changes"))


def grams(words: Column, most: int = 4) -> Column:
    """All runs of one to ``most`` words, joined by blanks; a run that recurs comes each time."""

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[runs(n) for n in range(1, most + 1)]))


def grounded(claim: Column, block: Column, stem: int = 5) -> Column:
    """The share of a claim's words of four letters or more whose stem stands in a block; 0 without words."""
    words = F.array_distinct(F.filter(F.split(F.lower(claim), "[^a-z]+"), lambda w: F.length(w) >= 4))
    low = F.lower(block)
    hits = F.size(F.filter(words, lambda w: F.contains(low, F.substring(w, 1, stem))))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))
