"""Text predicates and extractions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and weights of the terms are fixed values. What finds a term is built from stems: each
# alternative is a row of words, and a word is one of the stems given for it, with any ending.
_ANOMALIES = {
    "bearing wear": (0.95, ["bearing", "wear worn damag pit spall"]),
    "seizure": (1.0, ["seiz"]),
    "vibration": (0.8, ["vibrat"]),
    "overheating": (0.85, ["overheat"], ["excess", "temperatur"]),
    "leak": (0.75, ["leak"]),
    "misalignment": (0.8, ["misalign"]),
    "cavitation": (0.85, ["cavitat"]),
    "abnormal noise": (0.7, ["abnormal unusual excess", "nois sound rattl"]),
    "crack": (0.9, ["crack"]),
    "corrosion": (0.7, ["corro"]),
    "erratic reading": (0.65, ["erratic fluctuat unstab", "reading value signal trend"]),
    "trip": (0.8, ["trip", "on due"]),
}
_BYPASSES = {
    "bypass": (1.0, ["bypass"], ["by", "pass"]),
    "override": (0.92, ["overrid"]),
    "inhibit": (0.92, ["inhibit"]),
    "silenced": (0.8, ["silenc"]),
    "acknowledged and cleared": (0.95, ["acknowledg", "and then", "clear"]),
}
#: What the stricter reading of a question's papers looks for: what was done, not what it is called.
_DIAGNOSTIC = {
    "defect": (1.0, ["wear leak crack corro damag"], ["high", "vibrat"]),
    "stop": (1.0, ["trip stop shut", "on due by after"], ["taken", "out", "of", "service"]),
    "bypass": (1.0, ["bypass overrid inhibit", "was is in left kept"]),
}


def stems_pattern(alternatives: list[list[str]]) -> str:
    """A pattern over lower-case text for rows of words given by their stems."""
    word = lambda stems: r"\b(?:" + "|".join(stems.split()) + r")\w*"
    return "|".join(r"\W+".join(map(word, row)) for row in alternatives)


def _terms(stems: dict) -> list[tuple[str, str, float]]:
    return [(name, stems_pattern(list(rows)), weight) for name, (weight, *rows) in stems.items()]


ANOMALY_TERMS, BYPASS_TERMS, DIAGNOSTIC_TERMS = map(_terms, (_ANOMALIES, _BYPASSES, _DIAGNOSTIC))
#: Document kinds by the first keyword found, in order; fixed values.
DOCUMENT_KINDS = [
    ("incident_report", ["incident", "near miss"]),
    ("work_order", ["work order", "material:", "spares used"]),
    ("shift_log", ["shift", "handed over"]),
    ("inspection_report", ["inspection", "thickness readings", "calibration"]),
    ("sop", ["procedure", "wear face protection", "check that the suction valve"]),
    ("regulation", ["shall be", "regulation"]),
]


def token_count(text: Column) -> Column:
    """1.33 tokens per word or punctuation mark, at least 1 (half to even)."""
    return F.greatest(F.lit(1), F.rint(1.33 * F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"))).cast("int"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def is_heading(line: Column) -> Column:
    """At most 90 characters and: marked by #, in capitals, numbered, or short and ending in a colon."""
    letters = F.regexp_replace(line, "[^A-Za-z]", "")
    return (F.length(line) > 0) & (F.length(line) <= 90) & (
        line.startswith("#") | ((F.length(letters) > 2) & (letters == F.upper(letters))) | line.rlike(r"^[0-9]+([.][0-9]+)*[.)]?\s+[A-Z]") | ((F.length(line) <= 60) & line.endswith(":"))
    )


def sentences(text: Column) -> Column:
    """Sentences of a text; abbreviations, initials and numbers before a dot end none."""
    no_end = r"(?<![0-9])(?<!\b[A-Za-z])(?<!\b(?:No|Nos|Fig|Ref|approx|vs|etc|Dr|Mr|Mrs|Ms|Rev|e\.g|i\.e))"
    marked = F.regexp_replace(text, rf"((?:{no_end}[.]|[!?;])[\"')\]]?)\s+(?=[\"'(\[A-Z0-9])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), F.trim), lambda s: F.length(s) > 0)


def kind_of_document(text: Column) -> Column:
    """The first kind one of whose keywords stands anywhere in the text, else unknown."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in DOCUMENT_KINDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = out.when(hit, kind)
    return out.otherwise("unknown")


#: Where a clause ends: a mark with white space behind it, or a line.
CLAUSE_END = r"[.!?]\s+|[\r\n]+"


def matching_clause(text: Column, pattern: str) -> Column:
    """The first clause in which a pattern (over lower-case text) is found, white space single; null without one."""
    clauses = F.transform(F.split(text, CLAUSE_END), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.get(F.filter(clauses, lambda s: F.lower(s).rlike(pattern)), F.lit(0))


def block_kind(block: Column) -> Column:
    """heading, list or paragraph: what a block between blank lines is."""
    first = F.trim(F.get(F.split(block, "\n"), F.lit(0)))
    alone = F.size(F.split(block, "\n")) == 1
    return F.when(alone & is_heading(first), "heading").when(first.rlike(r"^(?:[-*•]|[0-9]+[.)])\s"), "list").otherwise("paragraph")


def clipped(text: Column, most: int) -> Column:
    """White space made single and the text cut to ``most`` characters, the last of them an ellipsis if it was longer."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, F.lit(1), F.lit(most - 1))), F.lit("…"))).otherwise(plain)


def revision(text: Column) -> Column:
    """The number behind the first "rev"; null without one."""
    found = F.regexp_extract(F.lower(text), r"\brev(?:ision)?\.?\s*([0-9]+)", 1)
    return F.when(found != "", found.cast("int"))


def type_matches(pattern: Column, kind: Column) -> Column:
    """Whether every word of a pattern is a word of the kind of machine, underscores being spaces."""
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    return F.size(F.array_except(words(pattern), words(kind))) == 0


def around(text: Column, pattern: str, reach: int = 80) -> Column:
    """The first match of a pattern with up to ``reach`` characters on both sides, an ellipsis where text is left out; null without a match."""
    found = F.regexp_substr(text, F.lit(pattern))
    at = F.position(found, text)  # in characters; regexp_instr() goes wrong behind accents
    begin = F.greatest(at - reach, F.lit(1))
    size = at - begin + F.length(found) + reach
    return F.when(at > 0, F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(text, begin, size), F.when(begin + size <= F.length(text), "…").otherwise("")))
