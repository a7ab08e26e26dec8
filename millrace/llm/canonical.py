"""Problem 6: freely entered values mapped to the closest entry of a reference list. SQL only.

Each distinct value is resolved once, through joins of one kind. A reference string (a tag,
a name in either order of its words, a kind of machine and a number) is cut into k + 1
segments, of which k edits leave one intact, so equality on (length, segment number, segment)
against the value's substrings near that place finds every candidate; levenshtein() verifies
them. A value is compared whole and by its runs of words, so that words around a tag or name
need not be known. Candidates come in tiers, of which the first counts:

1. the letters and digits of the whole value are a tag; 2. those of a run of its words are;
3. a run is a tag after characters that are mistaken for each other are folded together;
4. its words, but for some at either end, are a name with the same unit letter;
5. a kind of machine and a number that only one machine of that kind has;
6. a run within one edit of a tag (insertion, deletion, substitution or neighbours swapped);
7. a name within EDITS edits, with the same unit letter.

Within a tier the fewest edits win. Values without a candidate, or with several machines in
their best place, are unmatched. Kinds of machines are the last words of the names themselves.

Defined results: null and blank values and exact tags take no part; punctuation -> unmatched;
an empty reference list -> every value unmatched; null names are matched by tag only;
repeated values resolve alike; very long values are compared as any other.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import hot_keys, join_to_unique
from millrace.session import checkpointed

UNMATCHED = "UNMATCHED"
EDITS = 2
#: Words of a value that are taken together at most, and words that a name may have around it.
RUN, AROUND = 3, 3
#: Characters mistaken for each other, each followed by what it is folded to; fixed values.
GLYPHS = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "|": "1", "!": "1", "Z": "2", "S": "5", "G": "6", "T": "7", "B": "8", "A": "4", "$": "5"}
_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_PLAIN = "".join(chr(0x21 + k) for k in range(94))


def cleaned(raw: Column) -> Column:
    """Upper case, wide forms and dashes made plain, white space single."""
    text = F.translate(raw, _WIDE + "‐‑‒–—―−  　", _PLAIN + "-------   ")
    return F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Z0-9]", "")


def folded(text: Column) -> Column:
    """Letters and digits with mistaken characters folded together."""
    return F.regexp_replace(F.translate(text, "".join(GLYPHS), "".join(GLYPHS.values())), "[^A-Z0-9]", "")


def runs(text: Column) -> Column:
    """Runs of one to RUN words of a cleaned value, brackets and commas apart."""
    words = F.filter(F.split(text, r"[\s()\[\],;:/]+"), lambda w: F.length(w) > 0)

    def of(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, RUN + 1)])))


def inner(text: Column) -> Column:
    """A value's words without up to AROUND of them at either end, in all ways, and without a bracket's words; letters only, without the unit's."""
    words = F.filter(F.split(F.regexp_replace(text, r"\([^)]*\)", " "), r"[\s,;:/]+"), lambda w: F.length(w) > 0)
    n = F.size(words)
    parts = F.array(*[F.when(n - a - b >= 1, F.array_join(F.slice(words, a + 1, F.greatest(n - a - b, F.lit(0))), " ")) for a in range(AROUND + 1) for b in range(AROUND + 1 - a)])
    return F.array_distinct(F.filter(F.transform(F.array_compact(parts), name_base), lambda v: F.length(v) > 3))


def unit_letter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?:^|[^A-Z0-9])([A-Z])(?:$|[^A-Z0-9])", 1)


def name_base(text: Column) -> Column:
    """The letters of a name's words, without brackets and the unit letter."""
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    return compact(F.regexp_replace(text, r"(?:^|(?<=[^A-Z0-9]))[A-Z](?=$|[^A-Z0-9])", " "))


def pigeonhole(values: DataFrame, value: str, refs: DataFrame, ref: str, k: int) -> DataFrame:
    """All pairs of a row of ``values`` and one of ``refs`` whose strings are within k edits.

    A reference string is cut into k + 1 segments; k edits leave one intact. Segment i (from
    0) of a reference that is d characters longer than the value can stand only at shifts s
    with |s| <= i and |s - d| <= k - i, if it is the first intact one seen from the left or
    the last one seen from the right, so a value has 6 probes for one edit and 19 for two.
    The result has the columns of both and ``edits``. A reference of under k + 1 characters
    has empty segments, which match any value of a length near its own.
    """
    size = F.length(ref)
    cut = refs.where(F.col(ref).isNotNull()).withColumn("_seg", F.explode(F.sequence(F.lit(0), F.lit(k))))
    begin, end = F.floor(F.col("_seg") * size / F.lit(k + 1)), F.floor((F.col("_seg") + 1) * size / F.lit(k + 1))
    cut = cut.withColumn("_size", size).withColumn("_part", F.substring(F.col(ref), (begin + 1).cast("int"), (end - begin).cast("int")))
    # The probes of a value: (longer, segment, shift), the reference being that much longer.
    places = [(d, i, s) for d in range(-k, k + 1) for i in range(k + 1) for s in range(-i, i + 1) if abs(-s - d) <= k - i]
    probe = values.where(F.col(value).isNotNull()).withColumn("_p", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in places])))
    probe = probe.withColumn("_size", F.length(value) + F.col("_p.d")).withColumn("_seg", F.col("_p.i")).where("_size > 0")
    begin, end = F.floor(F.col("_seg") * F.col("_size") / F.lit(k + 1)), F.floor((F.col("_seg") + 1) * F.col("_size") / F.lit(k + 1))
    probe = probe.withColumn("_at", (begin + 1 + F.col("_p.s")).cast("int")).where((F.col("_at") >= 1) & (F.col("_at") <= F.length(value) + 1))
    probe = probe.withColumn("_part", F.substring(F.col(value), F.col("_at"), (end - begin).cast("int"))).where(F.length("_part") == end - begin).drop("_p", "_at")
    pairs = probe.join(cut, ["_size", "_seg", "_part"]).drop("_size", "_seg", "_part")
    return pairs.withColumn("edits", F.levenshtein(F.col(value), F.col(ref), k)).where("edits >= 0").distinct()


def resolve_distinct(raws: DataFrame, registry: DataFrame) -> DataFrame:
    """(raw, tag, tier, edits) of the distinct values that resolve. raws: raw; registry: tag, name."""
    refs = registry.select("tag", cleaned(F.col("name")).alias("_name")).where("tag IS NOT NULL").distinct()
    refs = refs.select(
        "tag",
        compact(cleaned(F.col("tag"))).alias("ref_tag"),
        folded(cleaned(F.col("tag"))).alias("ref_fold"),
        name_base(F.col("_name")).alias("ref_name"),
        unit_letter(F.col("_name")).alias("letter"),
        F.regexp_extract("_name", r"([A-Z]+)(?: [A-Z])?$", 1).alias("kind"),
        F.regexp_extract(cleaned(F.col("tag")), r"(\d+[A-Z]?)$", 1).alias("number"),
    )
    # A name with its kind first, as in "pump, crude charge".
    turned = F.concat("kind", F.expr("regexp_replace(ref_name, concat(kind, '$'), '')"))
    names = refs.where("ref_name <> ''").select("tag", "letter", F.explode(F.array_distinct(F.array("ref_name", turned))).alias("ref"))
    numbered = refs.where("kind <> '' AND number <> ''").select("tag", F.concat("kind", "number").alias("ref"))
    values = raws.select("raw", cleaned(F.col("raw")).alias("text"))
    loose = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![A-Z0-9])([A-Z]{1,4}[^A-Z0-9]?\d{2,5}[A-Z]?)(?![A-Z0-9])"), F.lit(1))
    kind_number = F.regexp_extract("text", r"^([A-Z]{3,}?)S?\s*(?:#|NO\.?|NUMBER)?\s*\d+[A-Z]?$", 1)
    values = values.withColumn("runs", runs(F.col("text"))).select(
        "raw",
        # The spellings under which a value is compared, each with the tier it belongs to.
        F.array(compact(F.col("text"))).alias("whole"),
        F.array_distinct(F.concat(F.transform(loose, compact), F.transform("runs", compact))).alias("inside"),
        F.array_distinct(F.concat(F.array(folded(F.col("text"))), F.transform("runs", folded))).alias("fold"),
        inner(F.col("text")).alias("base"),
        unit_letter(F.col("text")).alias("own_letter"),
        F.when(kind_number != "", F.concat(kind_number, F.regexp_extract("text", r"(\d+[A-Z]?)$", 1))).alias("numbered"),
    )
    # Written once: every join reads them, and the plan of each stays small.
    values = checkpointed(values)
    views = values.select("raw", F.explode(F.array_distinct(F.concat(F.transform("whole", lambda v: F.struct(v.alias("value"), F.lit(1).alias("tier"))), F.transform("inside", lambda v: F.struct(v.alias("value"), F.lit(2).alias("tier")))))).alias("v"))
    views = views.select("raw", "v.*").where("value <> ''")
    # An edit is allowed for in values with a digit and more than three characters; the others can only be equal.
    long = F.col("value").rlike("[0-9]") & (F.length("value") > 3)
    ref_tags = refs.select("tag", F.col("ref_tag").alias("ref"))
    tags = pigeonhole(views.where(long), "value", ref_tags, "ref", 1).unionByName(pigeonhole(views.where(~long), "value", ref_tags, "ref", 0))
    tags = tags.withColumn("tier", F.when(F.col("edits") == 0, F.col("tier")).otherwise(F.lit(6)))
    # Neighbours that changed places are two edits: undone, such a value equals a tag.
    pairs = F.sequence(F.lit(1), F.greatest(F.length("value") - 1, F.lit(1)))
    undone = F.transform(pairs, lambda i: F.concat(F.substring(F.col("value"), F.lit(1), i - 1), F.substring(F.col("value"), i + 1, F.lit(1)), F.substring(F.col("value"), i, F.lit(1)), F.substring(F.col("value"), i + 2, F.length("value"))))
    turned = views.where(long).select("raw", F.explode(F.array_distinct(undone)).alias("value"))
    turned = pigeonhole(turned, "value", ref_tags, "ref", 0).select("raw", "tag", F.lit(6).alias("tier"), F.lit(2).alias("edits"))
    folds = pigeonhole(values.select("raw", F.explode("fold").alias("value")).where("value <> ''"), "value", refs.select("tag", F.col("ref_fold").alias("ref")), "ref", 0)
    # Only values as long as some name, but for EDITS characters: two numbers reach the driver.
    low, high = names.agg(F.min(F.length("ref")), F.max(F.length("ref"))).first()
    bases = values.select("raw", F.explode("base").alias("value"), "own_letter").where(F.length("value").between((low or 0) - EDITS, (high or 0) + EDITS))
    named = pigeonhole(bases, "value", names, "ref", EDITS).where("own_letter = letter")
    counted = pigeonhole(values.select("raw", F.col("numbered").alias("value")), "value", numbered, "ref", 0)
    found = (
        tags.select("raw", "tag", "tier", "edits")
        .unionByName(turned)
        .unionByName(folds.select("raw", "tag", F.lit(3).alias("tier"), "edits"))
        .unionByName(named.select("raw", "tag", F.when(F.col("edits") == 0, 4).otherwise(7).alias("tier"), "edits"))
        .unionByName(counted.select("raw", "tag", F.lit(5).alias("tier"), "edits"))
    )
    # Tags of the best tier; the fewest edits within it.
    best = found.groupBy("raw", "tier", "edits").agg(F.min("tag").alias("tag"), F.max("tag").alias("other"))
    best = best.groupBy("raw").agg(F.min(F.struct("tier", "edits", "tag", "other")).alias("b"))
    return best.where("b.tag = b.other").select("raw", "b.tag", "b.tier", "b.edits")


def resolve(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(resolution_id, tag) of every row whose raw is neither null, blank nor exactly a tag."""
    rows = rows.select("resolution_id", "raw").where(F.col("raw").isNotNull() & ~F.col("raw").rlike(r"(?U)^\s*$"))
    tags = registry.select(F.col("tag").alias("raw")).where("raw IS NOT NULL").distinct()
    counts = rows.groupBy("raw").agg(F.count("*").alias("n")).join(tags, "raw", "left_anti")
    counts = checkpointed(counts)
    resolved = checkpointed(resolve_distinct(counts.select("raw"), registry))
    unmatched = counts.select("raw").join(resolved, "raw", "left_anti").select("raw", F.lit(UNMATCHED).alias("tag"), F.lit(0).alias("tier"), F.lit(0).alias("edits"))
    return join_to_unique(rows, resolved.unionByName(unmatched), "raw", hot_keys(counts, "raw", "n"), F.xxhash64("resolution_id"), "inner").select("resolution_id", "tag")
