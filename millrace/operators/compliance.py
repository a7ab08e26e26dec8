"""Evidence against requirements: catalogue, projections, assessment, severity, obligations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.clock import machine
from millrace.functions.text import revision, slug, type_matches

CATALOGUE = "requirement string, type_pattern string, evidence_type string, days int, grace int, least_revision int, required array<string>, severity int"
#: Names under which the same field is filled; fixed values.
ALIASES = {"done_by": "performed_by", "inspector": "performed_by", "result": "findings", "observation": "findings", "remarks": "recommendations", "action": "recommendations"}


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Requirements from JSON lines with a declared schema; a line that does not fit, a missing
    name, a repeated one or an interval that is not positive raises ValueError."""
    rows = spark.read.schema(CATALOGUE).option("mode", "FAILFAST").json(path)
    bad = rows.agg(F.count(F.when(F.col("requirement").isNull() | F.col("evidence_type").isNull() | ~(F.col("days") > 0) | F.col("days").isNull(), 1)).alias("bad"), (F.count("requirement") - F.count_distinct("requirement")).alias("twice")).first()
    if bad["bad"] or bad["twice"]:
        raise ValueError(f"catalogue {path}: {bad['bad']} incomplete and {bad['twice']} repeated requirements")
    return rows.na.fill({"grace": 0, "severity": 1})


def canonical_field(name: Column) -> Column:
    return reduce(lambda out, kv: out.when(name == kv[0], F.lit(kv[1])), ALIASES.items(), F.when(F.lit(False), F.lit(""))).otherwise(name)


def evidence_items(maintenance: DataFrame, documents: DataFrame) -> DataFrame:
    """(tag, evidence_type, item, dated, fields, revision): records and documents in one form.

    A record's fields are its filled columns; a document's are the names before a colon at
    the start of a line, under their canonical names. Items without a machine prove nothing.
    """
    filled = F.array_compact(F.array(*[F.when(F.length(F.trim(c)) > 0, F.lit(c)) for c in ("findings", "performed_by", "recommendations", "status")]))
    records = maintenance.dropDuplicates(["record_id"]).select(machine(F.col("equipment_tag")).alias("tag"), F.col("record_type").alias("evidence_type"), F.col("record_id").alias("item"), F.col("performed_on").alias("dated"), filled.alias("fields"), F.lit(None).cast("int").alias("revision"))
    named = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z][A-Za-z ]{1,30}):[ \t]*[^ \t\r\n]"), F.lit(1)), lambda n: canonical_field(slug(n)))
    papers = documents.where("text IS NOT NULL").select(
        machine(F.col("equipment_tag")).alias("tag"), F.col("document_type").alias("evidence_type"), F.col("doc_id").cast("string").alias("item"), F.col("document_date").alias("dated"), F.array_sort(F.array_distinct(named)).alias("fields"), revision(F.col("text")).alias("revision")
    )
    return records.unionByName(papers).where("tag IS NOT NULL AND evidence_type IS NOT NULL")


def required_of(equipment: DataFrame, requirements: DataFrame) -> DataFrame:
    """Each machine with each requirement whose pattern's words are words of its type. Matched on the few distinct types."""
    kinds = equipment.select("equipment_type").where("equipment_type IS NOT NULL").distinct()
    pairs = kinds.join(requirements, type_matches(F.col("type_pattern"), F.col("equipment_type")))
    return equipment.join(pairs, "equipment_type")


def best_evidence(due: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """(tag, requirement, item, dated, revision, missing): of the items inside the interval and its grace
    the one that lacks the fewest required fields, then the latest, then the first by name."""
    inside = F.datediff(as_of, "dated").between(0, F.col("days") + F.col("grace"))
    rows = due.join(items, ["tag", "evidence_type"]).where(inside)
    missing = F.array_sort(F.array_except("required", "fields"))
    best = F.min(F.struct(F.size(missing).alias("n"), (-F.unix_date("dated")).alias("age"), "item", missing.alias("missing"), "dated", "revision"))
    return rows.groupBy("tag", "requirement").agg(best.alias("b")).select("tag", "requirement", "b.item", "b.dated", "b.revision", "b.missing")


def assessed(equipment: DataFrame, requirements: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """(tag, requirement, status, due, days_overdue, severity, missing) of every machine and requirement of its type.

    The ladder: missing without any item; incomplete if none is dated; outdated past interval
    and grace; outdated if the best item's revision is under the least one; incomplete if it
    lacks a required field; else compliant. Due counts from the last item, or from the day of
    installation where there is none. Severity is the requirement's, one less if incomplete,
    one more for a critical machine, one more for a whole interval missed; 0 to 4, and null
    where compliant.
    """
    due = required_of(equipment.select("tag", "equipment_type", "criticality", "installed_on"), requirements)
    seen = items.groupBy("tag", "evidence_type").agg(F.count("*").alias("items"), F.max("dated").alias("last"))
    best = best_evidence(due, items, as_of).select("tag", "requirement", F.col("revision").alias("best_revision"), "missing")
    rows = due.join(seen, ["tag", "evidence_type"], "left").join(best, ["tag", "requirement"], "left")
    start = F.coalesce("last", F.when(F.col("items").isNull(), F.col("installed_on")))
    falls = F.date_add(start, F.col("days"))
    over = F.greatest(F.datediff(as_of, falls) - F.col("grace"), F.lit(0))
    late = F.datediff(as_of, "last") > F.col("days") + F.col("grace")
    old = F.coalesce(F.col("best_revision") < F.col("least_revision"), F.lit(False))
    status = (
        F.when(F.col("items").isNull(), "missing").when(F.col("last").isNull(), "incomplete").when(late, "outdated").when(old, "outdated")
        .when(F.size(F.coalesce("missing", F.array().cast("array<string>"))) > 0, "incomplete").otherwise("compliant")
    )
    rows = rows.withColumn("status", status).withColumn("due", falls).withColumn("days_overdue", F.when(falls.isNotNull(), over))
    level = F.col("severity") - (F.col("status") == "incomplete").cast("int") + (F.col("criticality") == "A").cast("int") + F.coalesce((F.col("days_overdue") >= F.col("days")).cast("int"), F.lit(0))
    severity = F.when(F.col("status") != "compliant", F.least(F.lit(4), F.greatest(F.lit(0), level)))
    return rows.select("tag", "requirement", "status", "due", "days_overdue", severity.alias("severity"), F.when(F.col("status") == "incomplete", F.concat_ws(",", "missing")).alias("missing"))


def obligations(documents: DataFrame) -> DataFrame:
    """(doc_id, position, obligation) of the clauses that oblige, without a model: those with shall or must."""
    clauses = F.transform(F.split("text", r"[.]\s+|[\r\n]+"), lambda c, k: F.struct(k.alias("position"), F.trim(F.regexp_replace(c, r"\s+", " ")).alias("obligation")))
    rows = documents.where("text IS NOT NULL").select("doc_id", F.inline(clauses))
    return rows.where(F.lower("obligation").rlike(r"\b(?:shall|must)\b"))


def distinct_obligations(found: DataFrame, most: int = 80) -> DataFrame:
    """(doc_id, slug, position): of obligations of one wording the first, in order, ``most`` a document: a report's limit."""
    first = found.groupBy("doc_id", slug(F.col("obligation")).alias("slug")).agg(F.min("position").alias("position"))
    return first.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))).where(F.col("_k") <= most).drop("_k")


def longest_name(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name): the longest configured name whose slug stands in the slug of the title, the first of equals.

    names (a configured list) is matched on the title's runs of words, by equality: a run for
    each start and length, so no title meets all names.
    """
    words = F.split(slug(F.col("title")), "_")
    runs = titles.where("title IS NOT NULL").select("doc_id", words.alias("w")).select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("a"))
    runs = runs.select("doc_id", "w", "a", F.explode(F.sequence(F.lit(1), F.least(F.size("w") - F.col("a") + 1, F.lit(6)))).alias("n"))
    runs = runs.select("doc_id", F.array_join(F.slice("w", F.col("a"), F.col("n")), "_").alias("slug"))
    hit = runs.join(names.select("name", slug(F.col("name")).alias("slug")), "slug")
    return hit.groupBy("doc_id").agg(F.min(F.struct((-F.length("slug")).alias("n"), "name")).alias("b")).select("doc_id", "b.name")
