"""Queries on what texts mention: facts by pattern, persons and clauses, tags in loose spelling, nodes left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tags
from millrace.operators import graph
from millrace.session import spread, table

#: Kinds of facts and the pattern whose first group is their value.
FACTS = {
    "date_iso": r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b",
    "date_dotted": r"\b([0-9]{2}[.][0-9]{2}[.][0-9]{4})\b",
    "clock": r"\b([0-2][0-9]:[0-5][0-9])\b",
    "duration": r"\b([0-9]+(?:[.][0-9]+)? (?:minutes|hours|days|weeks))\b",
    "downtime": r"\bDowntime came to ([0-9]+) hours\b",
    "share": r"\b([0-9]+(?:[.][0-9]+)?) percent\b",
    "order": r"\b(?:Work Order|WO)(?: No[.])?[ -]?([0-9]{3,})\b",
    "part": r"\bdrawing ([0-9]{3,})\b",
    "clause": r"\b[Cc]lause ([0-9]+(?:[.][0-9]+)*)\b",
    "person": r"\b([A-Z][.] [A-Z][a-z]{2,})\b",
}


def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact of a text with its kind and how often it stands there; all patterns in one pass."""
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("values")) for kind, pattern in FACTS.items()])
    rows = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL")).select("doc_id", F.inline(found))
    return rows.select("doc_id", "kind", F.explode("values").alias("value")).groupBy("doc_id", "kind", "value").agg(F.count("*").alias("times"))


def loose_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of transcripts in any spelling: with a dash, or with a known prefix and another mark or none between."""
    known = "|".join(sorted(tags.KINDS, key=lambda p: (-len(p), p)))
    pattern = rf"\b([A-Z]{{1,4}}-[0-9]{{2,5}}[A-Z]?|(?:{known})[ _/.]?[0-9]{{2,5}}[A-Z]?)\b"
    found = F.regexp_extract_all(F.upper("transcript"), F.lit(pattern), F.lit(1))
    plain = F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, "^([A-Z]+)[-_/. ]?([0-9])", "$1-$2")))
    q = table(spark, sf_dir, "voice_query").where("transcript IS NOT NULL")
    return q.select("query_id", F.explode(plain).alias("tag")).where(~F.regexp_extract("tag", "^([A-Z]+)", 1).isin(tags.NOT_TAGS))


def kinds_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of machine of each resolved tag, by its prefix or the longest front of it that is known."""
    t = table(spark, sf_dir, "tag_resolution").where("trim(tag) <> ''").select(F.upper(F.trim("tag")).alias("tag")).distinct()
    return t.select("tag", tags.kind_by_longest_prefix(F.col("tag")).alias("kind"))


def nodes_left_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lose their last edge when the shift logs are deleted: readings of tags in them, and tags read nowhere else."""
    t = table(spark, sf_dir, "tag_resolution").where("trim(tag) <> ''")
    edges = t.select(F.upper(F.trim("tag")).alias("source"), F.concat(F.lit("R:"), "resolution_id").alias("target"), F.col("doc_id").alias("document"))
    logs = table(spark, sf_dir, "documents").where("document_type = 'shift_log'").select(F.col("doc_id").alias("document"))
    return graph.orphans(edges, graph.without_document(edges, logs))


_F = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', 1)) AS value FROM documents WHERE text IS NOT NULL"
    for kind, pattern in (
        ("date_iso", "\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b"), ("date_dotted", "\\b([0-9]{2}[.][0-9]{2}[.][0-9]{4})\\b"), ("clock", "\\b([0-2][0-9]:[0-5][0-9])\\b"), ("duration", "\\b([0-9]+(?:[.][0-9]+)? (?:minutes|hours|days|weeks))\\b"),
        ("downtime", "\\bDowntime came to ([0-9]+) hours\\b"), ("share", "\\b([0-9]+(?:[.][0-9]+)?) percent\\b"), ("order", "\\b(?:Work Order|WO)(?: No[.])?[ -]?([0-9]{3,})\\b"), ("part", "\\bdrawing ([0-9]{3,})\\b"),
        ("clause", "\\b[Cc]lause ([0-9]+(?:[.][0-9]+)*)\\b"), ("person", "\\b([A-Z][.] [A-Z][a-z]{2,})\\b"),
    )
)
_KIND = """CASE {x} WHEN 'P' THEN 'pump' WHEN 'BP' THEN 'pump' WHEN 'CP' THEN 'pump' WHEN 'C' THEN 'compressor' WHEN 'K' THEN 'compressor' WHEN 'V' THEN 'vessel' WHEN 'D' THEN 'vessel' WHEN 'KOD' THEN 'vessel'
    WHEN 'E' THEN 'heat_exchanger' WHEN 'HE' THEN 'heat_exchanger' WHEN 'TK' THEN 'tank' WHEN 'M' THEN 'motor' WHEN 'R' THEN 'reactor' WHEN 'FL' THEN 'filter' WHEN 'STR' THEN 'filter' WHEN 'CV' THEN 'valve' WHEN 'XV' THEN 'valve'
    WHEN 'PSV' THEN 'valve' WHEN 'FIC' THEN 'instrument' WHEN 'LIC' THEN 'instrument' WHEN 'PIC' THEN 'instrument' WHEN 'TIC' THEN 'instrument' END"""
QUERIES = {f.__name__: f for f in (stated_facts, loose_tags, kinds_by_prefix, nodes_left_alone)}
SQL = {
    "stated_facts": f"SELECT doc_id, kind, value, count(*) AS times FROM ({_F}) GROUP BY 1, 2, 3",
    "loose_tags": """
        WITH t AS (SELECT query_id, unnest(regexp_extract_all(upper(transcript), '\\b([A-Z]{1,4}-[0-9]{2,5}[A-Z]?|(FIC|KOD|LIC|PIC|PSV|STR|TIC|BP|CP|CV|FL|HE|TK|XV|C|D|E|K|M|P|R|V)[ _/.]?[0-9]{2,5}[A-Z]?)\\b', 1)) AS t FROM voice_query WHERE transcript IS NOT NULL),
        n AS (SELECT DISTINCT query_id, regexp_replace(t, '^([A-Z]+)[-_/. ]?([0-9])', '\\1-\\2') AS tag FROM t)
        SELECT query_id, tag FROM n WHERE regexp_extract(tag, '^([A-Z]+)', 1) NOT IN ('ISO', 'API', 'IEC', 'ASME', 'DN', 'PN', 'REV', 'RPM', 'HW', 'OISD', 'IS', 'SS')""",
    "kinds_by_prefix": f"""
        WITH t AS (SELECT DISTINCT upper(trim(tag)) AS tag FROM tag_resolution WHERE trim(tag) <> ''), p AS (SELECT tag, regexp_extract(tag, '^([A-Z]+)', 1) AS p FROM t)
        SELECT tag, coalesce({_KIND.format(x="p")}, {_KIND.format(x="substring(p, 1, 3)")}, {_KIND.format(x="substring(p, 1, 2)")}, {_KIND.format(x="substring(p, 1, 1)")}) AS kind FROM p""",
    "nodes_left_alone": """
        WITH s AS (SELECT upper(trim(tag)) AS source, 'R:' || resolution_id AS target, doc_id FROM tag_resolution WHERE trim(tag) <> ''), a AS (SELECT source AS key FROM s UNION SELECT target FROM s),
        l AS (SELECT * FROM s WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE document_type = 'shift_log'))
        SELECT key FROM a WHERE key NOT IN (SELECT source FROM l UNION SELECT target FROM l)""",
}
