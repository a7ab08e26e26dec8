"""Queries on texts, tags and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tags, text
from millrace.operators import documents as ops
from millrace.plans.vocabulary import ANOMALY_SQL, BYPASS_SQL, DIAGNOSTIC_SQL, KINDS_SQL
from millrace.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", text.token_count(F.col("text")).alias("tokens"), text.token_estimate(F.col("text")).alias("estimate"))


def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    return d.select(
        "doc_id", *[F.regexp_count("text", F.lit(p)).alias(n) for n, p in (("latin", "[A-Za-z]"), ("devanagari", "[ऀ-ॿ]"), ("tamil", "[஀-௿]"), ("kannada", "[ಀ-೿]"))]
    )


def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    return d.groupBy(text.kind_of_document(F.col("text")).alias("kind")).agg(F.count("*").alias("documents"))


def keyword_signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.term_counts(_docs(spark, sf_dir).select("doc_id", "text"), text.ANOMALY_TERMS)


def bypass_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.term_counts(_docs(spark, sf_dir).select("doc_id", "text"), text.BYPASS_TERMS)


def diagnostic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.term_counts(_docs(spark, sf_dir).select("doc_id", "text"), text.DIAGNOSTIC_TERMS)


def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.by_content(_docs(spark, sf_dir).select("doc_id", "text"))


def idempotent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the second half of the sources that the first half does not hold already."""
    d = _docs(spark, sf_dir).select("doc_id", "source", "text").where("text IS NOT NULL")
    return ops.not_loaded(d.where("source >= 'm'"), d.where("source < 'm'")).select("doc_id")


def tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(tags.scan_tags(F.col("text"))).alias("position", "tag"))


def tag_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "equipment").select("tag", tags.kind_of_machine(F.col("tag")).alias("kind"), "equipment_type")


def canonical_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "tag_resolution").where("raw IS NOT NULL")
    return raw.select("resolution_id", tags.canonical_tag(F.col("raw")).alias("tag"))


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical tags joined to the registry, unknown ones kept with a placeholder."""
    raw = table(spark, sf_dir, "tag_resolution").where("raw IS NOT NULL").select("resolution_id", tags.canonical_tag(F.col("raw")).alias("tag"))
    known = table(spark, sf_dir, "equipment").select("tag", "equipment_type")
    return raw.join(known, "tag", "left").select("resolution_id", F.coalesce("tag", F.lit("?")).alias("tag"), F.coalesce("equipment_type", F.lit("unknown")).alias("equipment_type"))


def key_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a text with the value of their first line: a name before a colon at the start of a line."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z][A-Za-z ]{1,30}:[ \t]*[^ \t\r\n][^\r\n]*)"), F.lit(1))
    rows = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(found).alias("at", "line"))
    rows = rows.select("doc_id", "at", text.slug(F.regexp_extract("line", "^([^:]*):", 1)).alias("field"), F.btrim(F.regexp_extract("line", "^[^:]*:(.*)$", 1), F.lit(" \t")).alias("value"))
    return rows.groupBy("doc_id", "field").agg(F.min_by("value", "at").alias("value"))


def labelled_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured values with the word that says what they are and their unit in its usual spelling."""
    names = ["pressure", "temperature", "vibration", "flow", "level", "speed", "thickness", "gap"]
    pattern = r"\b((?:" + "|".join(names) + r")\b[^.0-9\r\n]{0,40}[0-9]+(?:\.[0-9]+)? ?(?:mm/s|mm|bar|kPa|degC|°C|m3/h|%|percent|rpm)\b)"
    low = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    rows = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.explode(low).alias("m"))
    unit = F.regexp_extract("m", r"[0-9] ?([^0-9 ]+[^ ]*)$", 1)
    usual = F.when(unit == "°C", "degC").when(unit == "%", "percent").otherwise(unit)
    return rows.groupBy("doc_id", F.regexp_extract("m", "^([a-z]+)", 1).alias("label"), F.regexp_extract("m", r"([0-9]+(?:\.[0-9]+)?) ?[^0-9 ]+[^ ]*$", 1).cast("double").alias("value"), usual.alias("unit")).agg(F.count("*").alias("times"))


def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("title IS NOT NULL").select("doc_id", text.slug(F.col("title")).alias("slug"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.btrim("line", F.lit(" \t\r")).alias("line"))
    return lines.where(text.is_heading(F.col("line")))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.measurements(_docs(spark, sf_dir).select("doc_id", "text"))


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the ``key: value`` fields of each document as slugs."""
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z][A-Za-z ]{1,30}):[ \t]*[^ \t\r\n]"), F.lit(1)), text.slug))
    return d.select("doc_id", F.explode(found).alias("field"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", text.around(F.col("text"), "(?:leak|vibrat|corro|crack|cavitat)[a-z]*", 80).alias("snippet")).where("snippet IS NOT NULL")


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chunks(_docs(spark, sf_dir).select("doc_id", "text"))


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 documents by time of ingestion, newest first; the limit is the feature."""
    d = _docs(spark, sf_dir).select("doc_id", "ingested_at")
    return d.orderBy(F.desc("ingested_at"), "doc_id").offset(50).limit(50).select("doc_id")


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings against precursor texts of the same machine, token-set similarity of at least 0.72."""
    m = table(spark, sf_dir, "maintenance").select("record_id", "equipment_tag", "findings").dropDuplicates(["record_id"])
    f = table(spark, sf_dir, "failure").select("event_id", "equipment_tag", "precursor_text")
    return ops.similar_texts(m, f)


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hash_embeddings(_docs(spark, sf_dir).select("doc_id", "text"), 64)


def _hits(values: str) -> str:
    return f"""SELECT doc_id, term, CAST(hits AS INTEGER) AS hits, weight FROM (
        SELECT doc_id, term, len(regexp_extract_all(lower(text), pattern)) AS hits, weight FROM documents, {values} WHERE text IS NOT NULL) WHERE hits > 0"""


_NOT = ", ".join(f"'{p}'" for p in tags.NOT_TAGS)
_CANON = f"""
    SELECT resolution_id, CASE WHEN regexp_full_match(t, '[A-Z]{{1,4}}-[0-9]{{2,5}}[A-Z]{{0,2}}') AND regexp_extract(t, '^([A-Z]+)', 1) NOT IN ({_NOT}) THEN t END AS tag
    FROM (SELECT resolution_id, regexp_replace(regexp_replace(upper(trim(translate(raw, '‐‑‒–—―−', '-------'))), '[ \\t\\n\\r\\f\\v_/.-]+', '-', 'g'), '^([A-Z]{{1,4}})([0-9])', '\\1-\\2') AS t
          FROM tag_resolution WHERE raw IS NOT NULL)"""

QUERIES = {
    f.__name__: f
    for f in (
        token_estimates, script_counts, document_kinds, keyword_signal_counts, bypass_signals, diagnostic_terms, content_dedupe, idempotent_load, tag_scan, tag_kinds, canonical_tags, registry_lookup,
        title_slugs, headings, measurements, key_values, key_value_pairs, labelled_measurements, snippets, sentence_counts, semantic_chunks, paged_documents, text_similarity, hash_embedding,
    )
}
SQL = {
    "token_estimates": """
        SELECT doc_id, CAST(greatest(1, round_even(1.33::DOUBLE * len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\v]')), 0)) AS INTEGER) AS tokens,
               CAST(ceil(length(text) / 4) AS BIGINT) AS estimate FROM documents WHERE text IS NOT NULL""",
    "script_counts": """
        SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS INTEGER) AS latin, CAST(len(regexp_extract_all(text, '[ऀ-ॿ]')) AS INTEGER) AS devanagari,
               CAST(len(regexp_extract_all(text, '[஀-௿]')) AS INTEGER) AS tamil, CAST(len(regexp_extract_all(text, '[ಀ-೿]')) AS INTEGER) AS kannada FROM documents WHERE text IS NOT NULL""",
    "document_kinds": f"SELECT {KINDS_SQL} AS kind, count(*) AS documents FROM (SELECT lower(text) AS t FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "keyword_signal_counts": _hits(ANOMALY_SQL),
    "bypass_signals": _hits(BYPASS_SQL),
    "diagnostic_terms": _hits(DIAGNOSTIC_SQL),
    "content_dedupe": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "idempotent_load": """
        SELECT doc_id FROM documents WHERE text IS NOT NULL AND source >= 'm'
          AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND source < 'm')""",
    "tag_scan": f"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(upper(text), '\\b([A-Z]{{1,4}}-[0-9]{{2,5}}[A-Z]?)\\b', 1)) AS tag,
                          generate_subscripts(regexp_extract_all(upper(text), '\\b([A-Z]{{1,4}}-[0-9]{{2,5}}[A-Z]?)\\b', 1), 1) AS i FROM documents WHERE text IS NOT NULL),
        f AS (SELECT doc_id, tag, min(i) AS i FROM t WHERE regexp_extract(tag, '^([A-Z]+)', 1) NOT IN ({_NOT}) GROUP BY doc_id, tag)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS position, tag FROM f""",
    "tag_kinds": "SELECT tag, CASE regexp_extract(tag, '^([A-Z]+)-', 1) " + " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in tags.KINDS.items()) + " END AS kind, equipment_type FROM equipment",
    "canonical_tags": _CANON,
    "registry_lookup": f"SELECT resolution_id, coalesce(c.tag, '?') AS tag, coalesce(equipment_type, 'unknown') AS equipment_type FROM ({_CANON}) c LEFT JOIN equipment e ON c.tag = e.tag",
    "title_slugs": "SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents WHERE title IS NOT NULL",
    "headings": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, trim(line, ' ' || chr(9) || chr(13)) AS line FROM l)
        SELECT doc_id, line_no, line FROM t WHERE length(line) BETWEEN 1 AND 90 AND (starts_with(line, '#')
          OR (length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 2 AND regexp_replace(line, '[^A-Za-z]', '', 'g') = upper(regexp_replace(line, '[^A-Za-z]', '', 'g')))
          OR regexp_matches(line, '^[0-9]+([.][0-9]+)*[.)]?[ \\t\\n\\r\\f\\v]+[A-Z]') OR (length(line) <= 60 AND ends_with(line, ':')))""",
    "key_values": """
        SELECT DISTINCT doc_id, trim(regexp_replace(lower(f), '[^a-z0-9]+', '_', 'g'), '_') AS field
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^([A-Za-z][A-Za-z ]{1,30}):[ \\t]*[^ \\t\\r\\n]', 1)) AS f FROM documents WHERE text IS NOT NULL)""",
    "key_value_pairs": """
        WITH l AS (SELECT doc_id, regexp_extract_all(text, '(?m)^([A-Za-z][A-Za-z ]{1,30}:[ \\t]*[^ \\t\\r\\n][^\\r\\n]*)', 1) AS l FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM l),
        f AS (SELECT doc_id, k, trim(regexp_replace(lower(regexp_extract(line, '^([^:]*):', 1)), '[^a-z0-9]+', '_', 'g'), '_') AS field, trim(regexp_extract(line, '^[^:]*:(.*)$', 1), ' ' || chr(9)) AS value FROM e)
        SELECT doc_id, field, arg_min(value, k) AS value FROM f GROUP BY 1, 2""",
    "labelled_measurements": """
        WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b((pressure|temperature|vibration|flow|level|speed|thickness|gap)\\b[^.0-9\\r\\n]{0,40}[0-9]+(\\.[0-9]+)? ?(mm/s|mm|bar|kPa|degC|°C|m3/h|%|percent|rpm)\\b)', 1)) AS m FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, m, regexp_extract(m, '^([a-z]+)', 1) AS label, CAST(regexp_extract(m, '([0-9]+(\\.[0-9]+)?) ?[^0-9 ]+[^ ]*$', 1) AS DOUBLE) AS value, regexp_extract(m, '[0-9] ?([^0-9 ]+[^ ]*)$', 1) AS unit FROM m)
        SELECT doc_id, label, value, CASE unit WHEN '°C' THEN 'degC' WHEN '%' THEN 'percent' ELSE unit END AS unit, count(*) AS times FROM u GROUP BY 1, 2, 3, 4""",
    "snippets": """
        WITH m AS (SELECT doc_id, text, regexp_extract(text, '(leak|vibrat|corro|crack|cavitat)[a-z]*') AS w FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, text, w, strpos(text, w) AS p FROM m WHERE w <> ''), b AS (SELECT *, greatest(p - 80, 1) AS b FROM p)
        SELECT doc_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substring(text, b, p - b + length(w) + 80) || CASE WHEN p + length(w) + 80 <= length(text) THEN '…' ELSE '' END AS snippet FROM b""",
    "paged_documents": "SELECT doc_id FROM documents ORDER BY ingested_at DESC NULLS LAST, doc_id LIMIT 50 OFFSET 50",
    "measurements": """
        WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]+(?:\\.[0-9]+)? (?:mm/s|mm|bar|kPa|degC|m3/h|percent|hours|minutes)\\b')) AS m FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(regexp_extract(m, '^([0-9.]+) ', 1) AS DOUBLE) AS value, regexp_extract(m, ' (.*)$', 1) AS unit, count(*) AS times FROM m GROUP BY ALL""",
}
