"""Queries that extract structure from texts and assemble answers from evidence."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import extract, text
from millrace.functions.clock import machine
from millrace.functions.tags import scan_tags
from millrace.functions.vectors import quantised
from millrace.operators import retrieval, trend
from millrace.plans import machines as m
from millrace.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL")


def question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each question with its saturated score, and how far it stands above the second."""
    q = table(spark, sf_dir, "voice_query").where("transcript IS NOT NULL").select("query_id", extract.class_scores(F.col("transcript")).alias("s"))
    first, second = F.element_at("s", 1), F.element_at("s", 2)
    return q.where(first["score"] > 0).select("query_id", first["name"].alias("class"), F.round(F.least(F.lit(1.0), first["score"] / 1.2), 6).alias("score"), F.round((first["score"] - second["score"]) / first["score"], 6).alias("separation"))


def derived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values a text reports: vibration, downtime, a date."""
    d = _docs(spark, sf_dir).select("doc_id", *[F.regexp_extract("text", p, 1).alias(n) for n, p in (("vibration", r"([0-9]+(?:\.[0-9]+)?) mm/s"), ("downtime", r"Downtime came to ([0-9]+) hours"), ("dated", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"))])
    d = d.select("doc_id", F.expr("nullif(vibration, '')").cast("double").alias("vibration"), F.expr("nullif(downtime, '')").cast("int").alias("downtime"), F.expr("nullif(dated, '')").alias("dated"))
    return d.where("vibration IS NOT NULL OR downtime IS NOT NULL OR dated IS NOT NULL")


def procedure_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("document_type = 'sop'").select("doc_id", F.posexplode(extract.steps(F.col("text"))).alias("step_no", "step"))


def interval_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", extract.interval_days(F.col("text")).alias("days")).where("days IS NOT NULL")


def masked_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their tags masked for translation, and whether restoring gives the text back."""
    d = _docs(spark, sf_dir).select("doc_id", "text", extract.masked(F.col("text")).alias("m"))
    return d.select("doc_id", F.size("m.tags").alias("tags"), (extract.unmasked(F.col("m.text"), F.col("m.tags")) == F.col("text")).alias("restored"))


def glyph_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "tag_resolution").where("raw IS NOT NULL").select("resolution_id", extract.glyph_reading(F.col("raw")).alias("g"))
    return raw.select("resolution_id", "g.tag", "g.changes").where("tag IS NOT NULL")


def alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the registry found in texts by their word runs; names are one side, runs the other."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    # The words are a column of their own, or each run would split its text again.
    split = _docs(spark, sf_dir).select("doc_id", words.alias("words"))
    runs = split.select("doc_id", F.explode(extract.grams(F.col("words"))).alias("alias"))
    service = F.regexp_replace(F.lower("name"), " (pump|compressor|tank|drum|exchanger|valve|motor|filter|controller|reactor)( [a-c])?$", "")
    names = table(spark, sf_dir, "equipment").select(service.alias("alias")).distinct()
    return runs.join(names, "alias").select("doc_id", "alias").distinct()


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and failure modes of each text with the confidence of their extraction."""
    modes = ["leak", "vibration", "corrosion", "cavitation", "misalignment", "pitting", "hunting", "packing wear"]
    low = F.lower("text")
    found = F.concat(
        F.transform(scan_tags(F.col("text")), lambda t: F.struct(F.concat(F.lit("equipment:"), t).alias("key"), F.lit(0.9).alias("confidence"))),
        F.filter(F.array(*[F.struct(F.when(low.contains(x), F.lit(f"mode:{x}")).alias("key"), F.lit(0.86).alias("confidence")) for x in modes]), lambda s: s["key"].isNotNull()),
    )
    return _docs(spark, sf_dir).select("doc_id", F.inline(found))


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a record's recommendation is grounded in its findings."""
    r = trend.records_of(table(spark, sf_dir, "maintenance")).where("length(recommendations) > 0 AND length(findings) > 0")
    return r.select("record_id", F.round(extract.grounded(F.col("recommendations"), F.col("findings")), 6).alias("share"))


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tags in compatibility form with plain dashes."""

    @F.pandas_udf("string")
    def nfkc(x: pd.Series) -> pd.Series:
        return x.map(lambda t: unicodedata.normalize("NFKC", t))

    raw = table(spark, sf_dir, "tag_resolution").where("raw IS NOT NULL").select("resolution_id", nfkc("raw").alias("t"))
    return raw.select("resolution_id", F.translate("t", "‐‑‒–—―−", "-------").alias("text"))


def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth document's title: the three best sentences of its machine's documents by shared words."""
    d = _docs(spark, sf_dir).select("doc_id", machine(F.col("equipment_tag")).alias("tag"), "title", "text")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 3))
    asked = d.where("doc_id % 20 = 0 AND title IS NOT NULL AND tag IS NOT NULL").select(F.col("doc_id").alias("query_id"), "tag", words(F.col("title")).alias("q"))
    # Only the machines that are asked about go on; their sentences are split before the join.
    found = d.join(asked.select("tag").distinct(), "tag", "left_semi").select("tag", "doc_id", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence"))
    # On machine and word: sentences without a word of the question never meet it.
    said = found.select("tag", "doc_id", "at", F.explode(words(F.col("sentence"))).alias("word"))
    hits = asked.select("query_id", "tag", F.size("q").alias("n"), F.explode("q").alias("word")).join(said, ["tag", "word"])
    hits = hits.groupBy("query_id", "n", "doc_id", "at").agg(F.count("*").alias("hits"))
    pairs = hits.select("query_id", "doc_id", "at", F.round(F.col("hits") / F.greatest("n", F.lit(1)), 6).alias("score")).join(found.select("doc_id", "at", "sentence"), ["doc_id", "at"])
    best = Window.partitionBy("query_id", "sentence").orderBy("doc_id", "at")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "at")
    once = pairs.withColumn("k", F.row_number().over(best)).where("k = 1")
    return once.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("query_id", "rank", "doc_id", "sentence", "score")


def offline_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority of machines: .6 criticality, .25 worst downtime, .1 documents, .05 any evidence."""
    e = table(spark, sf_dir, "equipment").select("tag", F.when(F.col("criticality") == "A", 1.0).when(F.col("criticality") == "B", 0.6).otherwise(0.3).alias("crit"))
    f = table(spark, sf_dir, "failure").select(machine(F.col("equipment_tag")).alias("tag"), "downtime_hours").groupBy("tag").agg(F.max("downtime_hours").alias("worst"))
    d = table(spark, sf_dir, "documents").select(machine(F.col("equipment_tag")).alias("tag")).groupBy("tag").agg(F.count("*").alias("docs"))
    rows = e.join(f, "tag", "left").join(d, "tag", "left")
    score = 0.6 * F.col("crit") + 0.25 * F.least(F.lit(1.0), F.coalesce("worst", F.lit(0.0)) / 72) + 0.1 * F.least(F.lit(1.0), F.coalesce("docs", F.lit(0)) / 20) + 0.05 * F.when(F.col("docs") > 0, 1.0).otherwise(0.0)
    return rows.select("tag", F.round(score, 6).alias("priority"))


def quantised_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of all rows on byte vectors, cosine clamped at 0, zeros dropped."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).cast("array<double>").alias("vector"))
    top = retrieval.topk(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), v, 5)
    return top.select("query_id", "id", F.round(2 * F.col("score") - 1, 6).alias("score"), "rank").where("score > 0")


def path_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to supplier paths in words."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).join(s, F.col("n_nationkey") == F.col("s_nationkey"))
    nodes, links = F.array("r_name", "n_name", "s_name"), F.array(F.lit(" —PART_OF→ "), F.lit(" —HAS→ "), F.lit(""))
    return rows.select("s_suppkey", F.array_join(F.zip_with(nodes, links, lambda a, b: F.concat(a, b)), "").alias("path"))


def failure_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each failure with up to two that preceded it on its machine, and the days between."""
    f = table(spark, sf_dir, "failure").select("event_id", machine(F.col("equipment_tag")).alias("tag"), "occurred_on").dropna()
    w = Window.partitionBy("tag").orderBy("occurred_on", "event_id")
    return f.select("event_id", F.lag("event_id").over(w).alias("first_before"), F.lag("event_id", 2).over(w).alias("second_before"), F.datediff("occurred_on", F.coalesce(F.lag("occurred_on", 2).over(w), F.lag("occurred_on").over(w))).alias("gap_days"))


def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not written down: modes without a cause, repeated work without a procedure, open recommendations."""
    f = table(spark, sf_dir, "failure").select(machine(F.col("equipment_tag")).alias("tag"), F.lower(F.trim("failure_mode")).alias("subject"), "root_cause")
    causes = f.dropna(subset=["tag", "subject"]).groupBy("tag", "subject").agg(F.max(F.length(F.trim("root_cause"))).alias("n")).where("coalesce(n, 0) = 0").select("tag", F.lit("no_root_cause").alias("gap"), "subject")
    r = trend.records_of(table(spark, sf_dir, "maintenance")).where("tag IS NOT NULL")
    sop = table(spark, sf_dir, "documents").where("document_type = 'sop'").select(machine(F.col("equipment_tag")).alias("tag")).where("tag IS NOT NULL").distinct()
    work = r.groupBy("tag", F.col("record_type").alias("subject")).agg(F.count("*").alias("n")).where("n >= 2 AND subject IS NOT NULL").join(sop, "tag", "left_anti").select("tag", F.lit("no_procedure").alias("gap"), "subject")
    open_ = r.where("length(trim(recommendations)) > 0 AND coalesce(status, '') <> 'closed'").select("tag", F.lit("open_recommendation").alias("gap"), F.col("record_id").alias("subject"))
    return causes.unionByName(work).unionByName(open_)


def uncertainty_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines whose evidence is weak: poorly read papers, or a single document."""
    p = table(spark, sf_dir, "parse_outcome").where("ocr_confidence < 0.55").select(machine(F.col("equipment_tag")).alias("tag"), F.lit("low_ocr").alias("flag"))
    d = table(spark, sf_dir, "documents").select(machine(F.col("equipment_tag")).alias("tag"), "doc_id").groupBy("tag").agg(F.count_distinct("doc_id").alias("n")).where("n < 2").select("tag", F.lit("sparse").alias("flag"))
    return p.unionByName(d).where("tag IS NOT NULL").distinct()


def threshold_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading at 85 % of its limit or above, not only the latest."""
    limits = table(spark, sf_dir, "equipment").select("tag", F.explode("oem_thresholds").alias("parameter", "threshold")).where("threshold > 0")
    r = trend.latest_deliveries(table(spark, sf_dir, "reading"))
    return r.join(limits, ["tag", "parameter"]).where(F.col("value") / F.col("threshold") >= 0.85).select("reading_id", F.round(F.col("value") / F.col("threshold"), 6).alias("ratio"))


def diagnostic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each machine's evidence holds, step by step, as counts; one pass per table."""
    at = F.lit(m.AS_OF).cast("date")
    r = trend.records_of(table(spark, sf_dir, "maintenance")).where(F.datediff(at, "performed_on") <= 90).select("tag", F.lit("maintenance_90d").alias("step"))
    f = table(spark, sf_dir, "failure").select(machine(F.col("equipment_tag")).alias("tag"), F.lit("failures").alias("step"))
    d = table(spark, sf_dir, "documents").select(machine(F.col("equipment_tag")).alias("tag"), "document_type", F.datediff(at, "document_date").alias("age"))
    logs = d.where("document_type = 'shift_log' AND age <= 30").select("tag", F.lit("shift_logs_30d").alias("step"))
    seen = d.where("document_type = 'inspection_report' AND age <= 180").select("tag", F.lit("inspections_180d").alias("step"))
    return r.unionByName(f).unionByName(logs).unionByName(seen).where("tag IS NOT NULL").groupBy("tag", "step").agg(F.count("*").alias("items"))


def failure_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine with its risk and confidence; 0 and .35 where no signal is active."""
    risk = m.noisy_or_risk(spark, sf_dir).select("tag", "risk", "confidence")
    return table(spark, sf_dir, "equipment").select("tag").join(risk, "tag", "left").select("tag", F.coalesce("risk", F.lit(0.0)).alias("probability"), F.coalesce("confidence", F.lit(0.35)).alias("confidence"))


def queue_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 queries of the queue by time of arrival: the batch size is the feature."""
    return table(spark, sf_dir, "voice_query").orderBy("received_at", "query_id").limit(25).select("query_id")


def daily_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", F.to_date("ingested_at").alias("day")).agg(F.count("*").alias("documents"))


def catalogue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resolution per raw value: the surest, then the earliest."""
    rows = table(spark, sf_dir, "tag_resolution").where("raw IS NOT NULL")
    best = F.max_by(F.struct("resolution_id", "tag"), F.struct(F.col("confidence"), -F.col("resolution_id")))
    return rows.groupBy("raw").agg(best.alias("b")).select("raw", "b.resolution_id", "b.tag")


_M = m._M
QUERIES = {
    f.__name__: f
    for f in (
        question_classes, derived_records, procedure_steps, interval_phrases, masked_tags, glyph_readings, alias_scan, entity_mentions, grounding, normalised_text, extractive_answers, offline_priority, quantised_topk,
        path_narratives, failure_chains, knowledge_gaps, uncertainty_flags, threshold_breaches, diagnostic_steps, failure_prediction, queue_drain, daily_ledger, catalogue_merge,
    )
}


def _class_sql() -> str:
    scores = " UNION ALL ".join(
        f"SELECT query_id, '{name}' AS class, " + " + ".join(f"CASE WHEN regexp_matches(lower(transcript), '{p}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in patterns) + " AS s FROM voice_query WHERE transcript IS NOT NULL" for name, patterns in extract.QUESTION_CLASSES.items()
    )
    return f"""
        WITH c AS ({scores}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, class) AS k, lead(s) OVER (PARTITION BY query_id ORDER BY s DESC, class) AS second FROM c)
        SELECT query_id, class, round(least(1.0, s / 1.2::DOUBLE), 6) AS score, round((s - second) / s, 6) AS separation FROM k WHERE k = 1 AND s > 0"""


_TAGS = "regexp_extract_all(upper(text), '\\b([A-Z]{1,4}-[0-9]{2,5}[A-Z]?)\\b', 1)"
SQL = {
    "question_classes": _class_sql(),
    "derived_records": """
        WITH d AS (SELECT doc_id, CAST(nullif(regexp_extract(text, '([0-9]+(?:\\.[0-9]+)?) mm/s', 1), '') AS DOUBLE) AS vibration, CAST(nullif(regexp_extract(text, 'Downtime came to ([0-9]+) hours', 1), '') AS INTEGER) AS downtime,
          nullif(regexp_extract(text, '\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b', 1), '') AS dated FROM documents WHERE text IS NOT NULL)
        SELECT * FROM d WHERE vibration IS NOT NULL OR downtime IS NOT NULL OR dated IS NOT NULL""",
    "procedure_steps": """
        WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?m)^[ \\t]*[0-9]+[.)][ \\t]+([^\\r\\n]+)', 1), lambda x: trim(x)), lambda x: length(x) > 12) AS s FROM documents WHERE text IS NOT NULL AND document_type = 'sop')
        SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS step_no, unnest(s) AS step FROM s""",
    "interval_phrases": """
        WITH d AS (SELECT doc_id, regexp_extract(lower(text), '\\b(?:every|each|per|last)\\s+([0-9]+)?\\s*(day|week|month|quarter|year)s?\\b', 2) AS u, regexp_extract(lower(text), '\\b(?:every|each|per|last)\\s+([0-9]+)?\\s*(day|week|month|quarter|year)s?\\b', 1) AS n,
          regexp_extract(lower(text), '\\b(daily|weekly|fortnightly|monthly|quarterly|annually|yearly)\\b', 1) AS a FROM documents WHERE text IS NOT NULL),
        v AS (SELECT doc_id, CASE u WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'quarter' THEN 91 WHEN 'year' THEN 365 END * coalesce(CAST(nullif(n, '') AS INTEGER), 1) AS d1,
          CASE a WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'fortnightly' THEN 14 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 91 WHEN 'annually' THEN 365 WHEN 'yearly' THEN 365 END AS d2 FROM d)
        SELECT doc_id, greatest(1, least(3650, coalesce(d1, d2))) AS days FROM v WHERE coalesce(d1, d2) IS NOT NULL""",
    "alias_scan": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 0) AS w FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS alias FROM p, (VALUES (1), (2), (3), (4)) v(n) WHERE i + n - 1 <= len(w)),
        a AS (SELECT DISTINCT regexp_replace(lower(name), ' (pump|compressor|tank|drum|exchanger|valve|motor|filter|controller|reactor)( [a-c])?$', '') AS alias FROM equipment)
        SELECT doc_id, alias FROM g JOIN a USING (alias)""",
    "entity_mentions": f"""
        SELECT DISTINCT doc_id, 'equipment:' || t AS key, 0.9::DOUBLE AS confidence FROM (SELECT doc_id, unnest({_TAGS}) AS t FROM documents WHERE text IS NOT NULL)
        WHERE regexp_extract(t, '^([A-Z]+)', 1) NOT IN ('ISO', 'API', 'IEC', 'ASME', 'DN', 'PN', 'REV', 'RPM', 'HW', 'OISD', 'IS', 'SS')
        UNION ALL SELECT doc_id, 'mode:' || m, 0.86::DOUBLE FROM documents, (SELECT unnest(['leak', 'vibration', 'corrosion', 'cavitation', 'misalignment', 'pitting', 'hunting', 'packing wear']) AS m) WHERE contains(lower(text), m)""",
    "grounding": f"""
        WITH {_M}, w AS (SELECT record_id, lower(findings) AS f, list_distinct(list_filter(regexp_split_to_array(lower(recommendations), '[^a-z]+'), lambda x: length(x) >= 4)) AS w FROM m WHERE length(recommendations) > 0 AND length(findings) > 0)
        SELECT record_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(f, substring(x, 1, 5)))) / len(w)::DOUBLE ELSE 0.0::DOUBLE END, 6) AS share FROM w""",
    "offline_priority": """
        WITH f AS (SELECT upper(trim(equipment_tag)) AS tag, max(downtime_hours) AS worst FROM failure GROUP BY 1), d AS (SELECT upper(trim(equipment_tag)) AS tag, count(*) AS docs FROM documents GROUP BY 1)
        SELECT e.tag, round(0.6::DOUBLE * (CASE criticality WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 ELSE 0.3 END)::DOUBLE + 0.25::DOUBLE * least(1.0, coalesce(worst, 0) / 72) + 0.1::DOUBLE * least(1.0::DOUBLE, coalesce(docs, 0) / 20.0::DOUBLE) + 0.05::DOUBLE * CASE WHEN docs > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS priority
        FROM equipment e LEFT JOIN f ON f.tag = e.tag LEFT JOIN d ON d.tag = e.tag""",
    "masked_tags": f"""
        SELECT doc_id, CAST(len(list_distinct(list_filter({_TAGS}, lambda t: regexp_extract(t, '^([A-Z]+)', 1) NOT IN ('ISO', 'API', 'IEC', 'ASME', 'DN', 'PN', 'REV', 'RPM', 'HW', 'OISD', 'IS', 'SS')))) AS INTEGER) AS tags,
          TRUE AS restored FROM documents WHERE text IS NOT NULL""",
    "glyph_readings": """
        WITH r AS (SELECT resolution_id, upper(trim(raw)) AS x FROM tag_resolution WHERE raw IS NOT NULL),
        p AS (SELECT resolution_id, regexp_extract(x, '^([A-Z0-9]{1,3})[-_ ./]', 1) AS prefix, regexp_extract(x, '^[A-Z0-9]{1,3}[-_ ./]+([A-Z0-9|]{2,6})$', 1) AS rest FROM r),
        n AS (SELECT *, regexp_extract(rest, '^.{2,}([ABC])$', 1) AS suffix FROM p), m AS (SELECT *, substring(rest, 1, length(rest) - length(suffix)) AS number FROM n),
        t AS (SELECT *, translate(prefix, '015862', 'OISBGZ') AS letters, translate(translate(number, '|', '1'), 'OQDILZSGTB', '0001125678') AS digits FROM m)
        SELECT resolution_id, letters || '-' || digits || suffix AS tag, CAST(levenshtein(prefix, letters) + levenshtein(number, digits) AS INTEGER) AS changes FROM t
        WHERE prefix <> '' AND rest <> '' AND regexp_full_match(digits, '[0-9]{2,5}') AND regexp_full_match(letters, '[A-Z]+')""",
    "quantised_topk": """
        WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
        q AS (SELECT vec_id, label, list_transform(e, lambda x: round_even(x / n * 127, 0)) AS b FROM n),
        p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(greatest(list_cosine_similarity(a.b, b.b), 0), 9) AS score FROM q a, q b WHERE a.vec_id % 20 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p WHERE score > 0) SELECT query_id, id, score, rank FROM k WHERE rank <= 5""",
    "path_narratives": """
        SELECT s_suppkey, r_name || ' —PART_OF→ ' || n_name || ' —HAS→ ' || s_name AS path FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey""",
    "failure_chains": """
        WITH f AS (SELECT event_id, nullif(upper(trim(equipment_tag)), '') AS tag, occurred_on FROM failure WHERE equipment_tag IS NOT NULL AND occurred_on IS NOT NULL)
        SELECT event_id, lag(event_id) OVER w AS first_before, lag(event_id, 2) OVER w AS second_before, CAST(date_diff('day', coalesce(lag(occurred_on, 2) OVER w, lag(occurred_on) OVER w), occurred_on) AS INTEGER) AS gap_days
        FROM f WHERE tag IS NOT NULL WINDOW w AS (PARTITION BY tag ORDER BY occurred_on, event_id)""",
    "knowledge_gaps": f"""
        WITH {_M}, sop AS (SELECT upper(trim(equipment_tag)) AS tag FROM documents WHERE document_type = 'sop' AND equipment_tag IS NOT NULL)
        SELECT nullif(upper(trim(equipment_tag)), '') AS tag, 'no_root_cause' AS gap, lower(trim(failure_mode)) AS subject FROM failure WHERE equipment_tag IS NOT NULL AND failure_mode IS NOT NULL GROUP BY 1, 3 HAVING coalesce(max(length(trim(root_cause))), 0) = 0
        UNION ALL SELECT tag, 'no_procedure', record_type FROM m WHERE tag IS NOT NULL AND record_type IS NOT NULL AND tag NOT IN (SELECT tag FROM sop) GROUP BY tag, record_type HAVING count(*) >= 2
        UNION ALL SELECT tag, 'open_recommendation', record_id FROM m WHERE tag IS NOT NULL AND length(trim(recommendations)) > 0 AND coalesce(status, '') <> 'closed'""",
    "uncertainty_flags": """
        SELECT DISTINCT upper(trim(equipment_tag)) AS tag, 'low_ocr' AS flag FROM parse_outcome WHERE ocr_confidence < 0.55 AND equipment_tag IS NOT NULL
        UNION SELECT upper(trim(equipment_tag)), 'sparse' FROM documents WHERE equipment_tag IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) < 2""",
    "threshold_breaches": f"""
        WITH {m._R}, l AS (SELECT tag, x.key AS parameter, x.value AS threshold FROM (SELECT tag, unnest(map_entries(oem_thresholds)) AS x FROM equipment))
        SELECT reading_id, round(value / threshold, 6) AS ratio FROM r JOIN l USING (tag, parameter) WHERE threshold > 0 AND value / threshold >= 0.85""",
    "diagnostic_steps": f"""
        WITH {_M}, d AS (SELECT upper(trim(equipment_tag)) AS tag, document_type, date_diff('day', document_date, DATE '2024-06-30') AS age FROM documents WHERE equipment_tag IS NOT NULL),
        s AS (SELECT tag, 'maintenance_90d' AS step FROM m WHERE date_diff('day', performed_on, DATE '2024-06-30') <= 90 UNION ALL SELECT upper(trim(equipment_tag)), 'failures' FROM failure
          UNION ALL SELECT tag, 'shift_logs_30d' FROM d WHERE document_type = 'shift_log' AND age <= 30 UNION ALL SELECT tag, 'inspections_180d' FROM d WHERE document_type = 'inspection_report' AND age <= 180)
        SELECT tag, step, count(*) AS items FROM s WHERE tag IS NOT NULL AND tag <> '' GROUP BY 1, 2""",
    "failure_prediction": f"""SELECT e.tag, coalesce(risk, 0) AS probability, coalesce(confidence, 0.35::DOUBLE) AS confidence FROM equipment e LEFT JOIN ({m.SQL["noisy_or_risk"]}) r ON r.tag = e.tag""",
    "queue_drain": "SELECT query_id FROM voice_query ORDER BY received_at, query_id LIMIT 25",
    "daily_ledger": "SELECT source, CAST(ingested_at AS DATE) AS day, count(*) AS documents FROM documents GROUP BY 1, 2",
    "catalogue_merge": """
        WITH k AS (SELECT raw, resolution_id, tag, row_number() OVER (PARTITION BY raw ORDER BY confidence DESC NULLS LAST, resolution_id) AS k FROM tag_resolution WHERE raw IS NOT NULL) SELECT raw, resolution_id, tag FROM k WHERE k = 1""",
}
