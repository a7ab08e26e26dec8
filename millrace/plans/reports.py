"""Queries that summarise evidence: rates, bands, previews, merges, digests, explanations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import extract, text
from millrace.functions.clock import machine
from millrace.functions.confidence import clamp, recency
from millrace.operators import documents as docs_ops
from millrace.operators import graph, retrieval, trend
from millrace.operators.skew import is_small
from millrace.plans import machines as m
from millrace.plans import retrieval as search
from millrace.plans.vocabulary import BYPASS_SQL
from millrace.session import checkpointed, table


def fleet_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures per machine and year of each type, over the span of the failure table."""
    f = table(spark, sf_dir, "failure").where("occurred_on IS NOT NULL").select(machine(F.col("equipment_tag")).alias("tag"), "occurred_on")
    span = f.agg(F.datediff(F.max("occurred_on"), F.min("occurred_on")).alias("d")).first()["d"] or 1
    e = table(spark, sf_dir, "equipment").select("tag", "equipment_type")
    n = e.groupBy("equipment_type").agg(F.count("*").alias("machines"))
    events = f.join(e, "tag").groupBy("equipment_type").agg(F.count("*").alias("events"))
    return n.join(events, "equipment_type", "left").select("equipment_type", "machines", F.coalesce("events", F.lit(0).cast("long")).alias("events"), F.round(F.coalesce("events", F.lit(0)) / (F.col("machines") * (F.lit(span) / 365.25)), 6).alias("rate"))


def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = m.noisy_or_risk(spark, sf_dir)
    band = F.when(F.col("risk") >= 0.75, "critical").when(F.col("risk") >= 0.5625, "high").when(F.col("risk") >= 0.375, "warning").when(F.col("risk") >= 0.1875, "low").otherwise("info")
    return risk.groupBy(band.alias("band")).agg(F.count("*").alias("machines"))


def bypass_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of bypass language per document: repeated mentions, the strongest term, faded with age."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "document_date")
    hits = docs_ops.term_counts(d, text.BYPASS_TERMS).groupBy("doc_id").agg(F.sum("hits").alias("n"), F.max("weight").alias("peak"))
    age = F.datediff(F.lit(m.AS_OF).cast("date"), "document_date").cast("double")
    out = hits.join(d.select("doc_id", "document_date"), "doc_id")
    return out.select("doc_id", F.round(clamp((0.5 + 0.25 * (F.col("n") - 1)) * F.col("peak")) * (0.6 + 0.4 * recency(age, 45.0)), 6).alias("strength"))


def machine_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything dated about each machine in one table, numbered from the newest."""
    f = table(spark, sf_dir, "failure").select(machine(F.col("equipment_tag")).alias("tag"), F.lit("failure").alias("kind"), F.col("event_id").alias("id"), F.col("occurred_on").alias("day"))
    r = trend.records_of(table(spark, sf_dir, "maintenance")).select("tag", F.lit("maintenance").alias("kind"), F.col("record_id").alias("id"), F.col("performed_on").alias("day"))
    w = Window.partitionBy("tag").orderBy(F.desc("day"), "kind", "id")
    return f.unionByName(r).where("tag IS NOT NULL AND day IS NOT NULL").withColumn("position", F.row_number().over(w).cast("long"))


def equipment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines that differ in their unit letter alone, merged: later values win, limits by parameter, the greater one."""
    e = table(spark, sf_dir, "equipment").select(F.regexp_replace("tag", "[A-Z]$", "").alias("base"), "tag", "manufacturer", "oem_thresholds")
    latest = e.groupBy("base").agg(F.max_by("manufacturer", F.when(F.col("manufacturer").isNotNull(), F.col("tag"))).alias("manufacturer"), F.count("*").alias("machines"))
    limits = e.select("base", F.explode("oem_thresholds").alias("parameter", "threshold")).groupBy("base", "parameter").agg(F.max("threshold").alias("threshold"))
    merged = limits.groupBy("base").agg(F.count("*").alias("limits"), F.round(F.sum("threshold"), 4).alias("limit_sum"))
    return latest.join(merged, "base", "left").select("base", "manufacturer", "machines", F.coalesce("limits", F.lit(0).cast("long")).alias("limits"), "limit_sum")


def citation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations renumbered by first appearance, those of no source removed, in sentences about each document."""
    n = lambda k: F.concat(F.lit("["), (F.col("doc_id") % k).cast("string"), F.lit("]"))
    answer = F.concat(F.lit("First "), n(7), F.lit(" then "), n(5), F.lit(" again "), n(7), F.lit("."))
    rows = table(spark, sf_dir, "documents").select("doc_id", extract.renumbered(answer, F.lit(4)).alias("r"))
    return rows.select("doc_id", F.col("r.text").alias("answer"), F.array_join(F.transform("r.cited", lambda c: c.cast("string")), ",").alias("cited"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered clauses of manuals with at least 60 characters: number, title and length of the body."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND document_type = 'oem_manual'")
    parts = d.select("doc_id", F.explode(F.split("text", r"(?m)(?=^[0-9]+\.[0-9]+ [A-Z])")).alias("part"))
    parts = parts.select("doc_id", F.regexp_extract("part", r"^([0-9]+\.[0-9]+) ([^\r\n]*)", 1).alias("clause"), F.regexp_extract("part", r"^([0-9]+\.[0-9]+) ([^\r\n]*)", 2).alias("title"), F.length(F.trim(F.regexp_replace("part", r"^[^\n]*\n?", ""))).alias("characters"))
    return parts.where("clause <> '' AND characters >= 60")


def corroboration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents behind each machine's mentions, and whether they are too few."""
    d = table(spark, sf_dir, "documents").select(machine(F.col("equipment_tag")).alias("tag"), "doc_id").where("tag IS NOT NULL")
    return d.groupBy("tag").agg(F.count_distinct("doc_id").alias("documents")).withColumn("sparse", F.col("documents") < 2)


def fusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query of the fused search: passages, best and mean score, and those the graph alone lifted."""
    out = search.minmax_fusion(spark, sf_dir)
    return out.groupBy("query_id").agg(F.count("*").alias("passages"), F.max("fused").alias("best"), F.round(F.avg("fused"), 5).alias("mean"), F.count(F.when(F.col("graph_score") > F.col("vector_score"), 1)).alias("graph_led"))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each fused passage in words."""
    out = search.minmax_fusion(spark, sf_dir)
    said = F.format_string("rank %d: fused %.3f from vector %.3f and graph %.3f", F.col("rank"), F.col("fused"), F.col("vector_score"), F.col("graph_score"))
    return out.select("query_id", "id", said.alias("explanation"))


def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each query: passages of the search first, then its label's neighbours; each once, eight at most."""
    top = search.minmax_fusion(spark, sf_dir).select("query_id", "id", F.lit(0).alias("order"), F.col("rank").alias("place"))
    near = search.candidate_union(spark, sf_dir).where("graph_score > 0").select("query_id", "id", F.lit(1).alias("order"), F.col("id").alias("place"))
    once = top.unionByName(near).groupBy("query_id", "id").agg(F.min(F.struct("order", "place")).alias("o"))
    w = Window.partitionBy("query_id").orderBy("o.order", "o.place", "id")
    return once.withColumn("position", F.row_number().over(w).cast("long")).where("position <= 8").select("query_id", "id", "position")


def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "equipment").groupBy("equipment_type", "criticality").agg(F.count("*").alias("machines"))


def extractive_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two sentences of the three best documents of each lexical query, as one cited line each."""
    top = checkpointed(search.lexical_tfidf_topk(spark, sf_dir).where("rank <= 3").select("query_id", "id", "rank"))
    wanted = checkpointed(top.select("id").distinct())
    wanted = F.broadcast(wanted) if is_small(wanted) else wanted
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    d = d.select("id", F.array_join(F.slice(text.sentences(F.col("text")), 1, 2), " ").alias("lead"))  # only documents that are cited are cut into sentences
    return top.join(d, "id").select("query_id", "rank", F.concat("lead", F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("line"))


def supply_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of suppliers and customers, tied by their nation."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    edges = s.select(F.concat(F.lit("S"), "s_suppkey").alias("source"), F.concat(F.lit("N"), "s_nationkey").alias("target")).unionByName(
        c.select(F.concat(F.lit("C"), "c_custkey").alias("source"), F.concat(F.lit("N"), "c_nationkey").alias("target"))
    )
    return graph.components(edges)


def ocr_lines(words: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """(page, line, text): words grouped into lines, each anchored on its first word. words: page, x, y, height, word."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"], ignore_index=True)
        lines: list[tuple[float, float, list]] = []
        for x, y, h, word in frame[["x", "y", "height", "word"]].itertuples(index=False):
            middle = y + h / 2
            if not lines or abs(middle - lines[-1][0]) > tolerance * lines[-1][1]:
                lines.append((middle, h, []))
            lines[-1][2].append((x, word))
        return pd.DataFrame({"page": frame["page"].iloc[0], "line": range(1, len(lines) + 1), "text": [" ".join(w for _, w in sorted(ws)) for _, _, ws in lines]})

    return words.groupBy("page").applyInPandas(group, "page long, line long, text string")


QUERIES = {
    f.__name__: f
    for f in (
        fleet_base_rate, severity_bands, bypass_strength, machine_history, equipment_merge, citation_map, clauses, corroboration_counts, fusion_summary, explanations, source_merge, catalogue_counts, extractive_fallback, supply_components,
    )
}
_BY = f"SELECT doc_id, len(regexp_extract_all(lower(text), pattern)) AS hits, weight FROM documents, {BYPASS_SQL} WHERE text IS NOT NULL"
SQL = {
    "fleet_base_rate": """
        WITH f AS (SELECT upper(trim(equipment_tag)) AS tag, occurred_on FROM failure WHERE occurred_on IS NOT NULL), s AS (SELECT date_diff('day', min(occurred_on), max(occurred_on)) AS d FROM f),
        n AS (SELECT equipment_type, count(*) AS machines FROM equipment GROUP BY 1), v AS (SELECT equipment_type, count(*) AS events FROM f JOIN equipment USING (tag) GROUP BY 1)
        SELECT equipment_type, machines, coalesce(events, 0) AS events, round(coalesce(events, 0) / (machines * (d / 365.25::DOUBLE)), 6) AS rate FROM n LEFT JOIN v USING (equipment_type), s""",
    "severity_bands": f"""
        SELECT CASE WHEN risk >= 0.75 THEN 'critical' WHEN risk >= 0.5625 THEN 'high' WHEN risk >= 0.375 THEN 'warning' WHEN risk >= 0.1875 THEN 'low' ELSE 'info' END AS band, count(*) AS machines FROM ({m.SQL["noisy_or_risk"]}) GROUP BY 1""",
    "bypass_strength": f"""
        WITH h AS ({_BY}), g AS (SELECT doc_id, sum(hits) AS n, max(weight) AS peak FROM h WHERE hits > 0 GROUP BY 1)
        SELECT doc_id, round(least(1.0, (0.5::DOUBLE + 0.25::DOUBLE * (n - 1)) * peak) * (0.6::DOUBLE + 0.4::DOUBLE * CASE WHEN document_date IS NULL THEN 0.5::DOUBLE ELSE pow(2.0::DOUBLE, -greatest(date_diff('day', document_date, DATE '2024-06-30'), 0) / 45.0::DOUBLE) END), 6) AS strength
        FROM g JOIN documents USING (doc_id)""",
    "machine_history": f"""
        WITH {m._M}, h AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, 'failure' AS kind, event_id AS id, occurred_on AS day FROM failure UNION ALL SELECT tag, 'maintenance', record_id, performed_on FROM m)
        SELECT *, row_number() OVER (PARTITION BY tag ORDER BY day DESC, kind, id) AS position FROM h WHERE tag IS NOT NULL AND day IS NOT NULL""",
    "equipment_merge": """
        WITH e AS (SELECT regexp_replace(tag, '[A-Z]$', '') AS base, tag, manufacturer, oem_thresholds FROM equipment), x AS (SELECT base, unnest(map_entries(oem_thresholds)) AS x FROM e),
        l AS (SELECT base, x.key AS parameter, max(x.value) AS threshold FROM x GROUP BY 1, 2), s AS (SELECT base, count(*) AS limits, round(sum(threshold), 4) AS limit_sum FROM l GROUP BY 1),
        g AS (SELECT base, arg_max(manufacturer, tag) FILTER (manufacturer IS NOT NULL) AS manufacturer, count(*) AS machines FROM e GROUP BY 1)
        SELECT base, manufacturer, machines, coalesce(limits, 0) AS limits, limit_sum FROM g LEFT JOIN s USING (base)""",
    "corroboration_counts": "SELECT upper(trim(equipment_tag)) AS tag, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) < 2 AS sparse FROM documents WHERE equipment_tag IS NOT NULL AND trim(equipment_tag) <> '' GROUP BY 1",
    "fusion_summary": f"""
        SELECT query_id, count(*) AS passages, max(fused) AS best, round(avg(fused), 5) AS mean, count(*) FILTER (graph_score > vector_score) AS graph_led FROM ({search.SQL["minmax_fusion"]}) GROUP BY 1""",
    "explanations": f"SELECT query_id, id, printf('rank %d: fused %.3f from vector %.3f and graph %.3f', rank, fused, vector_score, graph_score) AS explanation FROM ({search.SQL['minmax_fusion']})",
    "source_merge": f"""
        WITH t AS ({search.SQL["minmax_fusion"]}), u AS ({search.SQL["candidate_union"]}), a AS (SELECT query_id, id, 0 AS o, rank AS p FROM t UNION ALL SELECT query_id, id, 1, id FROM u WHERE graph_score > 0),
        b AS (SELECT query_id, id, min((o, p)) AS k FROM a GROUP BY 1, 2), n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k, id) AS position FROM b)
        SELECT * FROM n WHERE position <= 8""",
    "catalogue_counts": "SELECT equipment_type, criticality, count(*) AS machines FROM equipment GROUP BY 1, 2",
    "citation_map": """
        WITH d AS (SELECT doc_id, doc_id % 7 AS a, doc_id % 5 AS b FROM documents), v AS (SELECT *, a BETWEEN 1 AND 4 AS va, b BETWEEN 1 AND 4 AS vb FROM d)
        SELECT doc_id, 'First ' || CASE WHEN va THEN '[1]' ELSE '' END || ' then ' || CASE WHEN NOT vb THEN '' WHEN a = b OR NOT va THEN '[1]' ELSE '[2]' END || ' again ' || CASE WHEN va THEN '[1]' ELSE '' END || '.' AS answer,
          CASE WHEN va AND vb AND a <> b THEN a || ',' || b WHEN va THEN CAST(a AS VARCHAR) WHEN vb THEN CAST(b AS VARCHAR) ELSE '' END AS cited FROM v""",
    "supply_components": """
        WITH e AS (SELECT 'S' || s_suppkey AS a, 'N' || s_nationkey AS b FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
        m AS (SELECT b, least(min(a), b) AS component FROM e GROUP BY b) SELECT DISTINCT a AS key, component FROM e JOIN m USING (b) UNION SELECT b, component FROM m""",
}
