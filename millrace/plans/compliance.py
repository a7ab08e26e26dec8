"""Queries on evidence and requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import revision
from millrace.operators import compliance as ops
from millrace.plans.machines import AS_OF
from millrace.session import table

#: A catalogue as load_catalogue reads it.
REQUIREMENTS = [
    ("Q1", "pump", "work_order", 20, 5, None, ["findings", "performed_by"], 2), ("Q2", "exchanger", "inspection_report", 30, 0, 1, [], 3), ("Q3", "valve", "inspection", 40, 10, None, ["findings", "recommendations"], 1),
    ("Q4", "tank", "sop", 60, 0, None, [], 2), ("Q5", "heat exchanger", "preventive", 25, 0, None, ["performed_by"], 0), ("Q6", "motor", "calibration", 365, 30, None, [], 3), ("Q7", "compressor", "incident_report", 90, 0, 2, ["findings"], 1),
]


def _requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, ops.CATALOGUE)


def _at():
    return F.lit(AS_OF).cast("date")


def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ops.evidence_items(table(spark, sf_dir, "maintenance"), table(spark, sf_dir, "documents"))
    return items.select("tag", "evidence_type", "item", "dated", F.concat_ws(",", "fields").alias("fields"), "revision")


def evidence_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each machine has by type: how many, the newest item, and when."""
    items = ops.evidence_items(table(spark, sf_dir, "maintenance"), table(spark, sf_dir, "documents"))
    newest = F.max_by("item", F.when(F.col("dated").isNotNull(), F.struct("dated", "item")))
    return items.groupBy("tag", "evidence_type").agg(F.count("*").alias("items"), newest.alias("newest"), F.max("dated").alias("last"))


def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ops.evidence_items(table(spark, sf_dir, "maintenance"), table(spark, sf_dir, "documents"))
    due = ops.required_of(table(spark, sf_dir, "equipment").select("tag", "equipment_type"), _requirements(spark))
    return ops.best_evidence(due, items, _at()).withColumn("missing", F.concat_ws(",", "missing"))


def requirement_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ops.evidence_items(table(spark, sf_dir, "maintenance"), table(spark, sf_dir, "documents"))
    return ops.assessed(table(spark, sf_dir, "equipment"), _requirements(spark), items, _at())


def gap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per requirement: machines by status, the worst severity and the longest delay."""
    rows = requirement_assessment(spark, sf_dir)
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("compliant", "incomplete", "outdated", "missing")]
    return rows.groupBy("requirement").agg(*counts, F.max("severity").alias("worst"), F.max("days_overdue").alias("longest"))


def gap_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about each gap, in words, by status."""
    rows = requirement_assessment(spark, sf_dir).where("status <> 'compliant'")
    text = F.when(F.col("status") == "missing", F.lit("Obtain evidence")).when(F.col("status") == "outdated", F.lit("Renew evidence")).when(F.length("missing") > 0, F.concat(F.lit("Complete: "), F.col("missing"))).otherwise(F.lit("Date the evidence"))
    return rows.select("tag", "requirement", text.alias("action"), "severity")


def document_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", revision(F.col("text")).alias("revision")).where("revision IS NOT NULL")


def types_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requirements bind which type of machine, by their pattern's words."""
    e = table(spark, sf_dir, "equipment").select("equipment_type").distinct()
    return ops.required_of(e, _requirements(spark)).select("equipment_type", "requirement")


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.obligations(table(spark, sf_dir, "documents"))


def distinct_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_obligations(ops.obligations(table(spark, sf_dir, "documents")))


def title_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name of a kind of document or machine that a title holds."""
    d = table(spark, sf_dir, "documents")
    names = d.where("document_type IS NOT NULL").select(F.regexp_replace("document_type", "_", " ").alias("name")).union(table(spark, sf_dir, "equipment").where("equipment_type IS NOT NULL").select("equipment_type")).distinct()
    return ops.longest_name(d.select("doc_id", "title"), names)


_D = f"DATE '{AS_OF}'"
_WS = " \\t\\n\\r\\f\\v"
_REQ = """rq AS (SELECT * FROM (VALUES ('Q1', 'pump', 'work_order', 20, 5, NULL, ['findings', 'performed_by'], 2), ('Q2', 'exchanger', 'inspection_report', 30, 0, 1, CAST([] AS VARCHAR[]), 3),
    ('Q3', 'valve', 'inspection', 40, 10, NULL, ['findings', 'recommendations'], 1), ('Q4', 'tank', 'sop', 60, 0, NULL, CAST([] AS VARCHAR[]), 2), ('Q5', 'heat_exchanger', 'preventive', 25, 0, NULL, ['performed_by'], 0),
    ('Q6', 'motor', 'calibration', 365, 30, NULL, CAST([] AS VARCHAR[]), 3), ('Q7', 'compressor', 'incident_report', 90, 0, 2, ['findings'], 1)) v(requirement, pattern, evidence_type, days, grace, least_revision, required, severity)),
    dq AS (SELECT e.tag, e.equipment_type, e.criticality, e.installed_on, rq.* FROM equipment e JOIN rq ON e.equipment_type = rq.pattern OR (rq.pattern = 'exchanger' AND e.equipment_type = 'heat_exchanger'))"""
_REV = f"CAST(nullif(regexp_extract(lower(text), '\\brev(ision)?\\.?[{_WS}]*([0-9]+)', 2), '') AS INTEGER)"
_ITEMS = f"""it AS (
    SELECT nullif(upper(trim(equipment_tag)), '') AS tag, record_type AS evidence_type, record_id AS item, performed_on AS dated,
      list_filter([CASE WHEN length(trim(findings)) > 0 THEN 'findings' END, CASE WHEN length(trim(performed_by)) > 0 THEN 'performed_by' END, CASE WHEN length(trim(recommendations)) > 0 THEN 'recommendations' END,
        CASE WHEN length(trim(status)) > 0 THEN 'status' END], lambda x: x IS NOT NULL) AS fields, CAST(NULL AS INTEGER) AS revision FROM (SELECT DISTINCT ON (record_id) * FROM maintenance)
    UNION ALL SELECT nullif(upper(trim(equipment_tag)), ''), document_type, CAST(doc_id AS VARCHAR), document_date,
      list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?m)^([A-Za-z][A-Za-z ]{{1,30}}):[ \\t]*[^ \\t\\r\\n]', 1), lambda n: CASE trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_')
        WHEN 'done_by' THEN 'performed_by' WHEN 'inspector' THEN 'performed_by' WHEN 'result' THEN 'findings' WHEN 'observation' THEN 'findings' WHEN 'remarks' THEN 'recommendations' WHEN 'action' THEN 'recommendations'
        ELSE trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_') END))), {_REV} FROM documents WHERE text IS NOT NULL),
    ev AS (SELECT * FROM it WHERE tag IS NOT NULL AND evidence_type IS NOT NULL)"""
_BEST = f"""ca AS (SELECT dq.tag, requirement, item, dated, revision, list_sort(list_filter(required, lambda f: NOT list_contains(fields, f))) AS missing FROM dq JOIN ev USING (tag, evidence_type)
      WHERE date_diff('day', dated, {_D}) BETWEEN 0 AND days + grace),
    be AS (SELECT *, row_number() OVER (PARTITION BY tag, requirement ORDER BY len(missing), dated DESC, item) AS k FROM ca)"""
_ASSESSED = f"""{_REQ}, {_ITEMS}, {_BEST},
    sn AS (SELECT tag, evidence_type, count(*) AS items, max(dated) AS last FROM ev GROUP BY 1, 2),
    ld AS (SELECT dq.*, items, last, be.revision AS best_revision, coalesce(be.missing, CAST([] AS VARCHAR[])) AS lacking, coalesce(last, CASE WHEN items IS NULL THEN installed_on END) + days AS due
      FROM dq LEFT JOIN sn ON sn.tag = dq.tag AND sn.evidence_type = dq.evidence_type LEFT JOIN be ON be.tag = dq.tag AND be.requirement = dq.requirement AND be.k = 1),
    st AS (SELECT *, greatest(date_diff('day', due, {_D}) - grace, 0) AS over, CASE WHEN items IS NULL THEN 'missing' WHEN last IS NULL THEN 'incomplete' WHEN date_diff('day', last, {_D}) > days + grace THEN 'outdated'
      WHEN best_revision < least_revision THEN 'outdated' WHEN len(lacking) > 0 THEN 'incomplete' ELSE 'compliant' END AS status FROM ld),
    asd AS (SELECT tag, requirement, status, due, CAST(CASE WHEN due IS NOT NULL THEN over END AS INTEGER) AS days_overdue,
      CASE WHEN status <> 'compliant' THEN least(4, greatest(0, severity - CASE WHEN status = 'incomplete' THEN 1 ELSE 0 END + CASE WHEN criticality = 'A' THEN 1 ELSE 0 END + CASE WHEN due IS NOT NULL AND over >= days THEN 1 ELSE 0 END)) END AS severity,
      CASE WHEN status = 'incomplete' THEN array_to_string(lacking, ',') END AS missing FROM st)"""
_OBL = f"""ob AS (SELECT doc_id, position, trim(regexp_replace(c, '[{_WS}]+', ' ', 'g')) AS obligation FROM (
      SELECT doc_id, unnest(string_split_regex(text, '[.][{_WS}]+|[\\r\\n]+')) AS c, unnest(range(len(string_split_regex(text, '[.][{_WS}]+|[\\r\\n]+')))) AS position FROM documents WHERE text IS NOT NULL)
      WHERE regexp_matches(lower(c), '\\b(shall|must)\\b'))"""
QUERIES = {
    f.__name__: f
    for f in (evidence_items, evidence_newest, best_evidence, requirement_assessment, gap_matrix, gap_actions, document_revisions, types_required, obligations, distinct_obligations, title_kinds)
}
SQL = {
    "evidence_items": f"WITH {_ITEMS} SELECT tag, evidence_type, item, dated, array_to_string(fields, ',') AS fields, revision FROM ev",
    "evidence_newest": f"WITH {_ITEMS} SELECT tag, evidence_type, count(*) AS items, arg_max(item, (dated, item)) FILTER (dated IS NOT NULL) AS newest, max(dated) AS last FROM ev GROUP BY 1, 2",
    "best_evidence": f"WITH {_REQ}, {_ITEMS}, {_BEST} SELECT tag, requirement, item, dated, revision, array_to_string(missing, ',') AS missing FROM be WHERE k = 1",
    "requirement_assessment": f"WITH {_ASSESSED} SELECT * FROM asd",
    "gap_matrix": f"""
        WITH {_ASSESSED} SELECT requirement, count(*) FILTER (status = 'compliant') AS compliant, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'outdated') AS outdated,
          count(*) FILTER (status = 'missing') AS missing, max(severity) AS worst, max(days_overdue) AS longest FROM asd GROUP BY 1""",
    "gap_actions": f"""
        WITH {_ASSESSED} SELECT tag, requirement, CASE WHEN status = 'missing' THEN 'Obtain evidence' WHEN status = 'outdated' THEN 'Renew evidence' WHEN length(missing) > 0 THEN 'Complete: ' || missing ELSE 'Date the evidence' END AS action, severity
        FROM asd WHERE status <> 'compliant'""",
    "document_revisions": f"SELECT doc_id, {_REV} AS revision FROM documents WHERE regexp_matches(lower(text), '\\brev(ision)?\\.?[{_WS}]*[0-9]+')",
    "types_required": f"WITH {_REQ} SELECT DISTINCT equipment_type, requirement FROM dq",
    "obligations": f"WITH {_OBL} SELECT doc_id, CAST(position AS INTEGER) AS position, obligation FROM ob",
    "distinct_obligations": f"""
        WITH {_OBL}, s AS (SELECT doc_id, trim(regexp_replace(lower(obligation), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CAST(min(position) AS INTEGER) AS position FROM ob GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS k FROM s) SELECT doc_id, slug, position FROM k WHERE k <= 80""",
    "title_kinds": """
        WITH n AS (SELECT DISTINCT replace(document_type, '_', ' ') AS name FROM documents WHERE document_type IS NOT NULL UNION SELECT DISTINCT equipment_type FROM equipment WHERE equipment_type IS NOT NULL),
        s AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM n), d AS (SELECT doc_id, '_' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') || '_' AS t FROM documents WHERE title IS NOT NULL),
        k AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(slug) DESC, name) AS k FROM d JOIN s ON contains(t, '_' || slug || '_')) SELECT doc_id, name FROM k WHERE k = 1""",
}
