"""Queries on readings, records and failures of machines, signals and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.clock import machine
from millrace.operators import evidence, trend
from millrace.plans.vocabulary import ANOMALY_SQL, USUAL_SQL
from millrace.session import table

AS_OF = "2024-06-30"
RULES = [
    ("repeat_and_limit", ["repeat_finding", "threshold_approach"], "repeat_finding >= 0.5 AND threshold_approach >= 0.45"),
    ("fleet_and_repeat", ["fleet_pattern", "repeat_finding"], "fleet_pattern >= 0.5"),
    ("strong_repeat", ["repeat_finding"], "repeat_finding >= 0.8"),
]


def reading_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.trends(trend.latest_deliveries(table(spark, sf_dir, "reading")))


def threshold_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.threshold_approach(reading_trends(spark, sf_dir), table(spark, sf_dir, "equipment"))


def latest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trend.latest_deliveries(table(spark, sf_dir, "reading"))
    return rows.groupBy("tag", "parameter").agg(F.max_by("reading_id", F.struct("measured_at", "reading_id")).alias("reading_id"), F.max("measured_at").alias("measured_at"))


def repeat_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.repeat_findings(trend.records_of(table(spark, sf_dir, "maintenance")), F.lit(AS_OF).cast("date"))


def interval_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.interval_compression(trend.records_of(table(spark, sf_dir, "maintenance")))


def unactioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a recommendation that are not closed; strength .65."""
    r = trend.records_of(table(spark, sf_dir, "maintenance"))
    return r.where("tag IS NOT NULL AND length(trim(recommendations)) > 0 AND coalesce(status, '') <> 'closed'").select("record_id", "tag", F.lit(0.65).alias("strength"))


def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines of the registry without any maintenance record."""
    r = trend.records_of(table(spark, sf_dir, "maintenance")).where("tag IS NOT NULL")
    return table(spark, sf_dir, "equipment").select("tag", "criticality").join(r.select("tag"), "tag", "left_anti")


def fleet_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.fleet_incidence(table(spark, sf_dir, "failure"), table(spark, sf_dir, "equipment"), F.lit(AS_OF).cast("date"))


def preceding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.preceding(table(spark, sf_dir, "failure"), table(spark, sf_dir, "maintenance"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeat = repeat_finding(spark, sf_dir).select("tag", F.lit("repeat_finding").alias("kind"), "strength")
    near = threshold_approach(spark, sf_dir).select("tag", F.lit("threshold_approach").alias("kind"), "strength")
    fleet = fleet_pattern(spark, sf_dir).select("equipment_type", F.least(F.lit(1.0), 0.5 + 0.15 * (F.col("machines") - 2)).alias("strength"))
    fleet = fleet.groupBy("equipment_type").agg(F.round(F.max("strength"), 6).alias("strength"))
    fleet = table(spark, sf_dir, "equipment").select("tag", "equipment_type").join(fleet, "equipment_type").select("tag", F.lit("fleet_pattern").alias("kind"), "strength")
    return repeat.unionByName(near).unionByName(fleet)


def noisy_or_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.combined_risk(_signals(spark, sf_dir), table(spark, sf_dir, "equipment"))


def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.fired(_signals(spark, sf_dir), RULES)


def headline_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest signal of each machine, ties by kind."""
    best = F.min(F.struct((-F.col("strength")).alias("s"), "kind"))
    return _signals(spark, sf_dir).groupBy("tag").agg(best.alias("b")).select("tag", "b.kind", (-F.col("b.s")).alias("strength"))


def conflict_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one machine, parameter and day whose documents disagree by over a tenth."""
    r = table(spark, sf_dir, "reading").where("source IS NOT NULL AND value > 0")
    rows = r.select(machine(F.col("equipment_tag")).alias("tag"), "parameter", F.to_date("measured_at").alias("day"), "value", F.col("source.doc_id").alias("document")).dropna()
    return evidence.conflicts(rows, ["tag", "parameter", "day"])


def citations_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five documents per machine, newest first: the cap is the report's feature."""
    d = table(spark, sf_dir, "documents").where("equipment_tag IS NOT NULL AND document_date IS NOT NULL").select(machine(F.col("equipment_tag")).alias("tag"), "doc_id", "document_date")
    return evidence.capped(d, "tag", [F.desc("document_date"), F.asc("doc_id")], 5)


def knowledge_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds the experience of a machine: shares of the people who worked on it."""
    r = trend.records_of(table(spark, sf_dir, "maintenance")).where("tag IS NOT NULL AND performed_by IS NOT NULL")
    return evidence.concentration(r.groupBy("tag", "performed_by").agg(F.count("*").alias("jobs")), "tag", "jobs")


def gap_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each machine of a type needs within an interval, against those there are."""
    e = table(spark, sf_dir, "equipment").select("tag", "equipment_type")
    d = table(spark, sf_dir, "documents").select(machine(F.col("equipment_tag")).alias("tag"), F.col("document_type").alias("evidence_type"), F.col("document_date").alias("dated")).where("tag IS NOT NULL")
    rows = [("R1", "pump", "inspection_report", 45), ("R2", "vessel", "inspection_report", 60), ("R3", "valve", "work_order", 30), ("R4", "tank", "sop", 90)]
    need = spark.createDataFrame(rows, "requirement string, equipment_type string, evidence_type string, days int")
    return evidence.assessed(e, need, d, F.lit(AS_OF).cast("date"))


def compliance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = F.avg((F.col("status") == "compliant").cast("double"))
    return gap_assessment(spark, sf_dir).groupBy("requirement").agg(F.count("*").alias("machines"), F.round(100 * met, 1).alias("rate"))


def alert_dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return trend.kept_alerts(e).select("key", "id")


def bundle_knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per machine for offline use within 4,000 characters, newest first."""
    d = table(spark, sf_dir, "documents").where("equipment_tag IS NOT NULL AND n_chars > 0 AND document_date IS NOT NULL")
    items = d.select(machine(F.col("equipment_tag")).alias("tag"), F.col("doc_id").alias("id"), F.unix_date("document_date").alias("priority"), F.col("n_chars").alias("size"))
    return evidence.knapsack_in_order(items, "tag", 4000)


def content_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.checksum(table(spark, sf_dir, "equipment"), "equipment_type", ["tag", "name", "criticality"])


def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries by unit and type with unevenly spelled makers merged and limits' maps joined by maximum."""
    e = table(spark, sf_dir, "equipment").where("manufacturer IS NOT NULL")
    return e.groupBy("unit", F.lower(F.trim(F.regexp_replace("manufacturer", r"\s+", " "))).alias("maker")).agg(F.count("*").alias("machines"), F.min("installed_on").alias("first"), F.max("installed_on").alias("last"))


_R = f"""r AS (SELECT DISTINCT ON (reading_id) reading_id, upper(trim(equipment_tag)) AS tag, parameter, {USUAL_SQL} AS value, measured_at FROM reading
    WHERE equipment_tag IS NOT NULL AND trim(equipment_tag) <> '' AND parameter IS NOT NULL AND value IS NOT NULL AND measured_at IS NOT NULL ORDER BY reading_id, received_at DESC NULLS LAST)"""
_T = f"""{_R}, t AS (SELECT tag, parameter, count(*) AS n, round(coalesce(regr_slope(value, epoch_us(measured_at) / 8.64e10::DOUBLE - 19000), 0), 6) AS slope,
    round(arg_max(value, (measured_at, reading_id)), 6) AS latest FROM r GROUP BY 1, 2)"""
_M = """m AS (SELECT DISTINCT ON (record_id) *, nullif(upper(trim(equipment_tag)), '') AS tag FROM maintenance)"""
_REPEAT = f"term, weight FROM m, {ANOMALY_SQL} WHERE regexp_matches(lower(findings), pattern)"
_RF = f"""rf AS (SELECT tag, term, count(*) AS records, round(least(1.0, (0.55::DOUBLE + 0.15::DOUBLE * (count(*) - 2)) * weight), 6) AS strength
    FROM (SELECT tag, record_id, {_REPEAT} AND tag IS NOT NULL AND date_diff('day', performed_on, DATE '2024-06-30') <= 90) GROUP BY tag, term, weight HAVING count(*) >= 2)"""
_TH = """th AS (SELECT e.tag, t.parameter, e.threshold, t.latest, round(t.latest / e.threshold, 6) AS ratio,
    round(0.45::DOUBLE + 0.55::DOUBLE * least(1.0, greatest(0.0, (t.latest / e.threshold - 0.85::DOUBLE) / (1 - 0.85::DOUBLE))), 6) AS strength,
    round(CASE WHEN t.slope > 0 AND t.latest < e.threshold THEN (e.threshold - t.latest) / t.slope END, 3) AS days_to_limit
    FROM (SELECT tag, x.key AS parameter, x.value AS threshold FROM (SELECT tag, unnest(map_entries(oem_thresholds)) AS x FROM equipment)) e
    JOIN t ON t.tag = e.tag AND t.parameter = e.parameter WHERE e.threshold > 0 AND t.latest / e.threshold >= 0.85)"""
_FL = """fl AS (SELECT equipment_type, lower(trim(regexp_replace(failure_mode, '[_ -]+', ' ', 'g'))) AS mode, count(DISTINCT e.tag) AS machines, count(*) AS events,
    round(sum(downtime_hours), 3) AS downtime, max(occurred_on) AS latest FROM failure f JOIN equipment e ON e.tag = upper(trim(f.equipment_tag))
    WHERE date_diff('day', occurred_on, DATE '2024-06-30') <= 720 AND failure_mode IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT e.tag) >= 2)"""
_SIG = f"""{_T}, {_M}, {_RF}, {_TH}, {_FL}, sig AS (
    SELECT tag, 'repeat_finding' AS kind, strength FROM rf UNION ALL SELECT tag, 'threshold_approach', strength FROM th UNION ALL
    SELECT e.tag, 'fleet_pattern', s FROM equipment e JOIN (SELECT equipment_type, round(max(least(1.0::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * (machines - 2))), 6) AS s FROM fl GROUP BY 1) USING (equipment_type))"""
_GAP = """need AS (SELECT * FROM (VALUES ('R1', 'pump', 'inspection_report', 45), ('R2', 'vessel', 'inspection_report', 60), ('R3', 'valve', 'work_order', 30), ('R4', 'tank', 'sop', 90)) v(requirement, equipment_type, evidence_type, days)),
    ev AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, document_type AS evidence_type, max(document_date) AS last, count(*) AS items FROM documents WHERE equipment_tag IS NOT NULL GROUP BY 1, 2),
    gap AS (SELECT e.tag, requirement, CASE WHEN items IS NULL THEN 'missing' WHEN last IS NULL THEN 'incomplete' WHEN date_diff('day', last, DATE '2024-06-30') - days > 0 THEN 'outdated' ELSE 'compliant' END AS status,
        last, CAST(CASE WHEN date_diff('day', last, DATE '2024-06-30') - days > 0 THEN date_diff('day', last, DATE '2024-06-30') - days END AS INTEGER) AS days_overdue
        FROM equipment e JOIN need USING (equipment_type) LEFT JOIN ev ON ev.tag = e.tag AND ev.evidence_type = need.evidence_type)"""

QUERIES = {
    f.__name__: f
    for f in (
        reading_trends, threshold_approach, latest_readings, repeat_finding, interval_compression, unactioned, missing_records, fleet_pattern, preceding_records, noisy_or_risk, rule_engine, headline_signal,
        conflict_detection, citations_capped, knowledge_concentration, gap_assessment, compliance_rate, alert_dedupe_window, bundle_knapsack, content_checksum, registry_merge,
    )
}
SQL = {
    "reading_trends": f"WITH {_T} SELECT * FROM t",
    "threshold_approach": f"WITH {_T}, {_TH} SELECT * FROM th",
    "latest_readings": f"WITH {_R} SELECT tag, parameter, arg_max(reading_id, (measured_at, reading_id)) AS reading_id, max(measured_at) AS measured_at FROM r GROUP BY 1, 2",
    "repeat_finding": f"WITH {_M}, {_RF} SELECT * FROM rf",
    "interval_compression": f"""
        WITH {_M}, v AS (SELECT DISTINCT tag, performed_on FROM m WHERE tag IS NOT NULL AND performed_on IS NOT NULL),
        g AS (SELECT tag, performed_on, date_diff('day', lag(performed_on) OVER (PARTITION BY tag ORDER BY performed_on), performed_on) AS gap FROM v),
        k AS (SELECT tag, gap, row_number() OVER (PARTITION BY tag ORDER BY performed_on) AS k, count(*) OVER (PARTITION BY tag) AS n FROM g WHERE gap IS NOT NULL),
        a AS (SELECT tag, avg(gap) FILTER (k <= n // 2) AS early, avg(gap) FILTER (k > n // 2) AS late FROM k WHERE n >= 3 GROUP BY tag)
        SELECT tag, round(early, 4) AS early, round(late, 4) AS late FROM a WHERE late < 0.6::DOUBLE * early""",
    "unactioned": f"WITH {_M} SELECT record_id, tag, 0.65::DOUBLE AS strength FROM m WHERE tag IS NOT NULL AND length(trim(recommendations)) > 0 AND coalesce(status, '') <> 'closed'",
    "missing_records": f"WITH {_M} SELECT tag, criticality FROM equipment WHERE tag NOT IN (SELECT tag FROM m WHERE tag IS NOT NULL)",
    "fleet_pattern": f"WITH {_FL} SELECT * FROM fl",
    "preceding_records": f"""
        WITH {_M} SELECT event_id, record_id, CAST(date_diff('day', performed_on, occurred_on) AS INTEGER) AS gap_days
        FROM failure f JOIN m ON m.tag = upper(trim(f.equipment_tag)) WHERE date_diff('day', performed_on, occurred_on) BETWEEN 0 AND 30""",
    "noisy_or_risk": f"""
        WITH {_SIG}, g AS (SELECT tag, count(*) AS signals, round(1 - product(1 - strength), 6) AS conjunction, round(0.7::DOUBLE * min(strength) + 0.3::DOUBLE * avg(strength), 4) AS confidence FROM sig GROUP BY tag)
        SELECT g.tag, signals, conjunction, confidence, round(least(1.0, 0.9::DOUBLE * conjunction * CASE criticality WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.88 ELSE 0.76 END::DOUBLE), 6) AS risk FROM g JOIN equipment e ON e.tag = g.tag""",
    "rule_engine": f"""
        WITH {_SIG}, w AS (SELECT tag, max(strength) FILTER (kind = 'repeat_finding') AS repeat_finding, max(strength) FILTER (kind = 'threshold_approach') AS threshold_approach, max(strength) FILTER (kind = 'fleet_pattern') AS fleet_pattern FROM sig GROUP BY tag)
        SELECT tag, 'repeat_and_limit' AS rule FROM w WHERE repeat_finding >= 0.5 AND threshold_approach >= 0.45
        UNION ALL SELECT tag, 'fleet_and_repeat' FROM w WHERE fleet_pattern >= 0.5 AND repeat_finding IS NOT NULL
        UNION ALL SELECT tag, 'strong_repeat' FROM w WHERE repeat_finding >= 0.8""",
    "headline_signal": f"WITH {_SIG}, k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY strength DESC, kind) AS k FROM sig) SELECT tag, kind, strength FROM k WHERE k = 1",
    "conflict_detection": """
        WITH v AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, parameter, CAST(measured_at AS DATE) AS day, value, source.doc_id AS document FROM reading WHERE source IS NOT NULL AND value > 0),
        g AS (SELECT tag, parameter, day, min(value) AS low, max(value) AS high, arg_min(document, (value, document)) AS low_document, arg_max(document, (value, document)) AS high_document
              FROM v WHERE tag IS NOT NULL AND parameter IS NOT NULL AND day IS NOT NULL AND document IS NOT NULL GROUP BY 1, 2, 3)
        SELECT * FROM g WHERE low_document <> high_document AND high - low > 0.1::DOUBLE * abs(high)""",
    "citations_capped": """
        WITH k AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, doc_id, document_date, row_number() OVER (PARTITION BY nullif(upper(trim(equipment_tag)), '') ORDER BY document_date DESC, doc_id) AS k
            FROM documents WHERE equipment_tag IS NOT NULL AND document_date IS NOT NULL)
        SELECT tag, doc_id, document_date FROM k WHERE k <= 5""",
    "knowledge_concentration": f"""
        WITH {_M}, j AS (SELECT tag, performed_by, count(*) AS jobs FROM m WHERE tag IS NOT NULL AND performed_by IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT tag, jobs / sum(jobs) OVER (PARTITION BY tag)::DOUBLE AS p FROM j) SELECT tag, count(*) AS holders, round(sum(p * p), 6) AS hhi FROM s GROUP BY tag""",
    "gap_assessment": f"WITH {_GAP} SELECT * FROM gap",
    "compliance_rate": f"WITH {_GAP} SELECT requirement, count(*) AS machines, round(100 * avg(CASE WHEN status = 'compliant' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 1) AS rate FROM gap GROUP BY 1",
    "alert_dedupe_window": """
        WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, ts, event_id AS id FROM events),
        o AS (SELECT key, ts, id, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS k FROM e),
        kept AS (SELECT key, ts, id, k FROM o WHERE k = 1
          UNION ALL SELECT o.key, o.ts, o.id, o.k FROM kept JOIN o ON o.key = kept.key
            AND o.k = (SELECT min(n.k) FROM o n WHERE n.key = kept.key AND n.k > kept.k AND n.ts >= kept.ts + INTERVAL 1 HOUR))
        SELECT key, id FROM kept""",
    "content_checksum": "SELECT equipment_type, count(*) AS rows, CAST(sum(CAST('0x' || substring(sha256(coalesce(tag, '') || '|' || coalesce(name, '') || '|' || coalesce(criticality, '')), 1, 12) AS BIGINT)) AS BIGINT) AS checksum FROM equipment GROUP BY 1",
    "registry_merge": "SELECT unit, lower(trim(regexp_replace(manufacturer, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS maker, count(*) AS machines, min(installed_on) AS first, max(installed_on) AS last FROM equipment WHERE manufacturer IS NOT NULL GROUP BY 1, 2",
}
