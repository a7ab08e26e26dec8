"""Queries on signals, rules and alerts of machines, and on the people who know them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.clock import machine
from millrace.operators import signals as ops
from millrace.operators import trend
from millrace.operators.evidence import capped
from millrace.plans import machines as m
from millrace.plans.vocabulary import ANOMALY_SQL, BYPASS_SQL
from millrace.session import table

HORIZON = 720
#: Days after a person's first job at which they are taken to leave: the tables hold no date of leaving.
TENURE = 100
RULES = [
    {"name": "precursor_recurs", "severity": "critical", "weight": 0.95, "kinds": ["precursor_match"], "where": "precursor_match >= 0.72"},
    {"name": "limit_without_order", "severity": "high", "weight": 0.9, "kinds": ["threshold_approach", "missing_workorder"], "where": "ratio >= 0.85"},
    {"name": "bypass_and_anomaly", "severity": "critical", "weight": 1.0, "kinds": ["alarm_bypass", "maintenance_anomaly"], "where": "true"},
    {"name": "fleet_spread", "severity": "warning", "weight": 0.8, "kinds": ["fleet_pattern"], "where": "affected >= 2"},
    {"name": "knowledge_leaves", "severity": "high", "weight": 0.85, "kinds": ["expertise_loss", "documentation_void"], "where": f"days_left <= {HORIZON}"},
    {"name": "exposed_without_evidence", "severity": "high", "weight": 0.9, "kinds": ["regulatory_exposure", "evidence_void"], "where": "true", "shared": ["regulatory_exposure", "evidence_void"]},
]
TEMPLATES = {
    "precursor_recurs": "{tag}: findings repeat what was seen before a failure ({strongest}).",
    "limit_without_order": "{tag}: a reading nears its limit and no order is open; {signals} signals.",
    "bypass_and_anomaly": "{tag}: alarms bypassed while findings are abnormal; risk {risk}.",
    "fleet_spread": "{tag}: a failure mode of its kind spreads.",
    "knowledge_leaves": "{tag}: experience leaves and no paper holds it; {signals} signals.",
    "exposed_without_evidence": "{tag}: a requirement falls due without evidence; headline {headline}.",
}
#: Actions by rule: text, urgency, owner, days.
ACTIONS = [
    ("precursor_recurs", "Inspect {tag} for the earlier failure", "immediate", "reliability", 1), ("limit_without_order", "Raise an order for {tag}", "high", "planning", 3),
    ("bypass_and_anomaly", "Restore the alarms of {tag}", "immediate", "operations", 1), ("fleet_spread", "Compare {tag} with its kind", "normal", "reliability", 30),
    ("knowledge_leaves", "Write down what is known of {tag}", "normal", "training", 60), ("exposed_without_evidence", "File the evidence for {tag}", "high", "compliance", 14),
]


def _at():
    return F.lit(m.AS_OF).cast("date")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.records_of(table(spark, sf_dir, "maintenance"))


def peer_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other machines of its type each machine has: a grouped count, not a join of peers."""
    e = table(spark, sf_dir, "equipment").select("tag", F.lower("equipment_type").alias("kind"))
    n = e.where("kind IS NOT NULL").groupBy("kind").agg(F.count_distinct("tag").alias("n"))
    return e.join(n, "kind").select("tag", "kind", (F.col("n") - 1).alias("peers"))


def newest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.newest_findings(_records(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


def _maintenance_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four patterns: repeated findings, shorter intervals, recommendations left open, terms in the newest record."""
    repeat = ops.signal(m.repeat_finding(spark, sf_dir), "maintenance_anomaly", F.col("strength"))
    closer = ops.signal(m.interval_compression(spark, sf_dir), "maintenance_anomaly", 1 - F.col("late") / F.col("early"))
    open_ = ops.signal(m.unactioned(spark, sf_dir), "maintenance_anomaly", F.col("strength"), F.col("record_id"))
    newest = ops.signal(ops.newest_findings(_records(spark, sf_dir)), "maintenance_anomaly", F.col("strength"), F.col("record_id"))
    return repeat.unionByName(closer).unionByName(open_).unionByName(newest)


def _threshold_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.signal(m.threshold_approach(spark, sf_dir), "threshold_approach", F.col("strength"), F.col("parameter"))


def _missing_workorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.signal(ops.orders_missing(table(spark, sf_dir, "equipment"), _records(spark, sf_dir), _at()), "missing_workorder", F.col("strength"))


def _alarm_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.signal(ops.bypass_documents(table(spark, sf_dir, "documents"), _at()), "alarm_bypass", F.col("strength"), F.col("doc_id"))


def precursor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.precursors(_records(spark, sf_dir), table(spark, sf_dir, "failure"))


def precursor_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best finding of each failure, of these the four surest per machine: a report's limit."""
    best = precursor_matches(spark, sf_dir).groupBy("tag", "event_id").agg(F.max_by(F.struct("record_id", "similarity"), F.struct("similarity", "record_id")).alias("b"))
    return capped(best.select("tag", "event_id", "b.*"), "tag", [F.desc("similarity"), F.asc("event_id")], 4)


def _precursor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.signal(precursor_matches(spark, sf_dir), "precursor_match", F.col("similarity"), F.col("record_id"))


def _fleet_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = m.fleet_pattern(spark, sf_dir).groupBy("equipment_type").agg(F.max("machines").alias("machines"))
    return ops.signal(table(spark, sf_dir, "equipment").select("tag", "equipment_type").join(fleet, "equipment_type"), "fleet_pattern", 0.5 + 0.15 * (F.col("machines") - 2))


def _holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ops.experts(_records(spark, sf_dir))
    first = held.groupBy("person").agg(F.date_add(F.min("first"), TENURE).alias("leaves_on"))
    soon = ops.leaving(first, _at(), HORIZON).select("person", "days_left")
    return held.join(soon, "person", "left")


def people_leaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who leave within 60 days of the reference date."""
    held = ops.experts(_records(spark, sf_dir))
    people = held.groupBy("person").agg(F.date_add(F.min("first"), TENURE).alias("leaves_on"), F.count_distinct("tag").alias("machines"))
    return ops.leaving(people, _at(), 60)


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("document_type").isin("sop", "oem_manual"))
    return d.select(machine(F.col("equipment_tag")).alias("tag"), "doc_id").where("tag IS NOT NULL")


def _expertise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _holders(spark, sf_dir).where("days_left IS NOT NULL")
    loss = ops.signal(ops.expertise_losses(gone, HORIZON), "expertise_loss", F.col("strength"))
    void = gone.select("tag").distinct().join(_knowledge(spark, sf_dir), "tag", "left_anti")
    return loss.unionByName(ops.signal(void, "documentation_void", F.lit(1.0)))


def knowledge_cliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.knowledge_cliff(table(spark, sf_dir, "equipment"), _holders(spark, sf_dir), _knowledge(spark, sf_dir), HORIZON)


def interview_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask of those who leave: one question per machine and gap of knowledge, eight a machine."""
    gone = _holders(spark, sf_dir).where("days_left IS NOT NULL").select("tag").distinct()
    r = _records(spark, sf_dir).where("tag IS NOT NULL")
    types = r.where("record_type IS NOT NULL").select("tag", F.concat(F.lit("How do you go about "), F.regexp_replace("record_type", "_", " "), F.lit(" on "), F.col("tag"), F.lit("?")).alias("question"))
    modes = table(spark, sf_dir, "failure").where("failure_mode IS NOT NULL").select(machine(F.col("equipment_tag")).alias("tag"), F.lower(F.trim(F.regexp_replace("failure_mode", "[_ -]+", " "))).alias("mode"))
    modes = modes.where("tag IS NOT NULL").select("tag", F.concat(F.lit("What announces "), F.col("mode"), F.lit(" on "), F.col("tag"), F.lit("?")).alias("question"))
    asked = types.unionByName(modes).distinct().join(gone, "tag", "left_semi")
    return capped(asked, "tag", [F.asc("question")], 8)


def _regulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = m.gap_assessment(spark, sf_dir).withColumn("days_left", -F.col("days_overdue"))
    return ops.exposures(gaps)


#: A new kind of signal is a new entry: (spark, sf_dir) -> signals.
DETECTORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "maintenance_anomaly": _maintenance_anomaly, "threshold_approach": _threshold_approach, "missing_workorder": _missing_workorder, "alarm_bypass": _alarm_bypass, "precursor_match": _precursor_match,
    "fleet_pattern": _fleet_pattern, "expertise_loss": _expertise_loss, "regulatory_exposure": _regulatory,
}


def all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [detect(spark, sf_dir) for detect in DETECTORS.values()])


def signal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "parse_outcome").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("source")).agg(F.avg("ocr_confidence").alias("confidence")).where("confidence IS NOT NULL")
    return ops.with_confidence(all_signals(spark, sf_dir), p)


def compound_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines for which a rule fires, with severity, headline, confidence and risk."""
    ratio = m.threshold_approach(spark, sf_dir).groupBy("tag").agg(F.max("ratio").alias("ratio"))
    affected = table(spark, sf_dir, "equipment").select("tag", "equipment_type").join(m.fleet_pattern(spark, sf_dir).groupBy("equipment_type").agg(F.max("machines").alias("affected")), "equipment_type").select("tag", "affected")
    days = _holders(spark, sf_dir).groupBy("tag").agg(F.min("days_left").alias("days_left"))
    facts = table(spark, sf_dir, "equipment").select("tag").join(ratio, "tag", "left").join(affected, "tag", "left").join(days, "tag", "left")
    return ops.compounds(signal_confidence(spark, sf_dir), RULES, table(spark, sf_dir, "equipment"), facts)


def alert_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with their key, explanation and place within their severity."""
    return ops.ordered_alerts(ops.explained(compound_alerts(spark, sf_dir), TEMPLATES)).select("key", "severity_rank", "place", "explanation")


def alert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = spark.createDataFrame(ACTIONS, "rule string, text string, urgency string, owner string, days int")
    a = compound_alerts(spark, sf_dir).select("tag", "rule").join(F.broadcast(todo), "rule")
    return a.select("tag", "rule", F.replace("text", F.lit("{tag}"), F.col("tag")).alias("action"), "urgency", "owner", F.date_add(_at(), F.col("days")).alias("due"))


def compound_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine with the highest risk of its active alerts; 0 and .35 without one."""
    top = compound_alerts(spark, sf_dir).groupBy("tag").agg(F.max_by(F.struct("risk", "confidence", "rule"), F.struct("risk", "confidence", "rule")).alias("b"))
    e = table(spark, sf_dir, "equipment").select("tag").join(top, "tag", "left")
    return e.select("tag", "b.rule", F.coalesce("b.risk", F.lit(0.0)).alias("probability"), F.coalesce("b.confidence", F.lit(0.35)).alias("confidence"))


_D = "DATE '2024-06-30'"
_HELD = f"""held AS (SELECT person, tag, count(*) AS jobs, min(performed_on) AS first, max(performed_on) AS last FROM (
      SELECT upper(trim(regexp_replace(performed_by, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS person, tag, performed_on FROM m WHERE tag IS NOT NULL AND performed_on IS NOT NULL) WHERE person <> '' GROUP BY 1, 2),
    lv AS (SELECT person, min(first) + {TENURE} AS leaves_on, count(DISTINCT tag) AS machines FROM held GROUP BY 1),
    soon AS (SELECT person, CAST(date_diff('day', {_D}, leaves_on) AS INTEGER) AS days_left FROM lv WHERE date_diff('day', {_D}, leaves_on) BETWEEN 0 AND {HORIZON}),
    ho AS (SELECT held.*, days_left FROM held LEFT JOIN soon USING (person)),
    kn AS (SELECT upper(trim(equipment_tag)) AS tag, doc_id FROM documents WHERE document_type IN ('sop', 'oem_manual') AND trim(equipment_tag) <> '')"""
_NEW = f"""nw AS (SELECT tag, arg_max({{'record_id': record_id, 'findings': findings}}, (performed_on, record_id)) AS r FROM m WHERE tag IS NOT NULL AND performed_on IS NOT NULL GROUP BY 1),
    nf AS (SELECT tag, r.record_id AS record_id, round(0.45::DOUBLE * max(weight), 6) AS strength FROM nw, {ANOMALY_SQL} WHERE regexp_matches(lower(r.findings), pattern) GROUP BY 1, 2)"""
_PRE = """pw AS (SELECT DISTINCT tag, record_id, unnest(regexp_split_to_array(lower(findings), '[^a-z0-9]+')) AS word FROM m WHERE tag IS NOT NULL AND findings IS NOT NULL),
    pe AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, event_id, list_distinct(list_filter(regexp_split_to_array(lower(precursor_text), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS own FROM failure WHERE precursor_text IS NOT NULL),
    pm AS (SELECT tag, record_id, event_id, round(count(*) / len(any_value(own))::DOUBLE, 6) AS similarity FROM (SELECT tag, event_id, own, unnest(own) AS word FROM pe WHERE tag IS NOT NULL) JOIN pw USING (tag, word) GROUP BY 1, 2, 3
           HAVING round(count(*) / len(any_value(own))::DOUBLE, 6) >= 0.5)"""
_IC = "ic AS (" + m.SQL["interval_compression"].replace(f"WITH {m._M}, v AS", "WITH v AS").strip() + ")"
_ALL = f"""{m._T}, {m._M}, {m._RF}, {m._TH}, {m._FL}, {m._GAP}, {_HELD}, {_NEW}, {_PRE}, {_IC},
    own AS (SELECT tag, max(performed_on) AS last, count(*) FILTER (status IN ('open', 'deferred')) AS pending FROM m WHERE tag IS NOT NULL GROUP BY 1),
    by_doc AS (SELECT doc_id, sum(len(regexp_extract_all(lower(text), pattern))) AS n, max(weight) FILTER (regexp_matches(lower(text), pattern)) AS peak FROM documents, {BYPASS_SQL} WHERE text IS NOT NULL GROUP BY 1),
    aff AS (SELECT equipment_type, max(machines) AS affected FROM fl GROUP BY 1),
    raw_sig AS (
      SELECT tag, 'maintenance_anomaly' AS kind, strength, NULL::VARCHAR AS source, NULL::VARCHAR AS gap FROM rf
      UNION ALL SELECT tag, 'maintenance_anomaly', 1 - late / early, NULL, NULL FROM ic
      UNION ALL SELECT tag, 'maintenance_anomaly', 0.65::DOUBLE, record_id, NULL FROM m WHERE tag IS NOT NULL AND length(trim(recommendations)) > 0 AND coalesce(status, '') <> 'closed'
      UNION ALL SELECT tag, 'maintenance_anomaly', strength, record_id, NULL FROM nf
      UNION ALL SELECT tag, 'threshold_approach', strength, parameter, NULL FROM th
      UNION ALL SELECT tag, 'missing_workorder', CASE WHEN last IS NULL THEN 0.9::DOUBLE WHEN date_diff('day', last, {_D}) > 30 THEN 0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, (date_diff('day', last, {_D}) - 30) / 90.0::DOUBLE) END, NULL, NULL
        FROM equipment LEFT JOIN own USING (tag) WHERE coalesce(pending, 0) = 0
      UNION ALL SELECT upper(trim(equipment_tag)), 'alarm_bypass', least(1.0::DOUBLE, (0.5::DOUBLE + 0.25::DOUBLE * (n - 1)) * peak) * (0.6::DOUBLE + 0.4::DOUBLE * pow(2.0::DOUBLE, -date_diff('day', document_date, {_D}) / 45.0::DOUBLE)), CAST(doc_id AS VARCHAR), NULL
        FROM documents JOIN by_doc USING (doc_id) WHERE n > 0 AND document_type IN ('shift_log', 'incident_report') AND date_diff('day', document_date, {_D}) BETWEEN 0 AND 30 AND trim(equipment_tag) <> ''
      UNION ALL SELECT tag, 'precursor_match', similarity, record_id, NULL FROM pm
      UNION ALL SELECT tag, 'fleet_pattern', 0.5::DOUBLE + 0.15::DOUBLE * (affected - 2), NULL, NULL FROM equipment JOIN aff USING (equipment_type)
      UNION ALL SELECT tag, 'expertise_loss', 0.35::DOUBLE + 0.65::DOUBLE * (1 - days_left / {HORIZON}.0::DOUBLE), NULL, NULL FROM ho WHERE days_left IS NOT NULL
      UNION ALL SELECT DISTINCT tag, 'documentation_void', 1.0::DOUBLE, NULL, NULL FROM ho WHERE days_left IS NOT NULL AND tag NOT IN (SELECT tag FROM kn)
      UNION ALL SELECT tag, 'regulatory_exposure', CASE WHEN days_overdue > 0 THEN 1.0::DOUBLE WHEN status = 'missing' THEN 0.5::DOUBLE END, NULL, requirement || ':' || tag FROM gap
      UNION ALL SELECT tag, 'evidence_void', CASE WHEN status = 'missing' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END, NULL, requirement || ':' || tag FROM gap WHERE status IN ('missing', 'incomplete')),
    allsig AS (SELECT tag, kind, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, strength)), 6) AS strength, source, gap FROM raw_sig WHERE strength IS NOT NULL),
    ocr AS (SELECT CAST(doc_id AS VARCHAR) AS source, avg(ocr_confidence) AS c FROM parse_outcome WHERE doc_id IS NOT NULL GROUP BY 1),
    sc AS (SELECT allsig.*, round(CASE WHEN kind IN ('threshold_approach', 'missing_workorder', 'regulatory_exposure', 'evidence_void', 'documentation_void') THEN 0.95::DOUBLE WHEN kind = 'precursor_match' THEN 0.72::DOUBLE ELSE 0.78::DOUBLE END
        * CASE WHEN allsig.source IS NULL THEN 0.85::DOUBLE ELSE coalesce(c, 1.0::DOUBLE) END, 6) AS confidence FROM allsig LEFT JOIN ocr ON ocr.source = allsig.source)"""
_FIRED = f"""{_ALL},
    has AS (SELECT tag, kind, max(strength) AS s FROM sc GROUP BY 1, 2),
    h AS (SELECT tag, max(s) FILTER (kind = 'precursor_match') AS pre, max(s) FILTER (kind = 'threshold_approach') AS thr, max(s) FILTER (kind = 'missing_workorder') AS wo, max(s) FILTER (kind = 'alarm_bypass') AS byp,
          max(s) FILTER (kind = 'maintenance_anomaly') AS ano, max(s) FILTER (kind = 'fleet_pattern') AS fle, max(s) FILTER (kind = 'expertise_loss') AS exl, max(s) FILTER (kind = 'documentation_void') AS voi FROM has GROUP BY 1),
    same_gap AS (SELECT DISTINCT a.tag FROM sc a JOIN sc b ON a.gap = b.gap AND a.kind = 'regulatory_exposure' AND b.kind = 'evidence_void'),
    fired AS (
      SELECT tag, 'precursor_recurs' AS rule, 'critical' AS severity, 0.95::DOUBLE AS weight, ['precursor_match'] AS kinds FROM h WHERE pre >= 0.72
      UNION ALL SELECT tag, 'limit_without_order', 'high', 0.9::DOUBLE, ['threshold_approach', 'missing_workorder'] FROM h WHERE thr IS NOT NULL AND wo IS NOT NULL AND (SELECT max(ratio) FROM th WHERE th.tag = h.tag) >= 0.85
      UNION ALL SELECT tag, 'bypass_and_anomaly', 'critical', 1.0::DOUBLE, ['alarm_bypass', 'maintenance_anomaly'] FROM h WHERE byp IS NOT NULL AND ano IS NOT NULL
      UNION ALL SELECT h.tag, 'fleet_spread', 'warning', 0.8::DOUBLE, ['fleet_pattern'] FROM h JOIN equipment e ON e.tag = h.tag JOIN aff USING (equipment_type) WHERE fle IS NOT NULL AND affected >= 2
      UNION ALL SELECT tag, 'knowledge_leaves', 'high', 0.85::DOUBLE, ['expertise_loss', 'documentation_void'] FROM h WHERE exl IS NOT NULL AND voi IS NOT NULL
      UNION ALL SELECT tag, 'exposed_without_evidence', 'high', 0.9::DOUBLE, ['regulatory_exposure', 'evidence_void'] FROM same_gap),
    comp AS (SELECT tag, rule, severity, weight, count(*) AS signals, max(strength) AS strongest, round(1 - product(1 - strength), 6) AS conjunction, round(0.7::DOUBLE * min(confidence) + 0.3::DOUBLE * avg(confidence), 4) AS confidence,
        arg_min(kind, (list_position(['alarm_bypass', 'precursor_match', 'threshold_approach', 'maintenance_anomaly', 'missing_workorder', 'regulatory_exposure', 'evidence_void', 'fleet_pattern', 'expertise_loss', 'documentation_void'], kind), kind)) AS headline
      FROM sc JOIN fired USING (tag) WHERE list_contains(kinds, kind) GROUP BY ALL),
    al AS (SELECT comp.tag, rule, severity, headline, signals, strongest, conjunction, confidence, round(greatest(CASE severity WHEN 'critical' THEN 0.6 WHEN 'high' THEN 0.45 ELSE 0.3 END::DOUBLE,
        least(1.0::DOUBLE, weight * conjunction * CASE criticality WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.88 ELSE 0.76 END::DOUBLE)), 6) AS risk FROM comp JOIN equipment e ON e.tag = comp.tag)"""

QUERIES = {
    f.__name__: f
    for f in (peer_machines, newest_findings, precursor_matches, precursor_best, people_leaving, knowledge_cliff, interview_questions, all_signals, signal_confidence, compound_alerts, alert_list, alert_actions, compound_prediction)
}
SQL = {
    "peer_machines": "SELECT tag, lower(equipment_type) AS kind, count(*) OVER (PARTITION BY lower(equipment_type)) - 1 AS peers FROM equipment WHERE equipment_type IS NOT NULL",
    "newest_findings": f"WITH {m._M}, {_NEW} SELECT * FROM nf",
    "precursor_matches": f"WITH {m._M}, {_PRE} SELECT * FROM pm",
    "precursor_best": f"""
        WITH {m._M}, {_PRE}, b AS (SELECT *, row_number() OVER (PARTITION BY tag, event_id ORDER BY similarity DESC, record_id DESC) AS k FROM pm),
        f AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY similarity DESC, event_id) AS p FROM b WHERE k = 1) SELECT tag, event_id, record_id, similarity FROM f WHERE p <= 4""",
    "people_leaving": f"WITH {m._M}, {_HELD} SELECT lv.person, leaves_on, machines, days_left FROM lv JOIN soon USING (person) WHERE days_left <= 60",
    "knowledge_cliff": f"""
        WITH {m._M}, {_HELD}, s AS (SELECT *, jobs / sum(jobs) OVER (PARTITION BY tag)::DOUBLE AS share FROM ho),
        o AS (SELECT tag, sum(share * share) AS hhi, count(days_left) AS leavers, coalesce(sum(share) FILTER (days_left IS NOT NULL), 0) AS departing, max(1 - days_left / {HORIZON}.0::DOUBLE) AS proximity FROM s GROUP BY 1),
        p AS (SELECT tag, count(DISTINCT doc_id) AS papers FROM kn GROUP BY 1), a AS (SELECT e.tag, criticality, o.*, coalesce(papers, 0) AS papers FROM equipment e JOIN o ON o.tag = e.tag LEFT JOIN p ON p.tag = e.tag)
        SELECT tag, leavers, papers, round(hhi, 6) AS hhi, round(greatest(CASE WHEN criticality = 'A' AND leavers > 0 AND papers = 0 THEN 75.0::DOUBLE ELSE 0.0::DOUBLE END,
          CASE WHEN leavers > 0 THEN 35 * (1 - pow(0.5::DOUBLE, leavers)) * (0.35::DOUBLE + 0.65::DOUBLE * proximity) ELSE 0.0::DOUBLE END + 30 * (1 - least(papers, 3) / 3.0::DOUBLE)
          + 20 * CASE criticality WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 ELSE 0.3 END::DOUBLE + 15 * (0.5::DOUBLE * hhi + 0.5::DOUBLE * departing)), 4) AS score FROM a""",
    "interview_questions": f"""
        WITH {m._M}, {_HELD}, q AS (SELECT DISTINCT tag, 'How do you go about ' || replace(record_type, '_', ' ') || ' on ' || tag || '?' AS question FROM m WHERE tag IS NOT NULL AND record_type IS NOT NULL
          UNION SELECT nullif(upper(trim(equipment_tag)), ''), 'What announces ' || lower(trim(regexp_replace(failure_mode, '[_ -]+', ' ', 'g'))) || ' on ' || upper(trim(equipment_tag)) || '?' FROM failure WHERE failure_mode IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY question) AS k FROM q WHERE tag IN (SELECT tag FROM ho WHERE days_left IS NOT NULL)) SELECT tag, question FROM k WHERE k <= 8""",
    "all_signals": f"WITH {_ALL} SELECT * FROM allsig",
    "signal_confidence": f"WITH {_ALL} SELECT tag, kind, strength, source, gap, confidence FROM sc",
    "compound_alerts": f"WITH {_FIRED} SELECT * FROM al",
    "alert_list": f"""
        WITH {_FIRED} SELECT tag || ':' || rule || ':' || severity AS key, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END AS severity_rank,
          CAST(row_number() OVER (PARTITION BY severity ORDER BY risk DESC, tag || ':' || rule || ':' || severity) AS INTEGER) AS place,
          CASE rule WHEN 'precursor_recurs' THEN tag || ': findings repeat what was seen before a failure (' || strongest || ').' WHEN 'limit_without_order' THEN tag || ': a reading nears its limit and no order is open; ' || signals || ' signals.'
            WHEN 'bypass_and_anomaly' THEN tag || ': alarms bypassed while findings are abnormal; risk ' || risk || '.' WHEN 'fleet_spread' THEN tag || ': a failure mode of its kind spreads.'
            WHEN 'knowledge_leaves' THEN tag || ': experience leaves and no paper holds it; ' || signals || ' signals.' ELSE tag || ': a requirement falls due without evidence; headline ' || headline || '.' END AS explanation FROM al""",
    "alert_actions": f"""
        WITH {_FIRED}, todo AS (SELECT * FROM (VALUES ('precursor_recurs', 'Inspect {{tag}} for the earlier failure', 'immediate', 'reliability', 1), ('limit_without_order', 'Raise an order for {{tag}}', 'high', 'planning', 3),
          ('bypass_and_anomaly', 'Restore the alarms of {{tag}}', 'immediate', 'operations', 1), ('fleet_spread', 'Compare {{tag}} with its kind', 'normal', 'reliability', 30), ('knowledge_leaves', 'Write down what is known of {{tag}}', 'normal', 'training', 60),
          ('exposed_without_evidence', 'File the evidence for {{tag}}', 'high', 'compliance', 14)) v(rule, text, urgency, owner, days))
        SELECT tag, rule, replace(text, '{{tag}}', tag) AS action, urgency, owner, {_D} + days AS due FROM al JOIN todo USING (rule)""",
    "compound_prediction": f"""
        WITH {_FIRED}, k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY risk DESC, confidence DESC, rule DESC) AS k FROM al)
        SELECT e.tag, k.rule, coalesce(risk, 0) AS probability, coalesce(confidence, 0.35::DOUBLE) AS confidence FROM equipment e LEFT JOIN k ON k.tag = e.tag AND k.k = 1""",
}
