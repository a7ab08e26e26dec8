"""Signals, rules and alerts on small tables: each rule fires in one case and stays silent in another."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import signals as ops
from millrace.plans.signals import RULES, TEMPLATES

SCHEMA = "tag string, kind string, strength double, source string, gap string, confidence double"
#: Per rule: signals that make it fire, facts, and signals and facts one step short of it.
CASES = {
    "precursor_recurs": ([("precursor_match", 0.72, None)], {}, [("precursor_match", 0.71, None)], {}),
    "limit_without_order": ([("threshold_approach", 0.5, None), ("missing_workorder", 0.9, None)], {"ratio": 0.85}, [("threshold_approach", 0.5, None)], {"ratio": 0.85}),
    "bypass_and_anomaly": ([("alarm_bypass", 0.2, None), ("maintenance_anomaly", 0.2, None)], {}, [("alarm_bypass", 0.9, None)], {}),
    "fleet_spread": ([("fleet_pattern", 0.5, None)], {"affected": 2}, [("fleet_pattern", 0.5, None)], {"affected": 1}),
    "knowledge_leaves": ([("expertise_loss", 0.5, None), ("documentation_void", 1.0, None)], {"days_left": 720}, [("expertise_loss", 0.5, None), ("documentation_void", 1.0, None)], {"days_left": 721}),
    "exposed_without_evidence": ([("regulatory_exposure", 1.0, "R1:X"), ("evidence_void", 0.9, "R1:X")], {}, [("regulatory_exposure", 1.0, "R1:X"), ("evidence_void", 0.9, "R2:X")], {}),
}


def fired(spark, signals, facts, criticality="B"):
    rows = spark.createDataFrame([("X", k, s, None, g, 0.8) for k, s, g in signals], SCHEMA)
    fact = spark.createDataFrame([("X", facts.get("ratio"), facts.get("affected"), facts.get("days_left"))], "tag string, ratio double, affected long, days_left int")
    return ops.compounds(rows, RULES, spark.createDataFrame([("X", criticality)], "tag string, criticality string"), fact)


@pytest.mark.parametrize("rule", list(CASES))
def test_each_rule_fires_and_stays_silent(spark, rule):
    yes, facts, no, fewer = CASES[rule]
    assert [r.rule for r in fired(spark, yes, facts).collect()] == [rule]
    assert fired(spark, no, fewer).count() == 0


def test_risk_has_a_floor_and_a_headline(spark):
    (row,) = fired(spark, [("alarm_bypass", 0.1, None), ("maintenance_anomaly", 0.1, None)], {}, "C").collect()
    assert (row.risk, row.headline, row.signals) == (0.6, "alarm_bypass", 2)
    (row,) = fired(spark, [("alarm_bypass", 1.0, None), ("maintenance_anomaly", 0.5, None)], {}, "A").collect()
    assert row.risk == 1.0
    text = ops.explained(fired(spark, [("alarm_bypass", 1.0, None), ("maintenance_anomaly", 0.5, None)], {}, "A"), TEMPLATES).first().explanation
    assert text == "X: alarms bypassed while findings are abnormal; risk 1.0."


def test_order_and_confidence(spark):
    alerts = spark.createDataFrame([("A", "r", "high", 0.5), ("B", "r", "high", 0.9), ("C", "r", "critical", 0.6)], "tag string, rule string, severity string, risk double")
    got = [(r.key, r.severity_rank, r.place) for r in ops.ordered_alerts(alerts).orderBy(F.desc("severity_rank"), "place").collect()]
    assert got == [("C:r:critical", 4, 1), ("B:r:high", 3, 1), ("A:r:high", 3, 2)]
    s = spark.createDataFrame([("A", "precursor_match", 1.0, "d1", None), ("A", "fleet_pattern", 1.0, None, None)], "tag string, kind string, strength double, source string, gap string")
    c = {r.kind: r.confidence for r in ops.with_confidence(s, spark.createDataFrame([("d1", 0.5)], "source string, confidence double")).collect()}
    assert c == {"precursor_match": 0.36, "fleet_pattern": 0.663}


def test_orders_people_and_cliff(spark):
    at = F.lit(dt.date(2024, 6, 30))
    e = spark.createDataFrame([("A", "A"), ("B", "C"), ("C", "B"), ("D", "B")], "tag string, criticality string")
    r = spark.createDataFrame([("A", dt.date(2024, 6, 29), "open"), ("B", dt.date(2024, 3, 17), "closed"), ("C", dt.date(2024, 6, 29), "closed")], "tag string, performed_on date, status string")
    assert {x.tag: round(x.strength, 3) for x in ops.orders_missing(e, r, at).collect()} == {"B": 0.917, "D": 0.9}
    people = spark.createDataFrame([("p", dt.date(2024, 7, 1)), ("q", dt.date(2024, 6, 29)), ("r", dt.date(2025, 7, 1))], "person string, leaves_on date")
    assert [(x.person, x.days_left) for x in ops.leaving(people, at, 60).collect()] == [("p", 1)]
    holders = spark.createDataFrame([("A", "p", 1, 0), ("B", "q", 2, None)], "tag string, person string, jobs int, days_left int")
    score = {x.tag: x.score for x in ops.knowledge_cliff(e, holders, spark.createDataFrame([], "tag string, doc_id long"), 720).collect()}
    assert score == {"A": 82.5, "B": 43.5}
