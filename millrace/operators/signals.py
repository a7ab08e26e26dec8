"""Signals about machines, the rules that combine them, and the alerts that come of it.

A signal is (tag, kind, strength, source, gap): source is the record or document it stems
from, gap the requirement it concerns, both may be null. A detector gives signals; DETECTORS
in the plans lists them, so a new kind of signal is a new entry. Rules are rows of a table;
one aggregation of the signals by machine serves all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.clock import machine
from millrace.functions.confidence import clamp, noisy_or
from millrace.functions.text import ANOMALY_TERMS, BYPASS_TERMS
from millrace.operators.documents import term_counts
from millrace.operators.evidence import CRITICALITY, by_key
from millrace.session import checkpointed

#: Severities from the lowest, each with the least risk of an alert of it; fixed values.
SEVERITIES = ("info", "low", "warning", "high", "critical")
FLOORS = {"critical": 0.60, "high": 0.45, "warning": 0.30, "low": 0.15, "info": 0.05}
#: What a signal's detector rests on: exact comparison, heuristic or similarity; fixed values.
BASES = {"threshold_approach": 0.95, "missing_workorder": 0.95, "regulatory_exposure": 0.95, "evidence_void": 0.95, "documentation_void": 0.95, "precursor_match": 0.72}
HEURISTIC, WITHOUT_SOURCE = 0.78, 0.85
#: Kinds in the order of what they lead to; the first one present is an alert's headline.
CONSEQUENCE = ("alarm_bypass", "precursor_match", "threshold_approach", "maintenance_anomaly", "missing_workorder", "regulatory_exposure", "evidence_void", "fleet_pattern", "expertise_loss", "documentation_void")


def signal(rows: DataFrame, kind: str, strength: Column, source: Column | None = None, gap: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("tag", F.lit(kind).alias("kind"), F.round(clamp(strength), 6).alias("strength"), (none if source is None else source.cast("string")).alias("source"), (none if gap is None else gap).alias("gap"))


def newest_findings(records: DataFrame) -> DataFrame:
    """(tag, record_id, strength): .45 of the heaviest anomaly term in a machine's newest record."""
    newest = records.where("tag IS NOT NULL AND performed_on IS NOT NULL").groupBy("tag").agg(F.max_by(F.struct("record_id", "findings"), F.struct("performed_on", "record_id")).alias("r"))
    low = F.lower("r.findings")
    heaviest = F.greatest(*[F.when(low.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for _, p, w in ANOMALY_TERMS])
    return newest.select("tag", "r.record_id", (0.45 * heaviest).alias("strength")).where("strength > 0")


def orders_missing(equipment: DataFrame, records: DataFrame, as_of: Column, usual: int = 30, ramp: int = 90) -> DataFrame:
    """(tag, strength) of machines without an open or deferred order: .9 without any record, else by the days past ``usual``."""
    own = records.where("tag IS NOT NULL").groupBy("tag").agg(F.max("performed_on").alias("last"), F.count(F.when(F.col("status").isin("open", "deferred"), 1)).alias("pending"))
    rows = equipment.select("tag").join(own, "tag", "left").where("coalesce(pending, 0) = 0")
    late = F.datediff(as_of, "last") - usual
    return rows.select("tag", F.when(F.col("last").isNull(), 0.9).when(late > 0, 0.5 + 0.5 * clamp(late / ramp)).alias("strength")).where("strength IS NOT NULL")


def bypass_documents(documents: DataFrame, as_of: Column, days: int = 30, half_life: float = 45.0) -> DataFrame:
    """(tag, doc_id, strength) of recent logs and incidents that speak of bypassed alarms."""
    age = F.datediff(as_of, "document_date")
    recent = documents.where(F.col("document_type").isin("shift_log", "incident_report") & age.between(0, days))
    hits = term_counts(recent.select("doc_id", "text"), BYPASS_TERMS).groupBy("doc_id").agg(F.sum("hits").alias("n"), F.max("weight").alias("peak"))
    rows = recent.select("doc_id", machine(F.col("equipment_tag")).alias("tag"), age.alias("age")).where("tag IS NOT NULL").join(hits, "doc_id")
    return rows.select("tag", "doc_id", (clamp((0.5 + 0.25 * (F.col("n") - 1)) * F.col("peak")) * (0.6 + 0.4 * F.pow(F.lit(2.0), -F.col("age") / half_life))).alias("strength"))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def precursors(records: DataFrame, failures: DataFrame, least: float = 0.5) -> DataFrame:
    """(tag, record_id, event_id, similarity): findings that hold most words of what was seen before a failure of the machine.

    Joined on machine and word, so that texts without a common word never meet; the share is of
    the precursor's own words. One row per record and event.
    """
    left = records.where("tag IS NOT NULL AND findings IS NOT NULL").select("tag", "record_id", F.explode(words(F.col("findings"))).alias("word"))
    events = failures.where("precursor_text IS NOT NULL").select(machine(F.col("equipment_tag")).alias("tag"), "event_id", words(F.col("precursor_text")).alias("own")).where("tag IS NOT NULL AND size(own) > 0")
    right = events.select("tag", "event_id", F.size("own").alias("size"), F.explode("own").alias("word"))
    shared = left.join(right, ["tag", "word"]).groupBy("tag", "record_id", "event_id", "size").agg(F.count("*").alias("shared"))
    return shared.select("tag", "record_id", "event_id", F.round(F.col("shared") / F.col("size"), 6).alias("similarity")).where(F.col("similarity") >= least)


def experts(records: DataFrame, least: int = 1) -> DataFrame:
    """(person, tag, jobs, first, last) of those who worked on a machine; names trimmed, upper-cased, single-spaced."""
    name = F.upper(F.trim(F.regexp_replace("performed_by", r"\s+", " ")))
    rows = records.where("tag IS NOT NULL AND performed_on IS NOT NULL").select("tag", name.alias("person"), "performed_on").where("person <> ''")
    return rows.groupBy("person", "tag").agg(F.count("*").alias("jobs"), F.min("performed_on").alias("first"), F.max("performed_on").alias("last")).where(F.col("jobs") >= least)


def leaving(people: DataFrame, as_of: Column, days: int) -> DataFrame:
    """``people`` with days_left, those whose leaves_on lies 0 to ``days`` days ahead."""
    left = F.datediff("leaves_on", as_of)
    return people.withColumn("days_left", left).where(left.between(0, days))


def expertise_losses(holders: DataFrame, days: int) -> DataFrame:
    """(tag, person, strength): .35 to 1 by how soon a holder of a machine's experience leaves. holders: tag, person, days_left."""
    return holders.select("tag", "person", (0.35 + 0.65 * (1 - F.col("days_left") / days)).alias("strength"))


def knowledge_cliff(equipment: DataFrame, holders: DataFrame, knowledge: DataFrame, days: int) -> DataFrame:
    """(tag, score): how much of a machine's experience is about to go, 0 to 100.

    holders: tag, person, jobs, days_left (null if not leaving); knowledge: tag, doc_id of
    procedures and manuals. Fixed weights: 35 for leavers and their nearness, 30 for missing
    papers (none of three), 20 for criticality, 15 for concentration and the leavers' share;
    at least 75 for a critical machine that a leaver knows and no paper describes.
    """
    total = F.sum("jobs").over(Window.partitionBy("tag"))
    share = holders.withColumn("share", F.col("jobs") / total)
    gone = F.col("days_left").isNotNull()
    own = share.groupBy("tag").agg(
        F.sum(F.col("share") * F.col("share")).alias("hhi"), F.count(F.when(gone, 1)).alias("leavers"), F.sum(F.when(gone, F.col("share")).otherwise(0.0)).alias("departing"),
        F.max(F.when(gone, 1 - F.col("days_left") / days)).alias("proximity"),
    )
    papers = knowledge.groupBy("tag").agg(F.count_distinct("doc_id").alias("papers"))
    rows = equipment.select("tag", "criticality").join(own, "tag").join(papers, "tag", "left").na.fill(0, ["papers"])
    crit = by_key({"A": 1.0, "B": 0.6, "C": 0.3}, F.col("criticality"), 0.3)
    loss = F.when(F.col("leavers") > 0, 35 * (1 - F.pow(F.lit(0.5), F.col("leavers"))) * (0.35 + 0.65 * F.col("proximity"))).otherwise(0.0)
    score = loss + 30 * (1 - F.least(F.col("papers"), F.lit(3)) / 3) + 20 * crit + 15 * (0.5 * F.col("hhi") + 0.5 * F.col("departing"))
    floor = F.when((F.col("criticality") == "A") & (F.col("leavers") > 0) & (F.col("papers") == 0), 75.0).otherwise(0.0)
    return rows.select("tag", "leavers", "papers", F.round("hhi", 6).alias("hhi"), F.round(F.greatest(score, floor), 4).alias("score"))


def exposures(gaps: DataFrame, days: int = 30) -> DataFrame:
    """Signals of requirements that are overdue or soon due, and of those without evidence. gaps: tag, requirement, status, days_left."""
    gap = F.concat_ws(":", "requirement", "tag")
    left = F.col("days_left")
    strength = F.when(left < 0, 1.0).when(left <= days, 0.5 + 0.5 * (1 - left / days)).when(left.isNull() & (F.col("status") == "missing"), 0.5)
    exposed = signal(gaps.withColumn("_s", strength).where("_s IS NOT NULL"), "regulatory_exposure", F.col("_s"), gap=gap)
    void = gaps.where(F.col("status").isin("missing", "incomplete"))
    return exposed.unionByName(signal(void, "evidence_void", F.when(F.col("status") == "missing", 0.9).otherwise(0.7), gap=gap))


def with_confidence(signals: DataFrame, extraction: DataFrame) -> DataFrame:
    """``signals`` with a confidence: what the kind rests on, times how well its document was read.

    extraction: source, confidence, one row per source. A signal without a source counts .85;
    one whose source was not read by machine counts in full.
    """
    base = by_key(BASES, F.col("kind"), HEURISTIC)
    read = signals.join(extraction.select("source", F.col("confidence").alias("_read")), "source", "left")
    return read.withColumn("confidence", F.round(base * F.when(F.col("source").isNull(), WITHOUT_SOURCE).otherwise(F.coalesce("_read", F.lit(1.0))), 6)).drop("_read")


def compounds(signals: DataFrame, rules: list[dict], equipment: DataFrame, facts: DataFrame) -> DataFrame:
    """(tag, rule, severity, strongest, conjunction, confidence, risk, headline): rules whose kinds a machine all has and whose predicate holds.

    rules: name, severity, weight, kinds, where (SQL over the strongest strength of each kind,
    null without, and the columns of ``facts``, one row per tag), shared (kinds that must
    concern the same gap). The conjunction is the noisy-or of the rule's own signals; risk is
    at least the severity's floor.
    """
    kinds = sorted({k for r in rules for k in r["kinds"]})
    signals = checkpointed(signals)  # read three times below; every detector runs once
    best = signals.groupBy("tag").agg(*[F.max(F.when(F.col("kind") == k, F.col("strength"))).alias(k) for k in kinds])
    both = signals.where("gap IS NOT NULL").groupBy("tag", "gap").agg(*[F.max((F.col("kind") == k).cast("int")).alias(f"_{k}") for k in kinds])
    shared = both.groupBy("tag").agg(*[F.max(reduce(lambda a, k: a & (F.col(f"_{k}") == 1), r["shared"], F.lit(True)).cast("int")).alias(f"_shared_{r['name']}") for r in rules if r.get("shared")])
    wide = best.join(shared, "tag", "left").join(facts, "tag", "left")
    hits = []
    for r in rules:
        ok = reduce(lambda a, k: a & F.col(k).isNotNull(), r["kinds"], F.expr(r["where"]))
        if r.get("shared"):
            ok = ok & (F.coalesce(F.col(f"_shared_{r['name']}"), F.lit(0)) == 1)
        hits.append(F.when(ok, F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["severity"]).alias("severity"), F.lit(float(r["weight"])).alias("weight"), F.array(*map(F.lit, r["kinds"])).alias("kinds"))))
    fired = wide.select("tag", F.inline(F.array_compact(F.array(*hits))))
    own = signals.join(fired, "tag").where(F.array_contains("kinds", F.col("kind")))
    order = reduce(lambda out, kv: out.when(F.col("kind") == kv[1], F.lit(kv[0])), enumerate(CONSEQUENCE), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(len(CONSEQUENCE)))
    grouped = own.groupBy("tag", "rule", "severity", "weight").agg(
        F.max("strength").alias("strongest"), F.round(noisy_or(F.col("strength")), 6).alias("conjunction"), F.round(0.7 * F.min("confidence") + 0.3 * F.avg("confidence"), 4).alias("confidence"),
        F.min_by("kind", F.struct(order, "kind")).alias("headline"), F.count("*").alias("signals"),
    )
    scale = by_key(CRITICALITY, F.col("criticality"), CRITICALITY["C"])
    floor = by_key(FLOORS, F.col("severity"), 0.05)
    risk = F.round(F.greatest(floor, clamp(F.col("weight") * F.col("conjunction") * scale)), 6)
    return grouped.join(equipment.select("tag", "criticality"), "tag").select("tag", "rule", "severity", "headline", "signals", "strongest", "conjunction", "confidence", risk.alias("risk"))


def explained(alerts: DataFrame, templates: dict[str, str]) -> DataFrame:
    """``alerts`` with the text of their rule; {column} in a template is that column's value."""
    out = F.when(F.lit(False), F.lit(""))
    for rule, template in templates.items():
        parts = []
        for k, piece in enumerate(template.replace("}", "{").split("{")):
            parts.append(F.col(piece).cast("string") if k % 2 else F.lit(piece))
        out = out.when(F.col("rule") == rule, F.concat(*parts))
    return alerts.withColumn("explanation", out)


def ordered_alerts(alerts: DataFrame) -> DataFrame:
    """``alerts`` with the key they are suppressed by and their place: severity, then risk, then key.

    The place is taken within a severity from a count of the higher ones, so that no single
    task sorts all alerts.
    """
    keyed = alerts.withColumn("key", F.concat_ws(":", "tag", "rule", "severity"))
    rank = reduce(lambda out, kv: out.when(F.col("severity") == kv[1], F.lit(kv[0])), enumerate(SEVERITIES), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))
    return keyed.withColumn("severity_rank", rank).withColumn("place", F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("risk"), "key")))
