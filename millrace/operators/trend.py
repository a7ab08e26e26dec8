"""Series, records and events of machines: trends, limits, repetition, chains, alerts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.clock import machine
from millrace.functions.confidence import clamp
from millrace.functions.text import ANOMALY_TERMS
from millrace.operators.implausible import usual_value


def latest_deliveries(readings: DataFrame) -> DataFrame:
    """Readings with a machine, time and value in the usual unit; of repeated deliveries the last one received."""
    value = usual_value(F.col("parameter"), F.col("unit"), F.col("value"))
    rows = readings.select("reading_id", machine(F.col("equipment_tag")).alias("tag"), "parameter", value.alias("value"), F.col("measured_at").cast("timestamp").alias("measured_at"), F.col("received_at").cast("timestamp").alias("received_at"))
    rows = rows.dropna(subset=["tag", "parameter", "value", "measured_at"])
    last = F.max_by(F.struct("tag", "parameter", "value", "measured_at"), F.struct("received_at", "measured_at", "value", "tag", "parameter"))
    return rows.groupBy("reading_id").agg(last.alias("r")).select("reading_id", "r.*")


def trends(readings: DataFrame) -> DataFrame:
    """(tag, parameter, n, slope per day, latest): least squares; one point or no spread gives slope 0."""
    days = F.unix_micros("measured_at") / 8.64e10
    rows = readings.withColumn("day", days - 19000)
    return rows.groupBy("tag", "parameter").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.regr_slope("value", "day"), F.lit(0.0)), 6).alias("slope"), F.round(F.max_by("value", F.struct("measured_at", "reading_id")), 6).alias("latest")
    )


def threshold_approach(trend: DataFrame, equipment: DataFrame, ratio: float = 0.85) -> DataFrame:
    """Machines whose latest value has come to ``ratio`` of a limit; strength .45 to 1, days to the limit."""
    limits = equipment.select("tag", F.explode("oem_thresholds").alias("parameter", "threshold")).where("threshold > 0")
    near = trend.join(limits, ["tag", "parameter"]).withColumn("ratio", F.col("latest") / F.col("threshold")).where(F.col("ratio") >= ratio)
    days = F.when((F.col("slope") > 0) & (F.col("latest") < F.col("threshold")), (F.col("threshold") - F.col("latest")) / F.col("slope"))
    return near.select("tag", "parameter", F.col("threshold"), "latest", F.round("ratio", 6).alias("ratio"), F.round(0.45 + 0.55 * clamp((F.col("ratio") - ratio) / (1 - ratio)), 6).alias("strength"), F.round(days, 3).alias("days_to_limit"))


def records_of(maintenance: DataFrame) -> DataFrame:
    """Maintenance records with canonical tags, of repeated rows one."""
    return maintenance.withColumn("tag", machine(F.col("equipment_tag"))).dropDuplicates(["record_id"])


def repeat_findings(records: DataFrame, as_of: Column, days: int = 90, least: int = 2) -> DataFrame:
    """(tag, term, records, strength): anomaly terms found in several records of a machine lately."""
    low = F.lower("findings")
    terms = F.filter(F.array(*[F.struct(F.lit(n).alias("term"), F.lit(w).alias("weight"), low.rlike(p).alias("hit")) for n, p, w in ANOMALY_TERMS]), lambda t: t["hit"])
    recent = records.where((F.datediff(as_of, "performed_on") <= days) & F.col("tag").isNotNull() & F.col("findings").isNotNull())
    hits = recent.select("tag", "record_id", F.inline(terms)).groupBy("tag", "term", "weight").agg(F.count("*").alias("records")).where(F.col("records") >= least)
    return hits.select("tag", "term", "records", F.round(clamp((0.55 + 0.15 * (F.col("records") - least)) * F.col("weight")), 6).alias("strength"))


def interval_compression(records: DataFrame, ratio: float = 0.6, least: int = 4) -> DataFrame:
    """Machines whose later half of gaps between visits is under ``ratio`` of the earlier half, on average."""
    visits = records.where("tag IS NOT NULL AND performed_on IS NOT NULL").select("tag", "performed_on").distinct()
    w = Window.partitionBy("tag").orderBy("performed_on")
    gaps = visits.withColumn("gap", F.datediff("performed_on", F.lag("performed_on").over(w))).where("gap IS NOT NULL")
    gaps = gaps.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("tag"))})
    early = F.col("k") <= F.floor(F.col("n") / 2)
    out = gaps.where(F.col("n") >= least - 1).groupBy("tag").agg(F.avg(F.when(early, F.col("gap"))).alias("early"), F.avg(F.when(~early, F.col("gap"))).alias("late"))
    return out.where(F.col("late") < ratio * F.col("early")).select("tag", F.round("early", 4).alias("early"), F.round("late", 4).alias("late"))


def fleet_incidence(failures: DataFrame, equipment: DataFrame, as_of: Column, days: int = 720, least: int = 2) -> DataFrame:
    """(equipment_type, mode, machines, events, downtime, latest): modes seen on several machines of a type."""
    rows = failures.select(machine(F.col("equipment_tag")).alias("tag"), F.lower(F.trim(F.regexp_replace("failure_mode", "[_ -]+", " "))).alias("mode"), "occurred_on", "downtime_hours")
    rows = rows.where((F.datediff(as_of, "occurred_on") <= days) & F.col("mode").isNotNull()).join(equipment.select("tag", "equipment_type"), "tag")
    out = rows.groupBy("equipment_type", "mode").agg(F.count_distinct("tag").alias("machines"), F.count("*").alias("events"), F.round(F.sum("downtime_hours"), 3).alias("downtime"), F.max("occurred_on").alias("latest"))
    return out.where(F.col("machines") >= least)


def preceding(failures: DataFrame, maintenance: DataFrame, days: int = 30) -> DataFrame:
    """(event_id, record_id, gap_days): maintenance of the same machine up to ``days`` before a failure."""
    f = failures.select("event_id", machine(F.col("equipment_tag")).alias("tag"), "occurred_on")
    m = records_of(maintenance).select("record_id", "tag", "performed_on")
    # Band join: equal machine and coarse range of days, the failure's range and the one before it.
    width = F.lit(days)
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    f = f.withColumn("range", F.explode(F.array(F.floor(day("occurred_on") / width), F.floor(day("occurred_on") / width) - 1)))
    m = m.withColumn("range", F.floor(day("performed_on") / width))
    gap = F.datediff("occurred_on", "performed_on")
    return f.join(m, ["tag", "range"]).withColumn("gap_days", gap).where(F.col("gap_days").between(0, days)).select("event_id", "record_id", "gap_days")


ALERTS_A_GROUP = 50_000


def kept_alerts(alerts: DataFrame, window_seconds: int = 3600) -> DataFrame:
    """Alerts that are not within the window after the last *kept* one of their key.

    alerts: key, at (timestamp), id. An alert a whole window after its predecessor is always
    kept, so a key's alerts fall into independent sessions. A session of one alert is kept as
    it is; only within longer ones is the choice sequential, and many of them share a group.
    """
    window = window_seconds * 1_000_000

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "session", "micros", "id"], ignore_index=True)
        opens = (frame[["key", "session"]] != frame[["key", "session"]].shift()).any(axis=1).to_numpy()
        chosen, last = np.zeros(len(frame), bool), 0
        for k, (at, new) in enumerate(zip(frame["micros"].to_numpy(), opens)):
            if new or at - last >= window:
                chosen[k], last = True, at
        return frame.loc[chosen, ["key", "at", "id"]]

    w = Window.partitionBy("key").orderBy("micros", "id")
    rows = alerts.select("key", F.col("at").cast("timestamp").alias("at"), "id").withColumn("micros", F.unix_micros("at"))
    rows = rows.withColumn("opens", (F.coalesce(F.col("micros") - F.lag("micros").over(w), F.lit(window)) >= window).cast("int"))
    rows = rows.withColumn("closes", F.coalesce(F.lead("opens").over(w), F.lit(1)))
    rows = rows.withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    alone = (F.col("opens") == 1) & (F.col("closes") == 1)
    groups = F.lit(max(1, -(-alerts.count() // ALERTS_A_GROUP)))
    several = rows.where(~alone).select("key", "session", "micros", "at", "id", F.pmod(F.xxhash64("key", "session"), groups).alias("group"))
    kept = several.groupBy("group").applyInPandas(keep, "key string, at timestamp, id long")
    return rows.where(alone).select("key", "at", "id").unionByName(kept)
