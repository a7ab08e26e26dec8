"""Problem 3: each record with the reading of the same entity nearest to it in time.

Both tables are co-grouped by entity and time range. A record goes to each range that its
tolerance reaches (the overlapping margin, so readings are never copied), a reading to its
own range; many ranges share a group, whose neighbours are found by one vectorised binary
search. The best of a record's ranges wins. Ranges with more readings than ROWS_A_SALT are
split over salts, the few records there being copied, so an entity may hold any share.

Ties: of two equally near readings the earlier, of equal times the lowest reading id.
Null or blank entity, null time or null id: takes no part. Repeated rows count once.
No reading within the tolerance: no row. An empty table on either side: no rows.
Other columns are dropped first, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.clock import DAY, HOUR, machine, micros
from millrace.operators.skew import hot_keys
from millrace.session import checkpointed

RANGE = 4 * DAY
ROWS_A_TASK, GROUPS_A_TASK = 125_000, 8  # several small groups even out what a hash gives a task
_OUT = "record_id string, gap long, at long, reading_id long"


def nearest_in_group(records: pa.Table, readings: pa.Table) -> pa.Table:
    """(record_id, gap, at, reading_id) of the records with a reading within their tolerance."""
    empty = pa.table({"record_id": pa.array([], pa.string()), "gap": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "reading_id": pa.array([], pa.int64())})
    if not len(records) or not len(readings):
        return empty
    known = pc.unique(records["entity"])
    code = pc.index_in(readings["entity"], known)
    readings = readings.append_column("code", code).filter(pc.is_valid(code))
    if not len(readings):
        return empty
    code, time, rid = (readings[c].to_numpy() for c in ("code", "at", "reading_id"))
    times, rank = np.unique(time, return_inverse=True)
    key = code.astype(np.int64) * (len(times) + 1) + rank
    order = np.lexsort((rid, key))
    key, time, rid, code = key[order], time[order], rid[order], code[order]
    own = pc.index_in(records["entity"], known).to_numpy().astype(np.int64)
    when, within = records["at"].to_numpy(), records["within"].to_numpy()
    right = np.searchsorted(key, own * (len(times) + 1) + np.searchsorted(times, when))
    left = np.searchsorted(key, key[np.maximum(right - 1, 0)])  # the first of equal times
    far = np.int64(1 << 62)
    before = np.where((right > 0) & (code[left] == own), when - time[left], far)
    there = np.minimum(right, len(key) - 1)
    after = np.where((right < len(key)) & (code[there] == own), time[there] - when, far)
    gap, best = np.minimum(before, after), np.where(before <= after, left, there)
    ok = gap <= within
    return pa.table({"record_id": records["record_id"].combine_chunks().filter(pa.array(ok)), "gap": gap[ok], "at": time[best][ok], "reading_id": rid[best][ok]})


def nearest_readings(records: DataFrame, readings: DataFrame) -> DataFrame:
    """(record_id, reading_id, gap) where gap is in microseconds.

    records: record_id, entity, at (date or timestamp), within (microseconds, 0 or more).
    readings: reading_id, entity, at. Entities are compared trimmed and upper-cased.
    """
    records = records.select(F.col("record_id").cast("string"), machine(F.col("entity")).alias("entity"), micros(F.col("at")).alias("at"), F.col("within").cast("long")).dropna()
    readings = readings.select(F.col("reading_id").cast("long"), machine(F.col("entity")).alias("entity"), micros(F.col("at")).alias("at")).dropna()
    span = F.lit(RANGE)
    records = records.withColumn("range", F.explode(F.sequence(F.floor((F.col("at") - F.col("within")) / span), F.floor((F.col("at") + F.col("within")) / span))))
    readings = readings.withColumn("range", F.floor(F.col("at") / span))
    # One row per range: read for the number of readings and for the hot ranges.
    counts = checkpointed(readings.groupBy("entity", "range").agg(F.count("*").alias("n")))
    tasks = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // ROWS_A_TASK)
    hot = hot_keys(counts.select(F.struct("entity", "range").alias("place"), "n"), "place", "n").select("place.*", "_salts")

    def grouped(df: DataFrame, salt) -> DataFrame:
        placed = df.join(hot, ["entity", "range"], "left").withColumn("salt", salt)
        return placed.withColumn("group", F.pmod(F.xxhash64("entity", "range", "salt"), F.lit(tasks * GROUPS_A_TASK)))

    def dealt(df: DataFrame) -> DataFrame:
        """Partitions by the number of rows, so that a task's share stays the same however many there are."""
        return df.repartition(tasks, "group").groupBy("group")

    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = grouped(records, F.explode(F.sequence(F.lit(0), salts - 1))).select("group", "record_id", "entity", "at", "within")
    right = grouped(readings, F.pmod(F.xxhash64("reading_id"), salts).cast("int")).select("group", "reading_id", "entity", "at")
    pairs = dealt(left).cogroup(dealt(right)).applyInArrow(nearest_in_group, _OUT)
    best = pairs.groupBy("record_id").agg(F.min(F.struct("gap", "at", "reading_id")).alias("best"))
    return best.select("record_id", "best.reading_id", "best.gap")


def plant_records(failure: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Failures (12 hours) and maintenance records (6 hours) as one table of records."""
    return failure.select(F.col("event_id").alias("record_id"), F.col("equipment_tag").alias("entity"), F.col("occurred_on").alias("at"), F.lit(12 * HOUR).alias("within")).unionByName(
        maintenance.select("record_id", F.col("equipment_tag").alias("entity"), F.col("performed_on").alias("at"), F.lit(6 * HOUR).alias("within"))
    )
