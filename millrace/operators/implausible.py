"""Problem 4: readings that cannot be true, per source (machine and parameter).

A robust autoregression of each source: a running median is the level (so trends, daily
swings and lasting level shifts are followed), a first-order autoregression of the bounded
residuals gives innovations, and additive outliers are tested against the source's local
spread and against its own tail, until the flags no longer change; if they come round in a
cycle, what every round of it flags is taken. A tail further out than FAR local spreads is
one of spikes, which would hide each other: it counts as NORMAL spreads there. Spikes of
more than 3 % of a source that lie nearer than that are its own tail. An outlier run longer
than BRIEF readings is a level shift and is left alone. Before that, values outside physical
limits and stuck runs are set apart, so that they neither move the level nor the spread.

Sources with more than ROWS_A_CHUNK readings are cut by number into ranges of time with margins
on both sides; a reading is judged in its own range only. One source may thus hold any share,
and send it in bursts: only what arrives within SLOT stays together.

Defined results: null value, time, tag or parameter -> never flagged; repeated deliveries
(equal reading_id) count once; readings in another known unit are converted first; a source
with under LEAST readings is tested for physical limits and stuck runs only; equal times
are ordered by reading_id; an unknown parameter has no limits; an empty table -> no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.clock import machine, micros
from millrace.operators.skew import is_small
from millrace.session import checkpointed

ROWS_A_CHUNK = 20_000
MARGIN, SLOT = 0.05, 600_000_000  # of a chunk's readings, on each side; the time within which readings stay together, in microseconds
LEVEL, SPREAD, LEAST = 25, 51, 12
SIGMAS, TAILS, BRIEF = 4.5, 2.8, 6  # of the local spread, of the 97 % quantile of the residuals; readings
FAR, NORMAL = 8.0, 2.17  # local spreads: above the 97 % quantile of any sound source (up to 6.8 at check_l); that of a normal one
STUCK, STILL, REPEATS = 8, 0.003, 0.2

#: Fixed physical limits of the parameters in their usual unit.
LIMITS = {
    "bearing_wear_pct": (0.0, 100.0),
    "level_pct": (0.0, 100.0),
    "ph": (0.0, 14.0),
    "vibration_mm_s": (0.0, 1000.0),
    "motor_current_a": (0.0, 20000.0),
    "speed_rpm": (0.0, 60000.0),
    "flow_m3_h": (0.0, 90000.0),
    "discharge_pressure_bar": (-1.01325, 5000.0),
    "temperature_c": (-273.15, 5000.0),
}
#: Fixed conversions to the usual unit of a parameter: value * factor + offset.
UNITS = {
    ("discharge_pressure_bar", "psi"): (0.0689475729, 0.0),
    ("discharge_pressure_bar", "kpa"): (0.01, 0.0),
    ("discharge_pressure_bar", "mpa"): (10.0, 0.0),
    ("temperature_c", "degf"): (5 / 9, -160 / 9),
    ("temperature_c", "k"): (1.0, -273.15),
    ("flow_m3_h", "l/min"): (0.06, 0.0),
    ("flow_m3_h", "gpm"): (0.2271247, 0.0),
    ("flow_m3_h", "l/s"): (3.6, 0.0),
    ("vibration_mm_s", "in/s"): (25.4, 0.0),
}


def usual_value(parameter: Column, unit: Column, value: Column) -> Column:
    """A value in the usual unit of its parameter; unknown and null units are the usual one."""
    out = F.when(F.lit(False), value)
    for (p, u), (factor, offset) in UNITS.items():
        out = out.when((parameter == p) & (F.lower(F.trim(unit)) == u), value * factor + offset)
    return out.otherwise(value)


def impossible_value(parameter: Column, value: Column) -> Column:
    out = F.when(F.isnan(value), F.lit(True))
    for p, (low, high) in LIMITS.items():
        out = out.when(parameter == p, (value < low) | (value > high))
    return out.otherwise(F.lit(False))


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs; same[i] says that item i + 1 belongs to the run of i."""
    starts = np.flatnonzero(np.r_[True, ~same])
    return starts, np.diff(np.r_[starts, len(same) + 1])


def stuck_runs(value: np.ndarray) -> np.ndarray:
    """Readings of runs of at least STUCK that stand still where the source hardly ever does."""
    n = len(value)
    out = np.zeros(n, bool)
    if n < STUCK:
        return out
    step = np.abs(np.diff(value))
    moving = step[step > 0]
    usual = np.median(moving) if len(moving) else 0.0
    # A frozen value may still jitter far below what the source usually moves.
    starts, lengths = _runs(step <= STILL * usual)
    long = lengths >= STUCK
    inside = np.repeat(long, lengths)
    free = ~(inside[1:] & inside[:-1])
    if free.any() and np.mean(step[free] <= STILL * usual) > REPEATS:
        return out
    if not free.any():
        return out
    for a, k in zip(starts[long], lengths[long]):
        out[a : a + k] = True
    return out


def _rolling_median(x: np.ndarray, window: int) -> np.ndarray:
    """The median of the window around each item; at the ends the window lies within x."""
    n = len(x)
    window = min(window, n if n % 2 else n - 1)
    half = window // 2
    middle = np.median(np.lib.stride_tricks.sliding_window_view(x, window), axis=1)
    ends = [np.median(x[: k + half + 1]) for k in range(half)], [np.median(x[n - half - 1 - k :]) for k in range(half - 1, -1, -1)]
    return np.concatenate([ends[0], middle, ends[1]])


def excursions(value: np.ndarray) -> np.ndarray:
    """Additive outliers in runs of at most BRIEF readings."""
    n = len(value)
    flagged = np.zeros(n, bool)
    if n < LEAST:
        return flagged
    rounds: list[np.ndarray] = []
    seen: dict[bytes, int] = {}
    while (state := flagged.tobytes()) not in seen:
        seen[state] = len(rounds)
        rounds.append(flagged)
        kept = np.flatnonzero(~flagged)
        clean = value[kept]
        if len(clean) < LEAST:
            return flagged
        level = _rolling_median(clean, LEVEL)
        size = np.abs(clean - level)
        whole = 1.4826 * np.median(size)
        local = 1.4826 * _rolling_median(size, SPREAD)
        moved = size[size > 0]
        step = np.median(moved) if len(moved) else 0.0
        coarse = whole == 0
        tail = np.quantile(size, 0.97)
        # Levels and spreads at the flagged readings are those of the nearest reading that is kept.
        at = np.minimum(np.searchsorted(kept, np.arange(n)), len(kept) - 1)
        residual = value - level[at]
        spread = np.maximum(local, 0.5 * whole)[at]
        broad = np.maximum(local, whole)
        if not coarse and np.quantile(size / broad, 0.97) > FAR:
            tail = np.minimum(tail, NORMAL * broad)[at]
        limit = np.maximum(SIGMAS * spread, TAILS * tail)
        if coarse:
            limit = np.maximum(limit, 4 * step)
        limit = np.maximum(limit, 1e-9 * (1 + np.abs(level[at])))
        bounded = np.clip(residual, -2 * spread, 2 * spread)
        power = float(np.dot(bounded, bounded))
        phi = float(np.clip(np.dot(bounded[1:], bounded[:-1]) / power, -0.9, 0.9)) if power > 0 else 0.0
        innovation = residual - phi * np.r_[0.0, bounded[:-1]]
        found = (np.abs(residual) > limit) & (np.abs(innovation) > 0.8 * limit)
        starts, lengths = _runs(found[1:] == found[:-1])
        shift = (lengths > BRIEF) & found[starts]  # a lasting change of level, or a way of running
        found &= ~np.repeat(shift, lengths)
        flagged = found
    return np.logical_and.reduce(rounds[seen[state] :])


def _judged(group: pa.Table) -> pa.Table:
    ids, first = np.unique(group["reading_id"].to_numpy(), return_index=True)
    at, value = group["at"].to_numpy()[first], group["value"].to_numpy()[first]
    bad, core = (group[c].to_numpy(zero_copy_only=False)[first] for c in ("bad", "core"))
    order = np.lexsort((ids, at))
    ids, value, bad, core = ids[order], value[order], bad[order].astype(bool), core[order].astype(bool)
    kind = np.zeros(len(ids), np.int8)
    stuck = stuck_runs(np.where(np.isfinite(value), value, 1e300))
    kind[stuck] = 2
    kind[bad] = 1
    rest = np.flatnonzero(kind == 0)
    out = excursions(value[rest])
    kind[rest[out]] = 3
    keep = core & (kind > 0)
    names = np.array(["", "impossible", "stuck", "excursion"], object)
    return pa.table({"reading_id": ids[keep], "kind": pa.array(names[kind[keep]], pa.string())})


def implausible_readings(readings: DataFrame, rows_a_chunk: int = ROWS_A_CHUNK) -> DataFrame:
    """(reading_id, kind) of the implausible readings; kind is impossible, stuck or excursion.

    readings: reading_id, equipment_tag, parameter, value, unit, measured_at.
    """
    value = usual_value(F.col("parameter"), F.col("unit"), F.col("value"))
    rows = readings.select(
        F.col("reading_id").cast("long").alias("reading_id"), machine(F.col("equipment_tag")).alias("tag"), "parameter", value.alias("value"), micros(F.col("measured_at")).alias("at")
    ).dropna()
    rows = rows.withColumn("bad", impossible_value(F.col("parameter"), F.col("value")))
    counts = checkpointed(rows.groupBy("tag", "parameter").agg(F.count("*").alias("n")))
    large = counts.where(F.col("n") > rows_a_chunk).select("tag", "parameter")
    whole = lambda r: r.select("tag", "parameter", F.lit(0).cast("long").alias("chunk"), "reading_id", "at", "value", "bad", F.lit(True).alias("core"))
    if large.isEmpty():
        placed = whole(rows)
    else:
        large = F.broadcast(large) if is_small(large) else large
        # Only the readings of large sources are shuffled a second time.
        placed = whole(rows.join(large, ["tag", "parameter"], "left_anti")).unionByName(_chunked(rows.join(large, ["tag", "parameter"], "left_semi"), rows_a_chunk))
    return placed.groupBy("tag", "parameter", "chunk").applyInArrow(_judged, "reading_id long, kind string")


def _chunked(rows: DataFrame, rows_a_chunk: int) -> DataFrame:
    """The rows of large sources with chunk and core: cut after every ``rows_a_chunk`` readings, however they lie in time.

    Readings are counted by slots of SLOT; running sums of these give each slot its chunk,
    and a second one where it lies within MARGIN of a chunk's readings from the next. A row
    stands in each chunk of its slot, as core in its own, which alone judges it.
    """
    slot = F.floor(F.col("at") / F.lit(SLOT))
    many = rows.groupBy("tag", "parameter", slot.alias("slot")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tag", "parameter").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    places = many.withColumn("before", F.coalesce(before, F.lit(0)))
    own, margin = F.floor(F.col("before") / rows_a_chunk), MARGIN * rows_a_chunk
    last = F.floor((F.max(F.col("before")).over(Window.partitionBy("tag", "parameter"))) / rows_a_chunk)
    lowest = F.greatest(F.floor((F.col("before") - margin) / rows_a_chunk), F.lit(0))
    highest = F.least(F.floor((F.col("before") + F.col("n") + margin) / rows_a_chunk), last)
    places = places.select("tag", "parameter", "slot", own.alias("own"), F.sequence(F.least(lowest, own), F.greatest(highest, own)).alias("chunks"))
    placed = rows.withColumn("slot", slot).join(places, ["tag", "parameter", "slot"]).withColumn("chunk", F.explode("chunks"))
    return placed.select("tag", "parameter", "chunk", "reading_id", "at", "value", "bad", (F.col("chunk") == F.col("own")).alias("core"))
