import datetime as dt
import random

from millrace.llm import nearest

HOUR = 3_600_000_000
DAY = dt.date(2024, 5, 1)


def brute(records, readings):
    out = {}
    for rid, tag, at, within in records:
        best = min(((abs(m - at), m, i) for i, t, m in readings if t and tag and t.strip().upper() == tag.strip().upper()), default=None)
        if best and best[0] <= dt.timedelta(microseconds=within):
            out[rid] = best[2]
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    tags = ["P-1", " p-1", "C-2", "c-2 ", "K-3"]
    t0 = dt.datetime(2024, 5, 1)
    readings = [(k, rng.choice(tags), t0 + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 40, 30))) for k in range(1500)]
    records = [(f"r{k}", rng.choice(tags), t0 + dt.timedelta(days=rng.randrange(-2, 42)), rng.choice([HOUR // 4, 6 * HOUR, 12 * HOUR])) for k in range(300)]
    left = spark.createDataFrame(records, "record_id string, entity string, at timestamp, within long")
    right = spark.createDataFrame(readings, "reading_id long, entity string, at timestamp")
    want = brute(records, readings)
    got = {r.record_id: r.reading_id for r in nearest.nearest_readings(left, right).collect()}
    assert got == want
    # Hot ranges split over salts, many groups: the same.
    monkeypatch.setattr("millrace.operators.skew.ROWS_A_SALT", 20)
    monkeypatch.setattr(nearest, "ROWS_A_TASK", 100)
    assert {r.record_id: r.reading_id for r in nearest.nearest_readings(left, right).collect()} == want


def test_ties_bounds_nulls_and_repeats(spark):
    day = dt.datetime(2024, 5, 1)
    h = lambda x: day + dt.timedelta(hours=x)
    readings = spark.createDataFrame(
        [(1, "a", h(-3)), (2, "A ", h(3)), (9, "b", h(12)), (8, "b", h(12)), (8, "b", h(12)), (3, "c", h(12.01)), (4, None, h(0)), (5, "d", None), (6, " ", h(0))], "reading_id long, entity string, at timestamp"
    ).selectExpr("*", "1 AS range", "2 AS group", "3 AS within")
    records = spark.createDataFrame(
        [("ra", "A", DAY, 12 * HOUR), ("rb", "B", DAY, 12 * HOUR), ("rb", "B", DAY, 12 * HOUR), ("rc", "c", DAY, 12 * HOUR), ("rn", None, DAY, 12 * HOUR), ("rd", "d", DAY, 12 * HOUR), ("rt", "a", None, 12 * HOUR), ("rs", " ", DAY, 12 * HOUR)],
        "record_id string, entity string, at date, within long",
    )
    got = sorted((r.record_id, r.reading_id) for r in nearest.nearest_readings(records, readings).collect())
    assert got == [("ra", 1), ("rb", 8)]
    assert nearest.nearest_readings(records, readings.limit(0)).count() == 0
    assert nearest.nearest_readings(records.limit(0), readings).count() == 0
