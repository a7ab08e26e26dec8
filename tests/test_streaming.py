"""Streams are files read with availableNow; each file is a batch of its own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import trend
from millrace.streaming import alerts

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    def make(batches, schema):
        d = tmp_path / "in"
        d.mkdir()
        for k, rows in enumerate(batches):
            (d / f"{k}.json").write_text("\n".join(json.dumps(r, default=str) for r in rows))
            import os

            os.utime(d / f"{k}.json", (k + 1, k + 1))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))

    return make


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.sql(f"SELECT * FROM {name}").collect()]


def at(seconds):
    return (T0 + dt.timedelta(seconds=seconds)).isoformat()


def test_alerts_count_from_the_last_kept(spark, stream):
    batches = [[{"key": "a", "at": at(0), "id": 1}, {"key": "a", "at": at(3000), "id": 2}, {"key": "b", "at": at(10), "id": 9}], [{"key": "a", "at": at(4000), "id": 3}], [{"key": "a", "at": at(7000), "id": 4}]]
    got = run(alerts.kept_alerts(stream(batches, "key string, at timestamp, id long")), "kept", "append")
    assert sorted(r[2] for r in got) == [1, 3, 9]
    flat = [(r["key"], r["at"], r["id"]) for b in batches for r in b]
    batch = trend.kept_alerts(spark.createDataFrame(flat, "key string, at string, id long").withColumn("at", F.to_timestamp("at")))
    assert sorted(r.id for r in batch.collect()) == [1, 3, 9]


def test_late_alerts_of_other_keys_are_kept(spark, stream):
    minutes = [("A", 605, 1), ("A", 720, 2), ("B", 604, 3), ("C", 719, 4), ("A", 900, 5), ("A", 900, 8), ("D", 779, 6), ("D", 781, 7)]
    batches = [[{"key": k, "at": at(60 * m), "id": n}] for k, m, n in minutes]
    got = run(alerts.kept_alerts(stream(batches, "key string, at timestamp, id long")), "late_keys", "append")
    assert sorted(r[2] for r in got) == [1, 2, 3, 4, 5, 7]  # 6 is older than the watermark, two hours before 5


def test_late_alerts_of_the_same_key(spark, stream):
    minutes = [("A", 600, 1), ("A", 780, 2), ("A", 690, 3), ("A", 630, 4), ("A", 740, 5), ("A", 839, 6), ("A", 840, 7)]
    batches = [[{"key": k, "at": at(60 * m), "id": n}] for k, m, n in minutes]
    got = run(alerts.kept_alerts(stream(batches, "key string, at timestamp, id long"), late="4 hours"), "late_same", "append")
    assert sorted(r[2] for r in got) == [1, 2, 3, 7]


def test_lateness_of_alerts_is_a_parameter(spark, stream):
    batches = [[{"key": "A", "at": at(7200), "id": 1}], [{"key": "A", "at": at(7201), "id": 4}], [{"key": "B", "at": at(7100), "id": 2}], [{"key": "B", "at": at(7190), "id": 3}]]
    got = run(alerts.kept_alerts(stream(batches, "key string, at timestamp, id long"), late="1 minute"), "lateness", "append")
    assert sorted(r[2] for r in got) == [1, 3]


def test_late_rows_inside_and_outside_the_watermark(spark, stream):
    batches = [[{"ts": at(0), "event_type": "x"}, {"ts": at(20000), "event_type": "x"}], [{"ts": at(15000), "event_type": "x"}], [{"ts": at(100), "event_type": "x"}], [{"ts": at(90000), "event_type": "x"}]]
    got = run(alerts.tumbling_counts(stream(batches, "ts timestamp, event_type string")), "windows", "append")
    counts = {r[0]: r[2] for r in got}
    assert counts[T0] == 1  # the second row of that hour came after the watermark
    assert counts[T0 + dt.timedelta(hours=4)] == 1
    assert counts[T0 + dt.timedelta(hours=5)] == 1


def test_ledger_expires_closes_and_is_capped(spark, stream):
    day = 86400
    first = [{"tag": "P-1", "gap_id": f"g{k:03}", "status": "missing", "at": at(k)} for k in range(70)]
    batches = [first, [{"tag": "P-1", "gap_id": "g069", "status": "compliant", "at": at(100)}], [{"tag": "P-1", "gap_id": "new", "status": "missing", "at": at(95 * day)}]]
    got = [r for r in run(alerts.gap_ledger(stream(batches, "tag string, gap_id string, status string, at timestamp")), "ledger", "update") if r[0] == "P-1"]
    assert got[0][1] == 64 and "g005" not in got[0][2] and "g006" in got[0][2]
    assert got[1][1] == 63
    assert got[-1][1:] == (1, "new")


def test_latest_stage(spark, stream):
    batches = [[{"job": "j", "stage": "parse", "ts": at(1)}], [{"job": "j", "stage": "index", "ts": at(2)}, {"job": "k", "stage": "parse", "ts": at(2)}]]
    got = run(alerts.latest_stage(stream(batches, "job string, stage string, ts timestamp")), "stages", "complete")
    assert {r[0]: r[1] for r in got} == {"j": "index", "k": "parse"}
