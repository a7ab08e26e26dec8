import base64
import datetime as dt
import json

import numpy as np
import pytest

from millrace.operators import compliance
from millrace.sources import sinks
from millrace.streaming import topics


def test_publish_subscribe_and_history(spark, tmp_path):
    folder, t0 = str(tmp_path / "bus"), dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, f"P-{k % 3}", t0 + dt.timedelta(minutes=k)) for k in range(9)], "id long, tag string, at timestamp")
    topics.publish(events, folder, "readings", "tag")
    topics.publish(events.limit(2), folder, "alerts", "tag")
    assert [json.loads(r.payload)["id"] for r in topics.history(spark, folder, "readings", 3).collect()] == [8, 7, 6]
    seen = []
    stream = topics.subscribe(spark, folder, "readings", "id long, tag string, at timestamp")
    topics.handled(stream, {"readings": lambda b: seen.extend(r.id for r in b.collect())}, str(tmp_path / "c")).awaitTermination(60)
    assert sorted(seen) == list(range(9))
    # A reader with a checkpoint goes on where it ended.
    topics.publish(events.where("id = 4"), folder, "readings", "tag")
    topics.handled(topics.subscribe(spark, folder, "readings", "id long"), {"readings": lambda b: seen.append([r.id for r in b.collect()])}, str(tmp_path / "c")).awaitTermination(60)
    assert seen[-1] == [4]


def test_store_keeps_the_newest_of_each_key(spark, tmp_path):
    folder, schema = str(tmp_path / "meta"), "id long, state string, at int"
    assert sinks.current(spark, folder) == (None, 0)
    sinks.store(spark.createDataFrame([(1, "new", 1), (2, "new", 5), (None, "x", 1)], schema), folder, "id", "at")
    sinks.store(spark.createDataFrame([(1, "done", 2), (2, "late", 4), (3, "new", 1)], schema), folder, "id", "at")
    table, version = sinks.current(spark, folder)
    assert version == 2 and sorted(tuple(r) for r in table.select("id", "state").collect()) == [(1, "done"), (2, "new"), (3, "new")]


def test_bundle_round_trip(spark):
    v = [0.6, -0.8, 0.0]
    df = spark.createDataFrame([("P-1", 2, "b", v), ("P-1", 1, "a", [1.0, 0.0, 0.0])], "tag string, id long, text string, vector array<double>")
    payload = json.loads(sinks.bundle(df, "tag").first().payload)
    assert [p["id"] for p in payload["passages"]] == [1, 2]
    stored = np.frombuffer(base64.b64decode(payload["passages"][1]["index"]), np.int8)
    assert stored.tolist() == [76, -102, 0]


def test_catalogue(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"requirement": "A", "type_pattern": "pump", "evidence_type": "sop", "days": 30, "required": ["findings"], "severity": 2}\n{"requirement": "B", "type_pattern": "tank", "evidence_type": "sop", "days": 5, "grace": 1}\n')
    rows = {r.requirement: (r.grace, r.severity) for r in compliance.load_catalogue(spark, str(good)).collect()}
    assert rows == {"A": (0, 2), "B": (1, 1)}
    for text in ('{"requirement": "A", "type_pattern": "p", "evidence_type": "sop", "days": 0}', '{"evidence_type": "sop", "days": 3}', '{"requirement": "A", "evidence_type": "s", "days": 3}\n{"requirement": "A", "evidence_type": "s", "days": 3}'):
        bad = tmp_path / "bad.json"
        bad.write_text(text)
        with pytest.raises(ValueError):
            compliance.load_catalogue(spark, str(bad))
