import random

from pyspark.sql import functions as F

from millrace.operators import drawings as D


def test_suppression_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for k in range(80):
        x, y = rng.randrange(100), rng.randrange(100)
        rows.append((k % 2, k, float(x), float(y), float(x + rng.randrange(10, 40)), float(y + rng.randrange(10, 40)), rng.randrange(10) / 10))
    got = {(r.page, r.id) for r in D.suppressed(spark.createDataFrame(rows, "page int, id long, x0 double, y0 double, x1 double, y1 double, score double")).collect()}
    want = set()
    for page in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[6], r[1])):
            if all(D.intersection_over_union(r[2:6], k[2:6]) <= D.OVERLAP for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    assert got == want


def test_connections_confidence_and_edges(spark):
    symbols = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.8, "P-1"), (1, 2, 100.0, 0.0, 110.0, 10.0, 0.6, "V-2"), (1, 3, 300.0, 300.0, 310.0, 310.0, 1.0, None)], "page int, id long, x0 double, y0 double, x1 double, y1 double, score double, tag string")
    runs = spark.createDataFrame([(1, 1, 10.0, 5.0, 90.0, 5.0, True), (1, 2, 10.0, 5.0, 5.0, 5.0, False), (1, 3, 200.0, 200.0, 305.0, 305.0, False)], "page int, run long, x0 double, y0 double, x1 double, y1 double, arrow boolean")
    links = D.connections(symbols, runs)
    assert [(r.run, r.source, r.target, r.confidence) for r in links.collect()] == [(1, 1, 2, round(0.4 + 0.35 * 0.75 + 0.15 * 0.8 + 0.1, 6))]
    assert D.page_confidence(symbols, links).first().confidence == round(0.5 * 0.8 + 0.3 * 2 / 3 + 0.2 * 2 / 3, 6)
    assert [tuple(r) for r in D.drawing_edges(symbols, links).select("source", "target", "type").collect()] == [("P-1", "V-2", "CONNECTED_TO")]
    assert D.connections(symbols.limit(0), runs).count() == 0


def test_drawing_or_page(spark):
    rows = spark.createDataFrame([(3000.0, 2000.0, 0.05, 0.01), (800.0, 1100.0, 0.05, 0.01), (3000.0, 2000.0, 0.05, 0.4), (3000.0, 2000.0, 0.001, 0.01)], "w double, h double, l double, t double")
    assert [r.d for r in rows.select(D.is_drawing(F.col("w"), F.col("h"), F.col("l"), F.col("t")).alias("d")).collect()] == [True, False, False, False]
