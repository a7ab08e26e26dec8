"""Hops over graphs: against brute force, and what is written on the way."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from test_lexical import shuffled_rows

from millrace.operators import graph


def brute(seeds, edges, hops):
    """The pairs reached, one hop after the other; a key that is null is never known."""
    ways = {}
    for a, b, c in edges:
        for x, y in ((a, b), (b, a)):
            if x is not None and c is not None:
                ways.setdefault(x, {})[y] = max(c, ways.get(x, {}).get(y, c))
    out = []
    for seed in {s for s in seeds if s is not None}:
        known, front = {seed}, {seed: 1.0}
        for hop in range(1, hops + 1):
            new = {}
            for key, weight in front.items():
                for other, c in ways.get(key, {}).items():
                    if other not in known:
                        new[other] = max(weight * c * 0.9, new.get(other, -9.0))
            out += [(seed, key, hop, float(Decimal(repr(c)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0) for key, c in new.items()]
            front = {key: c for key, c in new.items() if key is not None}
            known |= front.keys()
    return sorted(out, key=repr)


def reached(spark, seeds, edges, hops):
    rows = spark.createDataFrame([(a, b, "", c) for a, b, c in edges], "source string, target string, type string, confidence double")
    got = graph.reachable(spark.createDataFrame([(s,) for s in seeds], "seed string"), rows, hops)
    assert got.dtypes == [("seed", "string"), ("key", "string"), ("hops", "int"), ("confidence", "double")]
    return sorted(((r.seed, r.key, r.hops, r.confidence) for r in got.collect()), key=repr)


def test_hops_over_odd_edges_in_many_blocks(spark, monkeypatch):
    for name, value in (("SEEDS_A_GROUP", 9), ("PAIRS_A_BLOCK", 300), ("WAYS_A_BUCKET", 150), ("EDGES_AT_ONCE", 100), ("PAIRS_AT_ONCE", 200)):
        monkeypatch.setattr(graph, name, value)
    rnd = random.Random(3)
    keys = [f"K{k}" for k in range(120)] + ["", "é", None]
    edges = [(rnd.choice(keys), rnd.choice(keys), rnd.choice([0.0, 0.1, 0.25, 0.5, 1 / 3, 1.0, None, -0.5, 0.0000005])) for _ in range(240)] + [("K1", "K1", 1.0), ("alone", "alone", 1.0), ("leaf", "K2", 0.7), ("K2", "leaf", 0.9)]
    seeds = [*keys[::3], None, "leaf", "alone", "unknown", "K3", "K3"]
    for hops in (1, 2, 4):
        assert reached(spark, seeds, edges, hops) == brute(seeds, edges, hops)
    assert reached(spark, [], edges, 3) == reached(spark, seeds, [], 3) == []


def test_confidences_that_are_not_numbers(spark):
    edges = [("a", "b", float("nan")), ("a", "c", float("inf")), ("a", "d", float("-inf")), ("b", "e", 0.5), ("c", "e", 0.5)]
    got = reached(spark, ["a"], edges, 2)
    assert repr(got) == repr([("a", "b", 1, float("nan")), ("a", "c", 1, float("inf")), ("a", "d", 1, float("-inf")), ("a", "e", 2, float("nan"))])


def test_rounding_is_that_of_spark(spark):
    x = [0.0000005, 0.0000015, 0.1234565, 0.1234575, 1 / 3, 0.0, -0.0000001, -0.1234565, 5e12, 123456.7890125, 1e300, float("nan"), float("inf")] + [k * 0.729 / 2500 for k in range(2500)] + [k / 2_000_000 for k in range(2000)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").selectExpr("round(x, 6)").collect()]
    assert graph._rounded(np.array(x)).tolist() == want or repr(graph._rounded(np.array(x)).tolist()) == repr(want)


def test_three_hops_write_no_pairs(spark):
    """40 x 40 pairs lead on and 40 x 2,000 do not; 84,000 ways."""
    edges = [(f"S{s}", f"M{m}", 0.5) for s in range(40) for m in range(40)] + [(f"M{m}", f"P{p}", (1 + (m * p) % 50) / 50) for m in range(40) for p in range(1000)] + [(f"M{k % 40}", f"C{k}", 0.8) for k in range(1000)]
    seeds = [f"S{s}" for s in range(40)]
    before = shuffled_rows(spark)
    got = reached(spark, seeds, edges, 3)
    assert got == brute(seeds, edges, 3) and len(got) > 80_000
    assert shuffled_rows(spark) - before < 2_000
