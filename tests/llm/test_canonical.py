import itertools
import random

from pyspark.sql import functions as F

from millrace.llm import canonical

REGISTRY = [("P-101", "Crude charge pump"), ("P-205A", "Lean amine pump A"), ("P-205B", "Lean amine pump B"), ("KOD-7310", "Steam drum drum"), ("BP-8801", None), ("M-45", "Fuel gas motor"), ("TK-600", "Fuel gas tank"), ("CV-601", "Fuel gas valve"), ("XV-601", "Hot oil valve")]


def resolve(spark, raws, registry=REGISTRY):
    rows = spark.createDataFrame(list(enumerate(raws)), "resolution_id long, raw string").selectExpr("*", "'x' AS tag", "1 AS tier", "2 AS value")
    reg = spark.createDataFrame(registry, "tag string, name string").selectExpr("*", "1 AS raw")
    return {raws[r.resolution_id]: r.tag for r in canonical.resolve(rows, reg).collect()}


def test_forms(spark):
    want = {
        "p-101": "P-101", "P 101": "P-101", "[P.101]": "P-101", "Ｐ－１０１": "P-101", "P‑101": "P-101", "old P-101 north side": "P-101", "U-02 P-205B": "P-205B", "P-l0l": "P-101", "8P-8B01": "BP-8801",
        "P-1011": "P-101", "PP-205A": "P-205A", "KOD-3710": "KOD-7310", "lean amine pump b": "P-205B", "pump b, lean amine": "P-205B", "lean amime pump a": "P-205A", "crude charge": "UNMATCHED",
        "pump 101": "P-101", "Valve no. 601": "UNMATCHED", "P-205": "UNMATCHED", "lean amine pump": "UNMATCHED", "???": "UNMATCHED", "ZQ-85171": "UNMATCHED", "steam drum drum": "KOD-7310", "tank #600": "TK-600",
    }
    assert resolve(spark, list(want)) == want


def test_runs_of_words(spark):
    df = spark.createDataFrame([("OLD P 101 (NORTH)",), ("",)], "t string")
    got = [r.r for r in df.select(canonical.runs(F.col("t")).alias("r")).collect()]
    assert got == [["OLD", "P", "101", "NORTH", "OLD P", "P 101", "101 NORTH", "OLD P 101", "P 101 NORTH"], []]
    assert resolve(spark, ["by the boiler P 101 as before", "ask for P-l0l today"]) == {"by the boiler P 101 as before": "P-101", "ask for P-l0l today": "P-101"}


def test_rows_that_take_no_part_and_empty_sides(spark):
    got = resolve(spark, [None, "", "    ", "P-101", "p-101", "p-101", "x" * 20000])
    assert got == {"p-101": "P-101", "x" * 20000: "UNMATCHED"}
    rows = spark.createDataFrame([(1, "p-101")], "resolution_id long, raw string")
    empty = spark.createDataFrame([], "tag string, name string")
    assert [r.tag for r in canonical.resolve(rows, empty).collect()] == ["UNMATCHED"]
    assert canonical.resolve(rows.limit(0), empty).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = _next(row, c, b, i)
    return row[-1]


def _next(row, c, b, i):
    out = [i]
    for j, d in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
    return out


def test_pigeonhole_finds_every_pair(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab1") for _ in range(rng.randrange(2, 9))) for _ in range(120)})
    left, right = words[::2], words[1::2]
    for k in (1, 2):
        got = canonical.pigeonhole(spark.createDataFrame([(w,) for w in left], "v string"), "v", spark.createDataFrame([(w,) for w in right], "r string"), "r", k)
        found = {(r.v, r.r): r.edits for r in got.collect()}
        assert found == {(a, b): d for a, b in itertools.product(left, right) if (d := levenshtein(a, b)) <= k}
