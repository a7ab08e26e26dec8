"""Expressions and operators against hand-computed values."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import confidence, extract, tags, text, vectors
from millrace.operators import documents, evidence, graph, providers, retrieval


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_confidence(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (0.5,)], "s double")
    assert df.agg(confidence.noisy_or(F.col("s"))).first()[0] == pytest.approx(0.875)
    assert df.agg(confidence.aggregate_confidence(F.col("s"))).first()[0] == 0.5
    assert df.limit(0).agg(confidence.aggregate_confidence(F.col("s"))).first()[0] == 0.0
    for age, want in ((180.0, 0.5), (-5.0, 1.0), (None, 0.5), (0.0, 1.0)):
        assert value(spark, confidence.recency(F.lit(age).cast("double"), 180.0)) == pytest.approx(want)
    assert value(spark, confidence.corroboration(F.lit(0.8), F.lit(1))) == pytest.approx(0.8)
    assert value(spark, confidence.corroboration(F.lit(0.8), F.lit(2))) == pytest.approx(0.85)
    assert [value(spark, confidence.band(F.lit(x))) for x in (0.8, 0.55, 0.1)] == ["high", "medium", "low"]


def test_tags(spark):
    want = {"P 101": "P-101", "p-101": "P-101", "P–101": "P-101", "P101": "P-101", "ISO-9001": None, "P-101A": "P-101A", "": None, "P-l0l": None, "P.101": "P-101"}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", tags.canonical_tag(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == want
    assert value(spark, tags.scan_tags(F.lit("P-101 near e-306, again p-101; ISO-9001"))) == ["P-101", "E-306"]


def test_text(spark):
    assert value(spark, text.sentences(F.lit("See No. 5 on the list. It is 3.5 bar. Done? Yes! e.g. this"))) == ["See No. 5 on the list.", "It is 3.5 bar.", "Done?", "Yes! e.g. this"]
    assert [value(spark, text.is_heading(F.lit(x))) for x in ("# A", "FINDINGS", "2.1 History", "Work done:", "The pump runs.", "", "AB")] == [True, True, True, True, False, False, False]
    assert value(spark, text.slug(F.lit(" Héat / Exchanger-2 "))) == "h_at_exchanger_2"
    assert value(spark, text.around(F.lit("a" * 100 + "leak" + "b" * 100), "leak", 5)) == "…aaaaaleakbbbbb…"
    assert value(spark, text.around(F.lit("ééé leak b"), "leak", 5)) == "ééé leak b"


def test_extract(spark):
    m = value(spark, extract.masked(F.lit("P-101A beside P-101 and P-101A")))
    assert m.text == "__TAG0__ beside __TAG1__ and __TAG0__" and value(spark, extract.unmasked(F.lit(m.text), F.array(*map(F.lit, m.tags)))) == "P-101A beside P-101 and P-101A"
    c = value(spark, extract.renumbered(F.lit("x [3] y [1] z [3] [9]"), F.lit(4)))
    assert (c.text, c.cited) == ("x [1] y [2] z [1] ", [3, 1])
    for phrase, days in (("every 2 weeks", 14), ("each month", 30), ("checked daily", 1), ("every 99 years", 3650), ("now", None)):
        assert value(spark, extract.interval_days(F.lit(phrase))) == days
    g = value(spark, extract.glyph_reading(F.lit("P-l0lA")))
    assert (g.tag, g.changes) == ("P-101A", 2)
    assert value(spark, extract.grams(F.split(F.lit("a b c"), " "), 2)) == ["a", "b", "c", "a b", "b c"]
    assert value(spark, extract.grounded(F.lit("replace the bearing"), F.lit("bearings were replaced"))) == 1.0


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.unit(a)) == [0.6, 0.8] and value(spark, vectors.unit(zero)) == [0.0, 0.0]
    assert value(spark, vectors.cosine(a, zero)) == 0.0 and value(spark, vectors.cosine(a, a)) == pytest.approx(1.0)
    assert value(spark, vectors.conformed(a, 3)) == [3.0, 4.0, 0.0] and value(spark, vectors.conformed(a, 1)) == [3.0]
    assert value(spark, vectors.quantised(a)) == [76, 102]


def test_topk_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<double>")
    r = spark.createDataFrame([(7, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [-1.0, 0.0]), (8, [1.0]), (9, None)], "id long, vector array<double>")
    got = {(x.query_id, x.rank): (x.id, x.score) for x in retrieval.topk(q, r, 4).collect()}
    assert [got[1, k] for k in (1, 2, 3, 4)] == [(5, 1.0), (7, 1.0), (8, 1.0), (9, 0.5)]
    assert [got[2, k][1] for k in (1, 2, 3, 4)] == [0.5] * 4 and got[2, 1][0] == 5
    assert retrieval.topk(q.limit(0), r, 4).count() == 0 and retrieval.topk(q, r.limit(0), 4).count() == 0


def test_fusion_edges(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.0), (1, 2, 0.5, 0.0), (2, 3, 0.0, 0.0)], "query_id long, id long, vector_score double, graph_score double")
    got = {(r.query_id, r.id): (r.fused, r.rank) for r in retrieval.fused(df).collect()}
    assert got == {(1, 1): (0.6, 1), (1, 2): (0.6, 2), (2, 3): (0.0, 1)}


def test_mmr_prefers_another_document(spark):
    rows = [(1, 1, 0, 1.0, [1.0, 0.0]), (1, 2, 0, 0.95, [1.0, 0.0]), (1, 3, 1, 0.7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id long, id long, document int, fused double, vector array<double>")
    assert [r.id for r in retrieval.mmr(df, 3).orderBy("position").collect()] == [1, 3, 2]


def test_context_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, 1, 90), (1, 2, 2, 50), (1, 3, 3, 10)], "query_id long, id long, rank long, tokens int")
    assert sorted(r.id for r in retrieval.context(df, 100).collect()) == [1, 3]
    assert sorted(r.id for r in retrieval.context(df, 5).collect()) == [1]


def test_graph_edges(spark):
    raw = spark.createDataFrame([("a", "b", "t", 0.5), ("a", "b", "t", 0.9), ("a", "a", "t", 1.0), (None, "b", "t", 1.0), ("b", "c", "t", 1.0), ("c", "a", "t", 0.1)], "source string, target string, type string, confidence double")
    edges = graph.upsert_edges(raw)
    assert sorted((r.source, r.target, r.confidence) for r in edges.collect()) == [("a", "b", 0.9), ("b", "c", 1.0), ("c", "a", 0.1)]
    seeds = spark.createDataFrame([("a",), ("unknown",)], "seed string")
    got = sorted((r.seed, r.key, r.hops, r.confidence) for r in graph.reachable(seeds, edges, 3).collect())
    assert got == [("a", "b", 1, 0.81), ("a", "c", 1, 0.09)]
    assert graph.dangling(spark.createDataFrame([("a",)], "key string"), edges).count() == 2


def test_chunks():
    assert documents.packed_chunks([], 10, 2) == []
    assert documents.packed_chunks([5, 5, 5, 5], 10, 5) == [(0, 2), (1, 3), (2, 4)]
    assert documents.packed_chunks([50, 1, 1], 10, 5) == [(0, 1), (1, 3)]
    for tokens in ([3, 1, 4, 1, 5, 9, 2, 6], [1] * 30):
        ranges = documents.packed_chunks(tokens, 10, 3)
        assert ranges[0][0] == 0 and ranges[-1][1] == len(tokens)
        assert all(c <= b and c > a for (a, b), (c, _) in zip(ranges, ranges[1:]))


def test_similarity():
    assert documents.token_set_ratio("bearing was hot", "hot bearing was") == 1.0
    assert documents.token_set_ratio("", "x") == 0.0
    assert documents.token_set_ratio("seal leak", "motor trip") < 0.5
    rng = random.Random(1)
    for _ in range(200):
        p, q = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))) for _ in range(2))
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p):
            for j, d in enumerate(q):
                best[i + 1][j + 1] = best[i][j] + 1 if c == d else max(best[i][j + 1], best[i + 1][j])
        assert documents.common_subsequence(p, q) == best[-1][-1]


def test_rules_on_a_clean_machine(spark):
    signals = spark.createDataFrame([("P-1", "a", 0.9), ("P-1", "b", 0.2), ("P-2", "b", 0.9)], "tag string, kind string, strength double")
    rules = [("both", ["a", "b"], "a > 0.5 AND b > 0.1"), ("strong_b", ["b"], "b > 0.8")]
    assert sorted((r.tag, r.rule) for r in evidence.fired(signals, rules).collect()) == [("P-1", "both"), ("P-2", "strong_b")]
    assert evidence.fired(signals.limit(0), rules).count() == 0


def test_components_against_brute_force(spark):
    import random

    rng = random.Random(8)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(90))] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.key: r.component for r in graph.components(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got == {x: find(x) for x in {k for e in edges for k in e}}
    assert graph.components(spark.createDataFrame([], "source string, target string")).count() == 0


def test_ocr_lines(spark):
    from millrace.plans.reports import ocr_lines

    words = [(1, 50.0, 10.0, 10.0, "world"), (1, 0.0, 12.0, 10.0, "hello"), (1, 0.0, 40.0, 10.0, "next")]
    df = spark.createDataFrame(words, "page long, x double, y double, height double, word string")
    assert [r.text for r in ocr_lines(df).orderBy("line").collect()] == ["hello world", "next"]


def test_kind_of_a_document_whose_keyword_comes_late(spark):
    assert value(spark, text.kind_of_document(F.lit("x" * 4500 + " an Incident"))) == "incident_report"
    assert value(spark, text.kind_of_document(F.lit("Work order " + "x" * 4500 + " near miss"))) == "incident_report"
    assert value(spark, text.kind_of_document(F.lit("x" * 4500))) == "unknown"


def test_steps_beyond_the_twentieth_and_the_hundredth(spark):
    got = value(spark, extract.steps(F.lit("\n".join(f"{k}. Open the drain valve {k}." for k in range(1, 121)))))
    assert got == [f"Open the drain valve {k}." for k in range(1, 121)]
    assert value(spark, extract.steps(F.lit("1. Open drain valve 10\n2. Open drain valve 11  "))) == ["Open drain valve 10", "Open drain valve 11"]
    assert value(spark, extract.steps(F.lit("1. Too short\n2) Open the drain valve."))) == ["Open the drain valve."]


def test_three_hops_over_a_graph_with_cycles(spark, sf_dir):
    from millrace.plans.graph import khop_supply

    got = khop_supply(spark, sf_dir).collect()
    assert {(r.hops, r.key[0]) for r in got} >= {(1, "P"), (1, "N"), (2, "R"), (2, "S"), (2, "C"), (3, "N")}
    assert len({(r.seed, r.key) for r in got}) == len(got) and all(r.seed != r.key for r in got)


def test_chunks_keep_headings_and_never_pass_the_size(spark):
    text = "FINDINGS\n\nThe seal leaks. The pump runs.\n\n" + "word " * 900 + "end.\n\n" + "x" * 30
    rows = documents.chunks(spark.createDataFrame([(1, text), (2, "a"), (3, None), (4, "\n\n")], "doc_id long, text string"), size=100, overlap=10, least=5).orderBy("doc_id", "chunk_no").collect()
    own = [r for r in rows if r.doc_id == 1]
    assert own[0].text.startswith("FINDINGS The seal leaks. The pump runs.") and all(r.tokens <= 100 for r in own)
    assert sum(r.text.count("word") for r in own) >= 900 and {r.doc_id for r in rows} == {1, 2}


def test_providers_and_limits(spark):
    docs = spark.createDataFrame([(1, "pump leak")], "doc_id long, text string")
    providers.register("absent", lambda: False, lambda d, n: d)
    providers.register("mine", lambda: True, lambda d, n: d.select("doc_id", F.array(F.lit(float(n))).alias("embedding")))
    try:
        assert providers.chosen(["absent", "none", "mine"]) == "mine" and providers.chosen(["absent"]) == "hash"
        assert providers.embedded(docs, 4, ["mine"]).first().embedding == [4.0]
        assert len(providers.embedded(docs, 4).first().embedding) == 4
    finally:
        del providers.PROVIDERS["absent"], providers.PROVIDERS["mine"]
    assert [providers.limited(spark.range(50), n, 20).count() for n in (0, 5, 99, None)] == [1, 5, 20, 20]
