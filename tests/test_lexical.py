"""The lexical search against brute force, and what of it travels."""

from collections import Counter, defaultdict
from math import log

from millrace.operators import retrieval


def brute(queries, docs, k):
    texts = defaultdict(Counter)  # rows of one id and length count as one text
    for i, text in docs:
        if text is not None:
            words = text.lower().split()
            texts[i, len(words)].update(words)
    n, df = sum(t is not None for _, t in docs), Counter(w for c in texts.values() for w in c)
    asked = defaultdict(set)
    for q, text in queries:
        asked[q].update((text or "").lower().split())
    out = []
    for q, words in asked.items():
        raw = defaultdict(float)
        for (i, length), c in texts.items():
            for w in words & c.keys():
                raw[i] += log(1 + n / (1 + df[w])) * (1 + log(c[w])) / (1 + log(1 + length))
        best = sorted((-round(r / max(raw.values()), 6), i) for i, r in raw.items())[:k]
        out += [(q, i, rank, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def found(spark, queries, docs, k=10):
    got = retrieval.tfidf(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "id long, text string"), k)
    return sorted((r.query_id, r.id, r.rank, r.score) for r in got.collect())


def test_ties_repeated_ids_and_empty_texts(spark):
    docs = [(k, "pump " + ["leak", "leak leak", "seal high", "high high high leak"][k % 4]) for k in range(60)]
    docs += [(7, "pump seal"), (7, "seal pump"), (8, "a long text about a seal and a pump"), (90, ""), (91, None), (92, " -- ")]
    queries = [(1, "pump"), (2, "Leak pump"), (2, "seal"), (3, "pump leak"), (4, ""), (5, None), (6, "absent"), (7, "a high seal")]
    assert found(spark, queries, docs, 5) == brute(queries, docs, 5)
    assert found(spark, queries, []) == found(spark, [], docs) == []


def test_pairs_of_a_common_word_never_travel(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS_A_CHUNK", 700)
    docs = [(k, f"the pump {k % 40} w{k % 900}" + " seal" * (k % 7)) for k in range(2000)]
    queries = [(k, f"the pump {k % 50} w{k}") for k in range(300)]
    before = shuffled_rows(spark)
    got = found(spark, queries, docs)
    assert shuffled_rows(spark) - before < 50_000  # 600,000 pairs of a query and a document share a word
    assert got == brute(queries, docs, 10)


def test_chain_beyond_the_row_limit_of_recursion(spark, sf_dir):
    from millrace.plans.analytics import recursive_chain

    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert sorted(r.links for r in recursive_chain(spark, sf_dir).collect()) == [1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_only_cited_documents_are_cut_into_sentences(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from millrace.plans import reports

    docs = [(20, "leak", "leak of a pump"), *[(k, None, f"a leak {'x ' * k}") for k in range(21, 25)], *[(k, None, f"uncited {k}") for k in range(30, 60)]]
    spark.createDataFrame(docs, "doc_id long, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(reports.text, "sentences", lambda c: F.when(c.startswith("uncited"), F.raise_error(F.lit("not cited"))).otherwise(F.array(c)))
    assert sorted(r["rank"] for r in reports.extractive_fallback(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_fusion_searches_once(spark, sf_dir, monkeypatch):
    from millrace.plans import answers

    searched, real = [], answers.search.lexical_tfidf_topk
    monkeypatch.setattr(answers.search, "lexical_tfidf_topk", lambda *a: searched.append(a) or real(*a))
    answers.graph_fusion(spark, sf_dir)
    assert len(searched) == 1


def test_hops_in_buckets_and_slices_give_the_best_ways(spark, monkeypatch):
    from millrace.operators import graph

    monkeypatch.setattr(graph, "WAYS_A_BUCKET", 20_000)
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 5_000)
    mid, end = range(60), range(500)
    edges = [(f"S{s}", f"M{m}", (1 + (s * m) % 50) / 50) for s in mid for m in mid] + [(f"M{m}", f"T{t}", (1 + (m + t) % 50) / 50) for m in mid for t in end]
    rows = spark.createDataFrame([(a, b, "", c) for a, b, c in edges], "source string, target string, type string, confidence double")
    got = {(r.seed, r.key): (r.hops, r.confidence) for r in graph.reachable(spark.createDataFrame([(f"S{s}",) for s in mid], "seed string"), rows, 2).collect()}
    way = {(a, b): c for a, b, c in edges}
    want = {(f"S{s}", f"M{m}"): (1, way[f"S{s}", f"M{m}"] * 0.9) for s in mid for m in mid}
    want |= {(f"S{s}", f"T{t}"): (2, max(way[f"S{s}", f"M{m}"] * way[f"M{m}", f"T{t}"] for m in mid) * 0.81) for s in mid for t in end}
    want |= {(f"S{s}", f"S{t}"): (2, max(way[f"S{s}", f"M{m}"] * way[f"S{t}", f"M{m}"] for m in mid) * 0.81) for s in mid for t in mid if s != t}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in got)


def test_common_terms_summed_once_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "RARE_ROWS", 3)
    docs = [(k, f"pump {'leak ' * (k % 3)} seal w{k % 40} v{k % 150}") for k in range(300)] + [(7, "pump seal"), (8, "w3 w3 pump leak")]
    queries = [(k, f"{['pump', 'pump leak', 'seal leak', 'w9'][k % 4]} w{k} v{k * 3}") for k in range(60)] + [(99, "v1 v2 v2 v4"), (98, "pump leak absent"), (97, "v700")]
    assert found(spark, queries, docs, 5) == brute(queries, docs, 5)


def same_as_sql(spark, folder, monkeypatch, name):
    """Rows shuffled by a query on 2,000 documents, of which 100 are asked for and share words with all: 200,000 pairs."""
    import duckdb
    from test_queries import rows

    from millrace.plans import registry

    monkeypatch.setattr(retrieval, "ROWS_A_CHUNK", 700)
    kinds = ["inspection_report", "work_order", "shift_log", "sop"]
    docs = [(k, f"the pump {k % 40} w{k % 900}" + " seal of the pump" * (k * 7 % 300), ["en", "de"][k % 3 // 2], kinds[k % 4], f"the pump {k % 50} w{k % 90}", [None, " p-1{} ".format(k % 9), ""][k % 3], f"2024-0{1 + k % 6}-1{k % 10}") for k in range(2000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, document_type string, title string, equipment_tag string, day string").selectExpr("* except (day)", "CAST(day AS date) AS document_date").coalesce(4).write.parquet(f"{folder}/documents.parquet")
    before = shuffled_rows(spark)
    df = registry.queries()[name](spark, str(folder))
    got, moved = rows(df.columns, df.collect()), shuffled_rows(spark) - before
    cursor = duckdb.connect().execute(registry.oracle_sql()[name].replace("documents", f"read_parquet('{folder}/documents.parquet/*.parquet')"))
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())
    return moved


def test_context_budget_writes_no_pairs(spark, tmp_path, monkeypatch):
    assert same_as_sql(spark, tmp_path, monkeypatch, "context_budget") < 50_000


def test_filtered_search_writes_no_pairs(spark, tmp_path, monkeypatch):
    assert same_as_sql(spark, tmp_path, monkeypatch, "filtered_search") < 50_000


def test_retrieval_merge_writes_no_pairs(spark, tmp_path, monkeypatch):
    assert same_as_sql(spark, tmp_path, monkeypatch, "retrieval_merge") < 50_000


def test_step_confidence_writes_no_pairs(spark, tmp_path, monkeypatch):
    assert same_as_sql(spark, tmp_path, monkeypatch, "step_confidence") < 50_000
