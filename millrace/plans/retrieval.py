"""Queries on vectors and ranked texts. A search asks with every row whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.confidence import recency
from millrace.functions.vectors import conformed, quantised, unit
from millrace.operators import retrieval
from millrace.session import table


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("own")), rows


def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    out = retrieval.topk(queries.select("query_id", "vector"), rows.select("id", "vector"))
    return out.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def vector_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 among the rows of the query's own label; the label is the filter and the join key."""
    queries, rows = _vectors(spark, sf_dir)
    out = retrieval.topk(queries.withColumnRenamed("own", "label"), rows, 5, by="label")
    return out.join(queries.select("query_id", F.col("own").alias("label")), "query_id").select("query_id", "id", "label", F.round("score", 6).alias("score"), "rank")


def vector_ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the inverted-list index against the exact search."""
    queries, rows = _vectors(spark, sf_dir)
    queries, rows = queries.select("query_id", "vector"), rows.select("id", "vector")
    exact = retrieval.topk(queries, rows, 10).select("query_id", "id")
    found = retrieval.ivf_topk(queries, rows, 10).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def vector_unit_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _vectors(spark, sf_dir)
    short = unit(conformed(F.col("vector"), 32))
    return rows.select("id", F.round(F.aggregate(short, F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared_norm"), F.size(conformed(F.col("vector"), 96)).cast("long").alias("dims"))


def vector_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each unit vector, and the cosine they keep with it."""
    _, rows = _vectors(spark, sf_dir)
    q = quantised(F.col("vector"))
    return rows.select("id", F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("byte_sum"), F.array_max(q).cast("long").alias("byte_max"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector scores beside a graph score: neighbours of the query's label, nearer ids first."""
    queries, rows = _vectors(spark, sf_dir)
    top = retrieval.topk(queries.select("query_id", "vector"), rows.select("id", "vector"), 24)
    own, labels = queries.select("query_id", "own"), rows.select("id", "label")
    graph = F.when(F.col("own") == F.col("label"), 1.0 / (1.0 + F.abs(F.col("id") - F.col("query_id")) / 50.0)).otherwise(0.0)
    return top.join(own, "query_id").join(labels, "id").select("query_id", "id", F.round("score", 6).alias("vector_score"), F.round(graph, 6).alias("graph_score"))


def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fused(_candidates(spark, sf_dir)).select("query_id", "id", "vector_score", "graph_score", "fused", "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.reciprocal_ranks(_candidates(spark, sf_dir), {"vector_score": 0.6, "graph_score": 0.4})
    return out.select("query_id", "id", "vector_score_rank", "graph_score_rank", "rrf")


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits and label hits as a full outer union with 0 for the missing side."""
    queries, rows = _vectors(spark, sf_dir)
    hits = retrieval.topk(queries.select("query_id", "vector"), rows.select("id", "vector"), 8).select("query_id", "id", F.round("score", 6).alias("vector_score"))
    near = queries.select("query_id", "own").join(rows.select("id", F.col("label").alias("own")), "own").where("abs(id - query_id) <= 40").select("query_id", "id", F.lit(1.0).alias("graph_score"))
    return hits.join(near, ["query_id", "id"], "full_outer").select("query_id", "id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("graph_score", F.lit(0.0)).alias("graph_score"))


def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.fused(_candidates(spark, sf_dir))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("document"))
    return retrieval.mmr(fused.select("query_id", "id", "fused").join(rows, "id").select("query_id", "id", "document", "fused", "vector"))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each query within 1,200 tokens, a passage costing 40 to 339 tokens by its id."""
    ranked = retrieval.fused(_candidates(spark, sf_dir))
    return retrieval.context(ranked.select("query_id", "id", "rank", (40 + F.pmod(F.col("id") * 37, F.lit(300))).alias("tokens")), 1200)


def recency_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency of documents against the newest one, half-life 180 days; undated 0.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "document_date")
    newest = docs.agg(F.max("document_date")).scalar()
    return docs.select("doc_id", F.round(recency(F.datediff(newest, "document_date").cast("double"), 180.0), 6).alias("recency"))


def lexical_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 20 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    return retrieval.tfidf(queries, docs.select(F.col("doc_id").alias("id"), "text"), 10).select("query_id", "id", "rank", "score")


_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_TOP = f"""
    scored AS (
      SELECT q.vec_id AS query_id, r.vec_id AS id, q.label AS own, r.label AS label,
             round(({_COS.format(a="q.embedding", b="r.embedding")} + 1) / 2, 9) AS s
      FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored)"""
_CANDIDATES = f"""
    {_TOP},
    candidates AS (
      SELECT query_id, id, round(s, 6) AS vector_score,
             round(CASE WHEN own = label THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(id - query_id) / 50.0::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS graph_score
      FROM ranked WHERE rank <= 24)"""
_FUSED = f"""
    {_CANDIDATES},
    spans AS (SELECT *, min(vector_score) OVER w AS v0, max(vector_score) OVER w AS v1, min(graph_score) OVER w AS g0, max(graph_score) OVER w AS g1
              FROM candidates WINDOW w AS (PARTITION BY query_id)),
    scaled AS (SELECT query_id, id, vector_score, graph_score,
        round(0.6::DOUBLE * (CASE WHEN v1 - v0 > 1e-12 THEN (vector_score - v0) / (v1 - v0) WHEN v1 > 1e-12 THEN 1.0 ELSE 0.0 END)
            + 0.4::DOUBLE * (CASE WHEN g1 - g0 > 1e-12 THEN (graph_score - g0) / (g1 - g0) WHEN g1 > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS fused FROM spans),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vector_score DESC, id) AS rank FROM scaled)"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_exact, vector_filtered_topk, vector_ann_recall, vector_unit_norm, vector_quantise, minmax_fusion, rrf_fusion, candidate_union, mmr_rerank, context_pack, recency_half_life, lexical_tfidf_topk,
    )
}
SQL = {
    "vector_topk_exact": f"WITH {_TOP} SELECT query_id, id, rank, round(s, 6) AS score FROM ranked WHERE rank <= 24",
    "vector_unit_norm": """
        WITH v AS (SELECT vec_id AS id, list_concat(CAST(embedding AS DOUBLE[]), list_resize(CAST([] AS DOUBLE[]), 96, 0.0::DOUBLE)) AS e FROM embeddings), s AS (SELECT id, list_sum(list_transform(e[1:32], lambda x: x * x)) AS n, len(e[1:96]) AS d FROM v)
        SELECT id, round(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS squared_norm, d AS dims FROM s""",
    "vector_quantise": """
        WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
        q AS (SELECT id, list_transform(e, lambda x: CAST(round_even(x / n * 127, 0) AS BIGINT)) AS q FROM n)
        SELECT id, CAST(list_sum(q) AS BIGINT) AS byte_sum, list_max(q) AS byte_max FROM q""",
    "vector_filtered_topk": f"""
        WITH {_TOP}, own_label AS (SELECT query_id, id, label, s, round(s, 6) AS score FROM scored WHERE own = label),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM own_label)
        SELECT query_id, id, label, score, rank FROM k WHERE rank <= 5""",
    "minmax_fusion": f"WITH {_FUSED} SELECT query_id, id, vector_score, graph_score, fused, rank FROM fused WHERE fused >= 0.15 OR rank = 1",
    "rrf_fusion": f"""
        WITH {_CANDIDATES}, ranks AS (
          SELECT query_id, id, CASE WHEN vector_score > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, id) END AS vector_score_rank,
                 CASE WHEN graph_score > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, id) END AS graph_score_rank FROM candidates),
        raw AS (SELECT *, coalesce(0.6::DOUBLE / (60 + vector_score_rank), 0) + coalesce(0.4::DOUBLE / (60 + graph_score_rank), 0) AS r FROM ranks)
        SELECT query_id, id, vector_score_rank, graph_score_rank, round(r / max(r) OVER (PARTITION BY query_id), 6) AS rrf FROM raw""",
    "candidate_union": f"""
        WITH {_TOP}, hits AS (SELECT query_id, id, round(s, 6) AS vector_score FROM ranked WHERE rank <= 8),
        near AS (SELECT query_id, id, 1.0::DOUBLE AS graph_score FROM scored WHERE own = label AND abs(id - query_id) <= 40)
        SELECT query_id, id, coalesce(vector_score, 0) AS vector_score, coalesce(graph_score, 0) AS graph_score FROM hits FULL OUTER JOIN near USING (query_id, id)""",
    "context_pack": f"""
        WITH RECURSIVE {_FUSED}, it AS (SELECT query_id, id, rank, 40 + (id * 37) % 300 AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM fused WHERE fused >= 0.15 OR rank = 1),
        go AS (SELECT query_id, id, rank, tokens, k, tokens AS used, TRUE AS taken FROM it WHERE k = 1
          UNION ALL SELECT it.query_id, it.id, it.rank, it.tokens, it.k, go.used + CASE WHEN go.used + it.tokens <= 1200 THEN it.tokens ELSE 0 END, go.used + it.tokens <= 1200 FROM go JOIN it ON it.query_id = go.query_id AND it.k = go.k + 1)
        SELECT query_id, rank, id, tokens FROM go WHERE taken""",
    "recency_half_life": """
        SELECT doc_id, round(CASE WHEN document_date IS NULL THEN 0.5::DOUBLE ELSE pow(2.0::DOUBLE, -greatest(date_diff('day', document_date, (SELECT max(document_date) FROM documents)), 0) / 180.0::DOUBLE) END, 6) AS recency FROM documents""",
    "lexical_tfidf_topk": """
        WITH tokens AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 0) AS terms FROM documents WHERE text IS NOT NULL),
        n AS (SELECT count(*) AS n FROM tokens),
        e AS (SELECT id, len(terms) AS length, unnest(terms) AS term FROM tokens),
        c AS (SELECT id, length, term, count(*) AS tf FROM e GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        q AS (SELECT DISTINCT query_id, term FROM (SELECT doc_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda t: length(t) > 0)) AS term
              FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL)),
        s AS (SELECT query_id, id, sum(ln(1 + n.n / (1 + df)::DOUBLE) * (1 + ln(tf::DOUBLE)) / (1 + ln(1.0::DOUBLE + length))) AS raw
              FROM q JOIN c USING (term) JOIN df USING (term), n GROUP BY query_id, id),
        p AS (SELECT query_id, id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p)
        SELECT query_id, id, rank, score FROM r WHERE rank <= 10""",
}
