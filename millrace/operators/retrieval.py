"""Vector search, lexical search, score fusion, diversity and packing."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.session import checkpointed, spread

ROWS_A_CHUNK, QUERIES_A_BLOCK, ROWS_A_LIST, LEXICAL_BLOCK, RARE_ROWS = 20_000, 1_000, 5_000, 50_000, 100


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column.to_pylist()):
        v = [x or 0.0 for x in v or []][:width]
        out[k, : len(v)] = v
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def _best(k: int):
    """The k best rows of each query of one group of queries and rows, by one matrix product."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if len(a) and len(b):
            width = max(max((len(v) for v in a["vector"].to_pylist() if v), default=1), max((len(v) for v in b["vector"].to_pylist() if v), default=1))
            score = (_matrix(a["vector"], width) @ _matrix(b["vector"], width).T + 1) / 2
            ids, names = b["id"].to_numpy(), a["query_id"].to_numpy()
            for i, row in enumerate(np.round(score, 9)):
                top = np.lexsort((ids, -row))[:k]
                out["query_id"] += [int(names[i])] * len(top)
                out["id"] += ids[top].tolist()
                out["score"] += row[top].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return best


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def topk(queries: DataFrame, rows: DataFrame, k: int = 24, by: str | None = None) -> DataFrame:
    """(query_id, id, score): the k rows of highest (cosine + 1) / 2 for each query, ties by id.

    Exact: blocks of queries meet chunks of rows, each pair one matrix product of which only
    k rows per query leave. queries: query_id, vector; rows: id, vector; by: a column of both
    that must agree, of whose values each is cut into blocks and chunks as well. A null, zero
    or mismatched vector has cosine 0 or is padded; empty sides give no rows.
    """
    n, q = rows.count(), queries.count()
    chunks, blocks = F.lit(max(1, -(-n // ROWS_A_CHUNK))), F.lit(max(1, -(-q // QUERIES_A_BLOCK)))
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)))
    right = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    keys = ["chunk", "block", *([by] if by else [])]
    left, right = left.select("query_id", "vector", *keys), right.select("id", "vector", *[F.col(c).alias(f"_{c}") for c in keys])
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInArrow(_best(k), "query_id long, id long, score double")
    return _ranked(pairs, k)


def ivf_topk(queries: DataFrame, rows: DataFrame, k: int = 24, probed: float = 0.75, sample: int = 10_000, seed: int = 7) -> DataFrame:
    """Approximate :func:`topk`: centres fitted on at most ``sample`` rows, every row indexed.

    The number of lists grows with the rows (one for ROWS_A_LIST, at least 16, at most a
    tenth of the sample). ``probed`` is the share of lists that a query looks into, which sets
    recall against work. A long list is cut into chunks; k rows a query leave each of them.
    """
    total = max(1, rows.count())
    picked = rows.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("id", F.lit(seed))).limit(sample) if total > sample else rows.where(F.col("vector").isNotNull())
    vectors = picked.select("vector").toPandas()["vector"]
    if not len(vectors):
        return topk(queries, rows, k)
    x = np.array([np.asarray(v, float) for v in vectors])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    lists = max(16, min(total // ROWS_A_LIST, sample // 10))
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(12):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    probes = max(1, round(probed * len(centres)))

    def nearest(n: int):
        @F.pandas_udf("array<int>")
        def find(v: pd.Series) -> pd.Series:
            m = np.zeros((len(v), centres.shape[1]))
            for i, a in enumerate(v):
                if a is not None:
                    m[i] = a
            return pd.Series(list(np.argsort(-(m @ centres.T), axis=1)[:, :n].astype("int32")))

        return find

    cuts = F.lit(max(1, -(-total // (ROWS_A_CHUNK * len(centres)))) * 2)
    blocks = F.lit(max(1, -(-queries.count() // QUERIES_A_BLOCK)))
    left = queries.select("query_id", "vector", F.explode(nearest(probes)("vector")).alias("list"), F.pmod(F.xxhash64("query_id"), blocks).alias("block"))
    left = left.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), cuts.cast("long") - 1)))
    right = rows.select("id", "vector", F.element_at(nearest(1)("vector"), 1).alias("_list"), F.pmod(F.xxhash64("id"), cuts).alias("_cut"), F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("_block"))
    pairs = left.groupBy("list", "cut", "block").cogroup(right.groupBy("_list", "_cut", "_block")).applyInArrow(_best(k), "query_id long, id long, score double")
    return _ranked(pairs, k)


def conditions(wanted: dict) -> Column:
    """A filter from column -> value (equal), list (one of) or pair (from, to; None is open). All must hold; null never does."""
    out = F.lit(True)
    for name, value in wanted.items():
        if isinstance(value, tuple):
            low, high = value
            out = out & (F.col(name) >= F.lit(low) if low is not None else F.lit(True)) & (F.col(name) <= F.lit(high) if high is not None else F.lit(True)) & F.col(name).isNotNull()
        else:
            out = out & (F.col(name).isin(value) if isinstance(value, list) else F.col(name) == F.lit(value))
    return out


def minmax(score: str, query: str):
    """A score scaled to [0, 1] within its query; without spread 1 if it fired at all, else 0."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low > 1e-12, (F.col(score) - low) / (high - low)).otherwise(F.when(high > 1e-12, 1.0).otherwise(0.0))


def fused(candidates: DataFrame, vector_weight: float = 0.6, graph_weight: float = 0.4, floor: float = 0.15) -> DataFrame:
    """Weighted fusion of vector and graph scores per query, with ranks, floor and the best kept."""
    scaled = candidates.withColumns({"v": minmax("vector_score", "query_id"), "g": minmax("graph_score", "query_id")})
    scaled = scaled.withColumn("fused", F.round(vector_weight * F.col("v") + graph_weight * F.col("g"), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("vector_score"), "id")
    ranked = scaled.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where((F.col("fused") >= floor) | (F.col("rank") == 1)).drop("v", "g")


def reciprocal_ranks(candidates: DataFrame, weights: dict[str, float], constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion; a family with score 0 gives no rank; scaled by the best."""
    out, total = candidates, F.lit(0.0)
    for name, weight in weights.items():
        w = Window.partitionBy("query_id").orderBy(F.desc(name), "id")
        rank = F.when(F.col(name) > 0, F.row_number().over(w).cast("long"))
        out = out.withColumn(f"{name}_rank", rank)
        total = total + F.coalesce(F.lit(weight) / (constant + F.col(f"{name}_rank")), F.lit(0.0))
    out = out.withColumn("raw", total)
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return out.withColumn("rrf", F.round(F.when(best > 0, F.col("raw") / best).otherwise(0.0), 6)).drop("raw")


def mmr(candidates: DataFrame, k: int = 10, weight: float = 0.72, same_document: float = 0.5) -> DataFrame:
    """Greedy diversity per query. candidates: query_id, id, document, fused, vector."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fused", "id"], ascending=[False, True], ignore_index=True)
        x = np.array([np.asarray(v, float) for v in frame["vector"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        score, document = frame["fused"].to_numpy(), frame["document"].to_numpy()
        penalty, left, chosen = np.full(len(frame), -np.inf), np.ones(len(frame), bool), []
        at = 0
        while len(chosen) < min(k, len(frame)):
            chosen.append((at, max(penalty[at], 0.0)))
            left[at] = False
            penalty = np.maximum(penalty, np.maximum(np.clip(x @ x[at], 0, 1), np.where(document == document[at], same_document, 0.0)))
            value = np.where(left, weight * score - (1 - weight) * penalty, -np.inf)
            at = int(np.argmax(value))
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "position": range(1, len(chosen) + 1), "id": frame["id"].iloc[[a for a, _ in chosen]].to_numpy(), "penalty": [round(p, 6) for _, p in chosen]})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, position long, id long, penalty double")


def context(passages: DataFrame, budget: int = 6000) -> DataFrame:
    """Passages in rank order within a token budget: one that does not fit is skipped, the first always kept.

    passages: query_id, id, rank, tokens. Ranks are few per query, so each query's list is small.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "tokens")))
    grouped = passages.groupBy("query_id").agg(items.alias("items"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:long,id:long,tokens:long>>").alias("kept"))

    def step(state, item):
        fits = (F.size(state["kept"]) == 0) | (state["used"] + item["tokens"] <= budget)
        kept = F.when(fits, F.concat(state["kept"], F.array(F.struct(item["rank"].cast("long").alias("rank"), item["id"].cast("long").alias("id"), item["tokens"].cast("long").alias("tokens"))))).otherwise(state["kept"])
        return F.struct(F.when(fits, state["used"] + item["tokens"].cast("long")).otherwise(state["used"]).alias("used"), kept.alias("kept"))

    packed = grouped.select("query_id", F.explode(F.aggregate("items", empty, step)["kept"]).alias("p"))
    return packed.select("query_id", "p.rank", "p.id", "p.tokens")


def _least(rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of rows in ascending order with equal scores the k first, best scores first."""
    order = np.lexsort((rows, -score))
    starts = np.flatnonzero(np.diff(score[order], prepend=np.inf))
    return rows[order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < k]]


def _lexical(k: int, most: int, names: tuple[pa.DataType, pa.DataType]):
    """The best documents of each query of a block in one chunk of documents: never fewer than can be among the k best of all.

    queries: query, terms, idf; docs: id, words. Terms of more than RARE_ROWS documents are summed
    once for all queries that share them, of which only the best documents go on; to these come
    the documents of a query's rare terms. Kept is what lies at most one step of the rounded score
    below the k-th best, and of equal scores the k least ids. most: rows of one id, at most.
    """

    def best(queries: pa.Table, docs: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        ids = docs["id"].combine_chunks() if len(docs) else pa.array([], names[1])
        if len(queries) and len(docs):
            order = pc.sort_indices(ids)  # nulls last
            ids = ids.take(order)
            lists = pc.split_pattern(docs["words"].combine_chunks().take(order), " ")
            asked = pc.list_flatten(queries["terms"].combine_chunks())
            vocabulary = pc.unique(asked)
            code = pc.index_in(asked, vocabulary).to_numpy(zero_copy_only=False)
            idf = np.zeros(len(vocabulary))
            idf[code] = pc.list_flatten(queries["idf"].combine_chunks()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(queries["terms"].combine_chunks()).to_numpy(zero_copy_only=False))

            one = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.flatnonzero(np.diff(one, prepend=-1))
            flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            length = np.bincount(parents[real], minlength=len(ids))
            term = pc.index_in(flat, vocabulary)
            hit = pc.is_valid(term).to_numpy(zero_copy_only=False) & real
            term = pc.fill_null(term, 0).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
            # Rows of one id and one length count as one text, and an id has the sum of its texts.
            texts, text = np.unique(np.stack([one, length]), axis=1, return_inverse=True) if len(first) < len(ids) else (np.stack([one, length]), np.arange(len(ids)))
            n = texts.shape[1]
            pairs, tf = np.unique(term * n + text.reshape(-1)[parents[hit]], return_counts=True)
            term, text = np.divmod(pairs, n)
            value = idf[term] * (1 + np.log(tf)) / (1 + np.log(1.0 + texts[1][text]))
            doc = texts[0][text]
            if n > len(first):
                pairs, back = np.unique(term * len(first) + doc, return_inverse=True)
                value = np.bincount(back.reshape(-1), value)
                term, doc = np.divmod(pairs, len(first))
            bounds = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            held = np.diff(bounds)
            alike: dict[bytes, list[tuple[int, np.ndarray, float]]] = defaultdict(list)
            for q, end in enumerate(ends):
                terms = code[ends[q - 1] if q else 0 : end]
                step = 1.5e-6 * most * idf[terms].sum()  # no score is above the sum of idf for each text of an id
                terms = terms[held[terms] > 0]
                if len(terms):
                    few = held[terms] <= RARE_ROWS
                    alike[np.sort(terms[~few]).tobytes()].append((q, terms[few], step))

            score = np.zeros(len(first))
            for common, own_queries in alike.items():
                score[:] = 0
                for t in np.frombuffer(common, code.dtype):
                    score[doc[bounds[t] : bounds[t + 1]]] += value[bounds[t] : bounds[t + 1]]
                base = np.flatnonzero(score)
                if len(base) > k:  # rare terms only add, so what lies lower by the common terms alone is not among the best
                    base = base[score[base] >= np.partition(score[base], -k)[-k] - max(step for _, _, step in own_queries)]
                    base = np.sort(_least(base, score[base], k + max(int(held[few].sum()) for _, few, _ in own_queries)))
                for q, few, step in own_queries:
                    met = base
                    if len(few):
                        parts = [slice(bounds[t], bounds[t + 1]) for t in few]
                        met = np.unique(np.concatenate([base, *(doc[x] for x in parts)]))
                    own = score[met]
                    if len(few):
                        for x in parts:
                            own[np.searchsorted(met, doc[x])] += value[x]
                    if len(met) > k:
                        near = own >= np.partition(own, -k)[-k] - step
                        met, own = met[near], own[near]
                        if len(met) > k:
                            order = _least(np.arange(len(met)), own, k)
                            met, own = met[order], own[order]
                    found.append((q, first[met], own))
        rows = np.concatenate([np.full(len(d), q) for q, d, _ in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([d for _, d, _ in found]) if found else np.zeros(0, np.int64)
        raw = np.concatenate([r for _, _, r in found]) if found else np.zeros(0)
        query = queries["query"].combine_chunks().take(pa.array(rows)) if len(rows) else pa.array([], names[0])
        return pa.table({"query": query, "id": ids.take(pa.array(place)), "raw": pa.array(raw)})

    return best


def tfidf(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank) by the peak-scaled sum of idf * (1 + ln tf) / (1 + ln(1 + length)).

    queries: query_id, text; docs: id, text. Terms are runs of letters and digits, lower case.
    Exact: blocks of queries meet chunks of documents, of which only what can be among the k
    best of a query leaves a task, so that no table of pairs is written. Queries of the same
    terms are one. A chunk is shuffled once for each block of LEXICAL_BLOCK queries.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", " "))
    terms = lambda c: F.array_remove(F.split(F.col(c), " "), "")
    docs = docs.where(F.col("text").isNotNull()).select("id", "text")
    total, most = docs.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    words = spread(docs).select("id", plain("text").alias("words"))
    held = words.select("id", terms("words").alias("terms")).select("id", F.size("terms").alias("length"), F.explode(F.array_distinct("terms")).alias("term"))
    df = (held.distinct() if most > 1 else held).groupBy("term").agg(F.count("*").alias("df"))

    wanted = queries.select("query_id", plain("text").alias("words")).select("query_id", F.explode(terms("words")).alias("term")).distinct()
    asked = checkpointed(wanted.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms")))
    once = asked.groupBy("terms").agg(F.min("query_id").alias("query"))
    idf = F.log(1 + F.lit(total) / (1 + F.col("df")))
    known = once.select("query", F.explode("terms").alias("term")).join(df, "term").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("t"))
    known = checkpointed(known.select("query", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")))

    chunks, blocks = F.lit(max(1, -(-total // ROWS_A_CHUNK))), F.lit(max(1, -(-known.count() // LEXICAL_BLOCK)))
    left = known.withColumn("block", F.pmod(F.xxhash64("query"), blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)))
    right = words.withColumn("_chunk", F.pmod(F.xxhash64("id"), chunks)).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    left, right = left.select("query", "terms", "idf", "chunk", "block"), right.select("id", "words", "_chunk", "_block")
    kinds = [left.schema["query"].dataType, right.schema["id"].dataType]
    pairs = left.groupBy("chunk", "block").cogroup(right.groupBy("_chunk", "_block")).applyInArrow(_lexical(k, most, tuple(map(to_arrow_type, kinds))), f"query {kinds[0].simpleString()}, id {kinds[1].simpleString()}, raw double")
    scored = pairs.withColumn("score", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy("query")), 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("raw")
    return asked.join(once, "terms").select("query_id", "query").join(ranked, "query").select("query_id", "id", "score", "rank")
