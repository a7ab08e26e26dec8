"""Property graph on tables: nodes(key, label, ...), edges(source, target, type, confidence, ...)."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed

from millrace.functions.confidence import corroboration

DECAY = 0.9
SEEDS_A_GROUP, PAIRS_A_BLOCK, WAYS_A_BUCKET, WAYS_A_TASK, EDGES_AT_ONCE, PAIRS_AT_ONCE = 300, 8_000_000, 3_000_000, 50_000, 1_000_000, 250_000


def upsert_nodes(mentions: DataFrame) -> DataFrame:
    """One row per node key: latest non-null properties, all surface forms, best confidence.

    mentions: key, label, surface, confidence, seen_at. Null keys make no node.
    """
    return mentions.where("key IS NOT NULL").groupBy("key").agg(
        F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("seen_at", "label"))).alias("label"), F.array_sort(F.collect_set("surface")).alias("surfaces"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions")
    )


def upsert_edges(raw: DataFrame) -> DataFrame:
    """One row per (source, target, type) with the best confidence; no self-loops, no null ends."""
    return raw.where("source <> target").groupBy("source", "target", "type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("evidence"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys at the ends of edges without a node, each once."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("key")).distinct()
    return ends.join(nodes.select("key"), "key", "left_anti")


def repaired_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (key, label) and one labelled unknown for each end of an edge that has none."""
    return nodes.select("key", "label").unionByName(dangling(nodes, edges).select("key", F.lit("unknown").alias("label")))


def resolved(mentions: DataFrame) -> DataFrame:
    """Entities by canonical name: weakest match score raised by further documents.

    mentions: name, confidence, document. The name is trimmed, upper-cased, white space single.
    """
    key = F.upper(F.trim(F.regexp_replace("name", r"\s+", " ")))
    grouped = mentions.groupBy(key.alias("key")).agg(F.min("confidence").alias("weakest"), F.max("confidence").alias("best"), F.count_distinct("document").alias("documents"), F.count_distinct("name").alias("surfaces"))
    return grouped.withColumn("confidence", F.round(corroboration(F.col("best"), F.col("documents")) * F.col("weakest"), 6))


def remapped(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with both ends rewritten by keys(old, new); loops dropped, best confidence kept."""
    out = edges.join(keys.select(F.col("old").alias("source"), F.col("new").alias("s")), "source", "left").join(keys.select(F.col("old").alias("target"), F.col("new").alias("t")), "target", "left")
    out = out.withColumns({"source": F.coalesce("s", "source"), "target": F.coalesce("t", "target")}).drop("s", "t")
    return upsert_edges(out)


def both_ways(edges: DataFrame) -> DataFrame:
    flipped = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "type", "confidence")
    return edges.select("source", "target", "type", "confidence").unionByName(flipped)


def centrality(edges: DataFrame) -> DataFrame:
    """(key, degree, centrality): ln(1 + degree) over that of the largest degree, 6 places."""
    degree = edges.select(F.explode(F.array("source", "target")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    top = degree.agg(F.max("degree").cast("double")).scalar()
    return degree.withColumn("centrality", F.round(F.log1p(F.col("degree").cast("double")) / F.log1p(top), 6))


def _file(columns: dict, **kind) -> bytes:
    sink = pa.BufferOutputStream()
    pq.write_table(pa.table(columns), sink, compression="zstd", write_statistics=False, **kind)
    return sink.getvalue().to_pybytes()


def _packed(codes: dict[str, np.ndarray], values: dict[str, pa.Array], confidence: np.ndarray) -> bytes:
    """Columns of codes for ``values``, and confidences, as compressed Parquet within an Arrow stream.

    The rows are sorted by the last column, then by those before, so that codes differ little from
    row to row. Values are in order, those without a code are left out.
    """
    out, kept = {}, []
    for name, own in codes.items():
        used = np.zeros(len(values[name]), bool)
        used[own] = True
        some = values[name].filter(pa.array(used))
        order = pc.sort_indices(some).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        out[name] = rank[(np.cumsum(used) - 1)[own]]
        kept.append(_file({name: some.take(pa.array(order))}, use_dictionary=False, column_encoding="DELTA_BYTE_ARRAY"))
    order = np.lexsort(list(out.values()))
    rows = _file({name: own[order] for name, own in out.items()} | {"confidence": confidence[order]}, use_dictionary=["confidence"], column_encoding=dict.fromkeys(out, "DELTA_BINARY_PACKED"))
    batch, sink = pa.record_batch({"part": pa.array([rows, *kept], pa.binary())}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _parts(blob) -> list[pa.Buffer]:
    return [part.as_buffer() for part in pa.ipc.open_stream(blob).read_all().column("part")]


def _rows(part: pa.Buffer) -> list[np.ndarray]:
    return [column.to_numpy() for column in pq.ParquetFile(pa.BufferReader(part)).read(use_threads=False).columns]


def _values(part: pa.Buffer) -> pa.ChunkedArray:
    return pq.ParquetFile(pa.BufferReader(part)).read(use_threads=False).column(0)


def _cut(codes: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    return np.split(codes, np.cumsum(lengths)[:-1])


def _unpacked_ways(blobs: list) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Source codes and values, target codes and values, confidences over all ``blobs``; each way once, with its best."""
    blobs = [_parts(blob) for blob in blobs]
    rows, coded = [_rows(parts[0]) for parts in blobs], []
    for k in (0, 1):
        own = [_values(parts[k + 1]) for parts in blobs]
        codes, values = _encoded(pa.chunked_array([chunk for x in own for chunk in x.chunks], pa.string()))
        coded.append((np.concatenate([place[x[k]] for place, x in zip(_cut(codes, [len(x) for x in own]), rows)]), values))
    (source, sources), (target, targets) = coded
    c = np.concatenate([x[2] for x in rows])
    if len(blobs) > 1:
        pair, c = _best_of_pairs(target.astype(np.int64) * len(sources) + source, c)
        target = pair // len(sources)
        source = pair - target * len(sources)
    return source, sources, target, targets, c


def _places_in(own: pa.Array | pa.ChunkedArray, values: pa.Array) -> np.ndarray:
    return pc.index_in(own, values).fill_null(-1).to_numpy()


def _encoded(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode("encode")
    return coded.indices.to_numpy(), coded.dictionary


def _best_of_pairs(pair: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pair, kind="stable")
    pair, value = pair[order], value[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], np.maximum.reduceat(value, first) if len(first) else value


def _dealt_ways(batches, at_once: int):
    """(bucket, blob): both ways of edges (source, target, confidence, and the buckets a, b of the ends) by the bucket of the target."""
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if not n or (batch is not None and n < at_once):
            continue
        rows = pa.Table.from_batches(held)
        ends, keys = _encoded(pa.chunked_array([*rows["source"].chunks, *rows["target"].chunks]))
        bucket_of = np.zeros(len(keys), np.int64)
        bucket_of[ends] = np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()])
        pair, c = _best_of_pairs(np.concatenate([ends[n:], ends[:n]]).astype(np.int64) * len(keys) + ends, np.tile(rows["confidence"].to_numpy(), 2))
        target = pair // len(keys)
        source = pair - target * len(keys)
        bucket = bucket_of[target]
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket[part[0]]], pa.int32()), "blob": pa.array([_packed({"source": source[part], "target": target[part]}, {"source": keys, "target": keys}, c[part])], pa.binary())})
        held, n = [], 0


def _best_ways(front: tuple, known: tuple, bounds: np.ndarray, target: np.ndarray, c: np.ndarray, n: int, at_once: int):
    """Arrays of seed, target and confidence: the best way of each pair that the rows of ``front`` reach anew.

    front: seed, source and weight of each row; known: seed and target of pairs not to give;
    ways bounds[k] to bounds[k + 1] lead from source k to ``target`` with ``c``. n: number of targets.
    """
    seed, at, weight = front
    narrow = np.uint16 if max(seed.max(initial=0), known[0].max(initial=0)) < 1 << 16 else np.int64  # sorted in one pass
    order = np.argsort(seed.astype(narrow), kind="stable")
    order = order[bounds[at[order] + 1] > bounds[at[order]]]
    seed, at, weight = seed[order], at[order], weight[order]
    order = np.argsort(known[0].astype(narrow), kind="stable")
    known_seed, known_key = known[0][order], known[1][order]
    ways = bounds[at + 1] - bounds[at]
    total = np.cumsum(ways)
    # Whole seeds at a time, as many as make ``at_once`` pairs, one at least.
    last = np.flatnonzero(np.diff(seed, append=-1)) + 1
    tame = max(np.abs(c).max(initial=0), np.abs(weight).max(initial=0)) < 1e100
    start = 0
    while start < len(seed):
        done = total[start - 1] if start else 0
        stop = int(last[max(np.searchsorted(total[last - 1], done + at_once, side="right") - 1, np.searchsorted(last, start, side="right"))])
        part, low, m = slice(start, stop), seed[start], int(total[stop - 1] - done)
        way = np.arange(m) + np.repeat(bounds[at[part]] - (total[part] - ways[part] - done), ways[part])
        pair = np.repeat((seed[part] - low).astype(np.int64) * n, ways[part]) + target[way]
        value = np.repeat(weight[part], ways[part]) * c[way]
        a, b = np.searchsorted(known_seed, [low, seed[stop - 1] + 1])
        old, room = (known_seed[a:b] - low).astype(np.int64) * n + known_key[a:b], int(seed[stop - 1] - low + 1) * n
        if tame and room <= 4 * m:
            best = np.full(room, -np.inf)
            np.maximum.at(best, pair, value)
            best[old] = -np.inf
            pair = np.flatnonzero(best > -np.inf)
            value = best[pair]
        else:
            pair, value = _best_of_pairs(pair, value)
            new = ~np.isin(pair, old)
            pair, value = pair[new], value[new]
        of = pair // n
        yield of + low, pair - of * n, value * DECAY
        start = stop


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero, as Spark's round gives them: those close to a half by their decimal digits."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * 1e6
        out = np.floor(scaled + 0.5) / 1e6
        hard = np.flatnonzero(~((np.abs(scaled - np.floor(scaled) - 0.5) > 1e-3) & (x >= 0) & (x < 1e6)))
    if len(hard):
        values, at = np.unique(x[hard], return_inverse=True)
        out[hard] = np.array([float(Decimal(repr(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP, Context(prec=400))) + 0.0 if math.isfinite(v) else v for v in values.tolist()])[at]
    return out


def _hops(batches, hops: range, kept: tuple[int, ...], at_once: int):
    """The pairs that blocks of seeds reach anew at ``hops`` in buckets of keys.

    As rows (seed, key, hops, confidence); or, if any are ``kept``, as (hop, seeds, pairs, blob): pairs
    that lead on if that is a hop, and the ways of each bucket put together if -1. Rows in: (hop,
    seeds, blob): ways as hop -1 with the bucket for seeds, frontiers by their hop and group of seeds.
    """
    ways, fronts = defaultdict(list), defaultdict(list)
    for batch in batches:
        for hop, group, blob in zip(batch["hop"].to_pylist(), batch["seeds"].to_pylist(), batch["blob"]):
            if hop < 0:
                ways[group].append(blob.as_buffer())
            else:
                fronts[group, hop].append(_parts(blob.as_buffer()))
    row = lambda hop, of, n, blob: pa.RecordBatch.from_pydict({"hop": pa.array([hop], pa.int32()), "seeds": pa.array([of], pa.int32()), "pairs": pa.array([n], pa.int64()), "blob": pa.array([blob], pa.binary())})
    order = sorted(fronts)
    keys = [_values(parts[2]) for k in order for parts in fronts[k]]
    lengths, keys = [len(x) for x in keys], pa.chunked_array([chunk for x in keys for chunk in x.chunks], pa.string())
    for bucket in sorted(ways):
        source, sources, target, targets, c = _unpacked_ways(ways.pop(bucket))
        if -1 in kept:
            yield row(-1, bucket, len(c), _packed({"source": source, "target": target}, {"source": sources, "target": targets}, c))
        if kept:
            on = (np.bincount(target, minlength=len(targets)) > 1) & targets.is_valid().to_numpy(zero_copy_only=False)
            source, target, c = source[on[target]], target[on[target]], c[on[target]]
        by = np.argsort(source, kind="stable")
        target, c = target[by].astype(np.int32), c[by]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(sources)))])
        del source, by
        pa.default_memory_pool().release_unused()
        at, to = (iter(_cut(_places_in(keys, values), lengths)) for values in (sources, targets))
        for group, of in itertools.groupby(order, key=lambda k: k[0]):
            seeds, front, known = None, {}, defaultdict(list)
            for _, hop in of:
                own = []
                for parts in fronts[group, hop]:
                    names = _values(parts[1]).combine_chunks()
                    seeds = names if seeds is None else seeds
                    seed, key, weight = _rows(parts[0])
                    own.append((_places_in(names, seeds)[seed], next(at)[key], next(to)[key], weight))
                seed, source_at, place, weight = (np.concatenate(x) for x in zip(*own))
                del own
                some = source_at >= 0
                front[hop + 1] = seed[some], source_at[some], weight[some]
                # A key is met again at most two hops after it was reached.
                for later in (hop + 1, hop + 2):
                    known[later].append((seed[place >= 0], place[place >= 0]))
            for hop in hops:
                if hop not in front:
                    continue
                old = tuple(np.concatenate(x) for x in zip(*known[hop]))
                found = _best_ways(front.pop(hop), old, bounds, target, c, len(targets), at_once)
                if not kept:
                    for seed, key, confidence in found:
                        if len(seed):
                            yield pa.RecordBatch.from_arrays([seeds.take(pa.array(seed)), targets.take(pa.array(key)), pa.array(np.full(len(seed), hop, np.int32)), pa.array(_rounded(confidence))], ["seed", "key", "hops", "confidence"])
                elif (found := list(found)) and (n := sum(len(x) for x, _, _ in found)):
                    seed, key, confidence = (np.concatenate(x) for x in zip(*found))
                    yield row(hop, group, n, _packed({"seed": seed, "key": key}, {"seed": seeds, "key": targets}, confidence))


def _packed_seeds(rows: pa.Table) -> pa.Table:
    codes, values = _encoded(rows["seed"])
    blob = _packed({"seed": codes, "key": codes}, {"seed": values, "key": values}, np.ones(len(codes)))
    return pa.table({"hop": pa.array([0], pa.int32()), "seeds": rows["seeds"][:1].combine_chunks(), "pairs": pa.array([len(codes)], pa.int64()), "blob": pa.array([blob], pa.binary())})


def reachable(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, key, hops, confidence): the best way from each seed to every key within ``hops``.

    Best is fewest hops, then highest product of edge confidence times DECAY per hop. Keys
    already reached are left out, so hubs do not multiply paths. Blocks of seeds meet buckets
    of the ways by their target, so that pairs are made and reduced within a task. Ways, and of
    each hop but the last the pairs that lead on, are written as compressed columns; a key with a
    single way leads only back and is not among them. The pairs themselves are made once,
    for the result, and written nowhere else. seeds: seed, keys: strings. Undirected; seeds
    reach not themselves.
    """
    edges = edges.where("(source IS NOT NULL OR target IS NOT NULL) AND confidence IS NOT NULL")
    seeds = checkpointed(seeds.where("seed IS NOT NULL").distinct())
    ways, cores, at_once = 2 * edges.count(), edges.sparkSession.sparkContext.defaultParallelism, PAIRS_AT_ONCE
    buckets = max(1, -(-ways // WAYS_A_BUCKET), min(2 * cores, -(-ways // WAYS_A_TASK)))
    groups = max(1, -(-seeds.count() // SEEDS_A_GROUP))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n, step: F.explode(F.sequence(F.lit(0), F.lit((n - 1) * step), F.lit(step)))
    schema = "hop int, seeds int, pairs long, blob binary"

    def met(rows: DataFrame, last: range, kept: tuple[int, ...], schema: str) -> DataFrame:
        """Each block of seeds and all buckets of ways once in the tasks of that block."""
        pairs = rows.where("hop >= 0").agg(F.sum("pairs")).first()[0] or 0
        blocks = min(groups, max(1, -(-pairs // PAIRS_A_BLOCK)))
        parts = min(buckets, -(-3 * cores // blocks))
        left = rows.where("hop >= 0").select("hop", "seeds", "blob", (F.col("seeds") % blocks * parts).alias("first"), each(parts, 1).alias("k"))
        right = rows.where("hop < 0").select("hop", "seeds", "blob", (F.col("seeds") % parts).alias("first"), each(blocks, parts).alias("k"))
        rows = left.unionByName(right).select("hop", "seeds", "blob", (F.col("first") + F.col("k")).alias("part"))
        return rows.repartitionById(blocks * parts, F.col("part")).drop("part").mapInArrow(lambda batches: _hops(batches, last, kept, at_once), schema)

    ends = edges.select("source", "target", F.col("confidence").cast("double").alias("confidence"), part("source", buckets).alias("a"), part("target", buckets).alias("b"))
    dealt = ends.mapInArrow(lambda batches: _dealt_ways(batches, EDGES_AT_ONCE), "bucket int, blob binary").select(F.lit(-1).alias("hop"), F.col("bucket").alias("seeds"), "blob", F.col("bucket").alias("part"))
    start = seeds.select(part("seed", groups).alias("seeds"), "seed").groupBy("seeds").applyInArrow(_packed_seeds, schema)
    # The first hop is made where the ways of a bucket come together.
    first = dealt.unionByName(start.select("hop", "seeds", "blob", each(buckets, 1).alias("part"))).repartitionById(buckets, F.col("part")).drop("part")
    rows = start.unionByName(checkpointed(first.mapInArrow(lambda batches: _hops(batches, range(1, min(hops, 2)), (-1, 1), at_once), schema)))
    for hop in range(2, hops):
        rows = rows.unionByName(checkpointed(met(rows, range(hop, hop + 1), (hop,), schema)))
    return met(rows, range(1, hops + 1), (), "seed string, key string, hops int, confidence double")


def chunks_for(mentions: DataFrame, wanted: DataFrame, k: int = 24) -> DataFrame:
    """(query_id, chunk, relevance, rank): mean confidence over the wanted entities, more of them first.

    mentions: key, chunk, confidence; wanted: query_id, key.
    """
    n = wanted.groupBy("query_id").agg(F.count_distinct("key").alias("n"))
    best = mentions.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key", "chunk").agg(F.max("confidence").alias("confidence"))
    hit = wanted.distinct().join(best, "key").groupBy("query_id", "chunk").agg(F.sum("confidence").alias("total"), F.count("*").alias("matched"))
    raw = hit.join(n, "query_id").withColumn("raw", F.col("total") / F.col("n") * (0.6 + 0.4 * F.col("matched") / F.col("n")))
    peak = F.max("raw").over(Window.partitionBy("query_id"))
    scored = raw.withColumn("relevance", F.round(F.col("raw") / peak, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "chunk", "relevance", "rank")


def stats(edges: DataFrame) -> DataFrame:
    """Counts by type and by type and source label, with totals, by grouping sets."""
    return edges.rollup("type", "source_label").agg(F.count("*").alias("edges"), F.grouping_id().alias("level"))


def without_document(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges whose document is not among ``documents``; edges without a document stay."""
    return edges.join(documents.select("document").distinct(), "document", "left_anti")


def orphans(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that stood at an edge before and at none after."""
    keys = lambda e: e.select(F.explode(F.array("source", "target")).alias("key")).distinct()
    return keys(before).join(keys(after), "key", "left_anti")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(key, component): the least key reachable, by alternating large-star and small-star steps.

    Each step keeps the components and moves links towards their least keys; the number of
    links never grows and a hub's links are grouped by its least neighbour, not paired. The
    links are written to the checkpoint folder each round, which cuts the lineage. It ends
    when a round changes no link, which takes a logarithmic number of rounds in practice; if
    ``rounds`` are not enough it raises, and never gives unfinished components.
    """
    links = edges.where("source <> target").select(F.greatest("source", "target").alias("a"), F.least("source", "target").alias("b")).distinct()
    links = checkpointed(links)
    keys = edges.select(F.explode(F.array("source", "target")).alias("key")).where("key IS NOT NULL").distinct()
    for _ in range(rounds):
        before = links
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpointed(down.unionByName(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        if links.join(before, ["a", "b"], "left_anti").isEmpty() and before.join(links, ["a", "b"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    roots = links.groupBy("a").agg(F.min("b").alias("component"))
    return keys.join(roots, keys["key"] == roots["a"], "left").select("key", F.coalesce("component", "key").alias("component"))
