"""Problem 8: texts assigned to containers of a fixed number of tokens, with little room left.

A text above the capacity is cut into full pieces and a rest; no other text is cut. Items
are spread over groups of about ITEMS_A_GROUP by a hash of their id, so that neither a
source nor a set of copies gathers in one task, and each group is packed by best fit, the
largest items first. Containers are kept in a tree by room left, with bitmaps of the sources
and of the duplicate clusters they hold; the search goes on from the tightest container
upwards until one is compatible. Containers that stay slack are emptied and packed again, together,
in rounds of ever fewer groups.

Two items of one source or one duplicate cluster (equal texts but for case and white space)
share a container only if the items would otherwise need more containers than their sizes
do: room comes first, then clusters, then sources.

Defined results: null and empty texts -> no container; blank texts are items; repeated rows
(equal ids) are packed each; a null source conflicts with none; an empty table -> no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import token_counts
from millrace.session import checkpointed, spread

CAPACITY = 2048
ITEMS_A_GROUP = 20_000
SLACK = 0.985  # containers filled less are packed again
HOT = 0.02  # a source or cluster with more than this share of a group's items has a tree of its own


class Residuals:
    """Open containers by room left: a bucket per room, and a bitmap of the buckets that hold any.

    The successor of a room is the lowest set bit from there on, found on the bitmap's words.
    """

    def __init__(self) -> None:
        self.buckets: dict[int, dict[int, None]] = {}
        self.rooms = 0

    def add(self, at: int, room: int) -> None:
        self.buckets.setdefault(room, {})[at] = None
        self.rooms |= 1 << room

    def remove(self, at: int, room: int) -> None:
        bucket = self.buckets[room]
        del bucket[at]
        if not bucket:
            self.rooms &= ~(1 << room)

    def from_(self, room: int) -> Iterator[int]:
        """Containers with at least that room, the tightest first, in the order they came to it."""
        while left := self.rooms >> room:
            room += (left & -left).bit_length() - 1
            yield from self.buckets[room]
            room += 1


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item. sources and clusters: codes, -1 for none.

    Each container has a bitmap of its sources and one of its clusters. The search goes up
    from the tightest container that has the room until one is compatible. A source or
    cluster of many items keeps a tree of its own of the containers without it, so that the
    search never walks past all those that hold it.
    """
    n = len(sizes)
    out = np.full(n, -1, np.int64)
    ideal = int(-(-int(sizes.sum()) // capacity))
    kinds = [np.bincount(c[c >= 0], minlength=1) if (c >= 0).any() else np.zeros(1, np.int64) for c in (sources, clusters)]
    # Codes of one item conflict with nothing; those of many (at most 1 / HOT of each kind) get a tree.
    several = [k > 1 for k in kinds]
    without: list[dict[int, Residuals]] = [{int(c): Residuals() for c in np.flatnonzero(k > max(8, HOT * n))} for k in kinds]
    every = Residuals()
    room: list[int] = []
    held: tuple[list[int], list[int]] = ([], [])

    def trees(at: int) -> Iterator[Residuals]:
        yield every
        for own, bits in zip(without, held):
            for code, tree in own.items():
                if not bits[at] >> code & 1:
                    yield tree

    def put(at: int, size: int, codes: tuple[int, int]) -> None:
        for tree in trees(at):
            tree.remove(at, room[at])
        room[at] -= size
        for kind, code in enumerate(codes):
            if code >= 0:
                held[kind][at] |= 1 << code
        if room[at]:
            for tree in trees(at):
                tree.add(at, room[at])

    def tightest(size: int, codes: tuple[int, int]) -> int:
        source, cluster = codes
        start = without[1].get(cluster) or without[0].get(source) or every
        for at in start.from_(size):
            if (source < 0 or not held[0][at] >> source & 1) and (cluster < 0 or not held[1][at] >> cluster & 1):
                return at
        return -1

    for i in np.lexsort((np.arange(n), -sizes)):
        size = int(sizes[i])
        codes = tuple(int(c[i]) if c[i] >= 0 and some[c[i]] else -1 for c, some in zip((sources, clusters), several))
        at = tightest(size, codes)
        if at < 0 and len(room) >= ideal:  # room comes first: then clusters, then sources
            for fewer in ((-1, codes[1]), (-1, -1)):
                if at < 0:
                    at = tightest(size, fewer)
        if at < 0:
            at = len(room)
            room.append(capacity)
            for bits in held:
                bits.append(0)
            for tree in trees(at):
                tree.add(at, capacity)
        put(at, size, codes)
        out[i] = at
    return out


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    codes = column.combine_chunks().dictionary_encode()
    return codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(capacity: int):
    def run(items: pa.Table) -> pa.Table:
        sizes = items["n_tokens"].to_numpy().astype(np.int64)
        order = np.lexsort((items["piece_no"].to_numpy(), items["id"].to_numpy()))
        found = np.empty(len(sizes), np.int64)
        found[order] = best_fit(sizes[order], _codes(items["source"])[order], _codes(items["cluster"])[order], capacity)
        fill = np.bincount(found, weights=sizes)[found].astype(np.int64)
        base = items["group"].to_numpy() * (1 << 32)
        return items.append_column("local", pa.array(base + found)).append_column("fill", pa.array(fill)).drop_columns(["group"])

    return run


_ITEM = "id long, piece_no int, start int, n_tokens int, source string, cluster binary"


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", vocab: str | None = None, keys: bool = False) -> DataFrame:
    """(id, piece_no, start, n_tokens, container, fill) of every piece of the non-empty texts.

    start is the first token of the piece in its text; fill the tokens of its container.
    keys: with the columns source and cluster, for :func:`usage`.
    """
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), source.alias("source")).where(F.length("text") > 0)
    rows = token_counts(spread(rows), "text", "tokens", vocab)
    cluster = F.unhex(F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))))
    rows = rows.select("id", "source", cluster.alias("cluster"), "tokens").where("tokens > 0")
    pieces = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.lit(capacity)).cast("int"))
    items = rows.select("id", "source", "cluster", "tokens", F.explode(pieces).alias("k"))
    items = items.select(
        "id", (F.col("k") + 1).alias("piece_no"), (F.col("k") * capacity).alias("start"), F.least(F.col("tokens") - F.col("k") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"), "source", "cluster"
    )
    items = checkpointed(items)
    done, turn, left = [], 0, items.count()
    groups = max(1, -(-left // ITEMS_A_GROUP))
    while True:
        grouped = items.withColumn("group", F.pmod(F.xxhash64("id", "piece_no", F.lit(turn)), F.lit(groups)))
        # A number of partitions of its own, as packing costs far more than the bytes of a group suggest.
        grouped = grouped.repartition(groups, "group")
        packed = checkpointed(grouped.groupBy("group").applyInArrow(_pack(capacity), f"{_ITEM}, local long, fill long"))
        packed = packed.withColumn("container", F.concat(F.lit(f"{turn}-"), F.col("local").cast("string")))
        slack = packed.where(F.col("fill") < int(SLACK * capacity)).select("id", "piece_no", "start", "n_tokens", "source", "cluster")
        fewer = max(1, -(-slack.count() // ITEMS_A_GROUP))
        if groups == 1 or fewer >= groups:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") >= int(SLACK * capacity)))
        items, groups, turn = slack, fewer, turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(id_col), "piece_no", "start", "n_tokens", "container", "fill", *(["source", "cluster"] if keys else []))


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, the share of room left, and the conflicts that yielded to room.

    packed has the keys. same_source and same_cluster count containers with two items of one
    source or cluster; the items of a container are few, so its lists are short.
    """
    each = packed.groupBy("container").agg(
        F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"),
        (F.count("source") > F.count_distinct("source")).cast("int").alias("same_source"), (F.count("cluster") > F.count_distinct("cluster")).cast("int").alias("same_cluster"),
    )
    total = each.agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("same_source").alias("same_source"), F.sum("same_cluster").alias("same_cluster"))
    return total.withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.lit(capacity)))


def covered(packed: DataFrame, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, characters, whole, within): each packed text; whole says that its pieces follow each other from
    token 0 and only the last is not full, within that no container holds more than the capacity."""
    p = F.col("p")
    row = F.struct("piece_no", "start", "n_tokens", "fill")
    pieces = packed.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    whole = F.forall(p, lambda x: (x["start"] == (x["piece_no"] - 1) * capacity) & ((x["n_tokens"] == capacity) | (x["piece_no"] == F.size(p)))) & (F.element_at(p, -1)["piece_no"] == F.size(p))
    within = F.forall(p, lambda x: (x["n_tokens"] > 0) & (x["n_tokens"] <= x["fill"]) & (x["fill"] <= capacity))
    texts = docs.select("doc_id", F.length("text").cast("long").alias("characters"))
    return pieces.select("doc_id", whole.alias("whole"), within.alias("within")).join(texts, "doc_id").select("doc_id", "characters", "whole", "within")
