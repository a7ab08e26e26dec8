"""Problem 1: oversized blocks and outcomes, cut into ordered pieces within the limit.

Recursive bisection: a span is cut at the strongest boundary near its middle (paragraph,
line, sentence, word; for outcomes a page that opens with a heading or another section),
and halves still longer than limit minus overlap are cut again. Then every piece but the
first is given an overlap that starts at a word.

Defined results: a block at or under the limit, null and empty text -> one piece (null
text as null); a text without any boundary is cut between characters, never inside one,
and not before a combining mark where that can be helped; equal blocks give equal pieces;
a null block list -> no pieces of blocks. Pages of an outcome are the larger of page_count
and the highest page of its blocks, null counting as 0.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rows import map_rows

LIMIT, OVERLAP = 1800, 150
PAGE_LIMIT, PAGE_OVERLAP = 30, 1
#: Boundaries from the strongest; a cut is made at the end of a match.
_BOUNDARIES = [re.compile(x) for x in (r"\n[^\S\n]*\n\s*", r"\n", r"[.!?;:।॥。！？][\"')\]»”]*\s+", r"\s+")]


def _nearest(places: list[int], low: int, high: int, middle: int) -> int | None:
    """The place in [low, high] nearest to the middle, the earlier of two."""
    k = bisect.bisect_left(places, middle)
    near = [p for p in places[max(0, k - 1) : k + 1] if low <= p <= high]
    return min(near, key=lambda p: (abs(p - middle), p), default=None)


def bisected(size: int, most: int, places: list[list[int]], hard, least: int = 1) -> list[int]:
    """Starts of the cores of a span of the given size, each core at most ``most`` long.

    places: the cuts of each strength, ascending; hard: the cut where there is none. Outside
    the middle half a boundary counts only if it leaves at least ``least`` on both sides:
    a cut inside a run is better than a piece that its neighbour's overlap repeats.
    """
    starts, todo = [], [(0, size)]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            starts.append(a)
            continue
        middle, reach = (a + b) // 2, (b - a) // 4
        found = None
        for low, high in ((max(a + 1, middle - reach), min(b - 1, middle + reach)), (a + max(1, least), b - max(1, least))):
            for strength in places:
                found = _nearest(strength, low, high, middle)
                if found is not None:
                    break
            if found is not None:
                break
        at = hard(a, b, middle) if found is None else found
        todo += [(at, b), (a, at)]
    return sorted(starts)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, in characters (Unicode code points)."""
    if limit <= overlap or overlap < 0:
        raise ValueError("overlap must be at least 0 and under the limit")
    size = len(text)
    if size <= limit:
        return [(0, size)]
    places = [[m.end() for m in x.finditer(text)] for x in _BOUNDARIES]

    def hard(a: int, b: int, middle: int) -> int:
        at = middle
        while at > a + 1 and unicodedata.combining(text[at]):
            at -= 1
        return at if at > a + 1 or not unicodedata.combining(text[at]) else middle

    starts = bisected(size, limit - overlap, places, hard, overlap)
    pieces, words, last = [], places[-1], -1
    for a, b in zip(starts, [*starts[1:], size]):
        if a and overlap:
            # No piece starts before the text or at or before its predecessor's start.
            low = max(last + 1, a - overlap)
            k = bisect.bisect_left(words, low)
            a = words[k] if k < len(words) and words[k] < a else low
        pieces.append((a, b))
        last = a
    return pieces


def split_pages(pages: int, openings: set[int], limit: int = PAGE_LIMIT, overlap: int = PAGE_OVERLAP) -> list[tuple[int, int]]:
    """(first, last) page of the pieces of an outcome; openings are pages that open a part."""
    if pages <= limit:
        return [(1, pages)]
    if limit <= overlap or overlap < 0:
        raise ValueError("overlap must be at least 0 and under the limit")
    starts = bisected(pages, limit - overlap, [sorted(p - 1 for p in openings if 1 < p <= pages)], lambda a, b, m: m)
    pieces, last = [], 0
    for a, b in zip(starts, [*starts[1:], pages]):
        last = max(last + 1, a + 1 - overlap)
        pieces.append((last, b))
    return pieces


_BLOCK_OUT = "outcome_id long, block_index int, piece_no int, pieces int, start int, end int, text string"
_PAGE_OUT = "outcome_id long, block_index int, piece_no int, pieces int, start int, end int"


def split_blocks(outcomes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every block; start and end are characters of the block's text."""

    def cut(outcome: int, index: int, text: str) -> list[tuple]:
        pieces = split_text(text, limit, overlap)
        return [(outcome, index, k, len(pieces), a, b, text[a:b]) for k, (a, b) in enumerate(pieces, 1)]

    blocks = outcomes.select("outcome_id", F.posexplode("blocks").alias("at", "b"))
    blocks = blocks.select("outcome_id", F.coalesce("b.block_index", "at").alias("block_index"), F.col("b.text").alias("text"))
    # Blocks within the limit are whole as they are and never leave the JVM.
    small = F.coalesce(F.length("text"), F.lit(0)) <= limit
    whole = blocks.where(small).select(
        "outcome_id", "block_index", F.lit(1).alias("piece_no"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), F.coalesce(F.length("text"), F.lit(0)).alias("end"), "text"
    )
    return whole.unionByName(map_rows(blocks.where(~small), cut, _BLOCK_OUT))


def split_outcomes(outcomes: DataFrame, limit: int = PAGE_LIMIT, overlap: int = PAGE_OVERLAP) -> DataFrame:
    """Pieces of every outcome with pages, as page ranges; block_index is -1."""

    def cut(outcome: int, pages: int, openings: list | None) -> list[tuple]:
        pieces = split_pages(pages, set(openings or ()), limit, overlap)
        return [(outcome, -1, k, len(pieces), a, b) for k, (a, b) in enumerate(pieces, 1)]

    highest = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["page"])), F.lit(0))
    headings = F.array_distinct(F.transform(F.filter("blocks", lambda b: (b["kind"] == "heading") & b["page"].isNotNull()), lambda b: b["page"]))
    pages = outcomes.select("outcome_id", F.greatest(F.coalesce("page_count", F.lit(0)), highest).alias("pages"), headings.alias("openings")).where("pages > 0")
    small = F.col("pages") <= limit
    whole = pages.where(small).select("outcome_id", F.lit(-1).alias("block_index"), F.lit(1).alias("piece_no"), F.lit(1).alias("pieces"), F.lit(1).alias("start"), F.col("pages").alias("end"))
    return whole.unionByName(map_rows(pages.where(~small), cut, _PAGE_OUT))


def rebuilt_blocks(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(outcome_id, block_index, size, text_md5, too_long, bad_joins) of pieces put together again.

    pieces: what split_blocks gives. The text is that of the pieces without what each shares
    with its predecessor; too_long counts pieces over the limit, bad_joins those that leave a
    gap, share more than the overlap or start at or before their predecessor's start. A block
    stands in one outcome, whose pieces are one group of the aggregation.
    """
    row = F.struct("piece_no", "start", "end", F.col("text").alias("piece"))
    rows = pieces.groupBy("outcome_id", "block_index").agg(F.array_sort(F.collect_list(row)).alias("p"))
    before = lambda k: F.element_at(F.col("p"), k)
    own = F.transform("p", lambda x, k: F.struct(x["piece"].alias("piece"), x["start"].alias("a"), x["end"].alias("b"), F.when(k > 0, before(k)["end"]).alias("last_b"), F.when(k > 0, before(k)["start"]).alias("last_a")))
    rows = rows.select("outcome_id", "block_index", own.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.substring(x["piece"], F.coalesce(x["last_b"] - x["a"], F.lit(0)) + 1, F.length(x["piece"]))), "")
    bad = F.size(F.filter("p", lambda x: (x["a"] > x["last_b"]) | (x["last_b"] - x["a"] > overlap) | (x["a"] <= x["last_a"])))
    long = F.size(F.filter("p", lambda x: F.length(x["piece"]) > limit))
    return rows.select("outcome_id", "block_index", F.length(text).alias("size"), F.md5(text.cast("binary")).alias("text_md5"), long.alias("too_long"), bad.alias("bad_joins"))


def oversized(outcomes: DataFrame) -> DataFrame:
    """(outcome_id, block_index) of the blocks and outcomes that came out as several pieces."""
    cut = split_blocks(outcomes).select("outcome_id", "block_index", "piece_no", "pieces").unionByName(
        split_outcomes(outcomes).select("outcome_id", "block_index", "piece_no", "pieces")
    )
    return cut.where("pieces > 1 AND piece_no = 1").select("outcome_id", "block_index").distinct()
