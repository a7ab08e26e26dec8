"""Drawings as tables: symbols (page, id, x0, y0, x1, y1, score), runs of line (page, run, x0, y0, x1, y1, arrow).

Pixels are not read here; what a detector found is judged, connected and turned into edges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP = 0.35


def intersection_over_union(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def suppressed(symbols: DataFrame, most: float = OVERLAP) -> DataFrame:
    """The symbols of each page that overlap no surer one by more than ``most``; ties go to the lower id. A page is a bounded group."""

    def keep(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (-r["score"], r["id"]))
        kept: list[dict] = []
        for r in rows:
            box = (r["x0"], r["y0"], r["x1"], r["y1"])
            if all(intersection_over_union(box, (k["x0"], k["y0"], k["x1"], k["y1"])) <= most for k in kept):
                kept.append(r)
        return pa.Table.from_pylist(kept, schema=group.schema)

    columns = symbols.select("page", "id", "x0", "y0", "x1", "y1", "score")
    return columns.groupBy("page").applyInArrow(keep, columns.schema)


def _distance(x: Column, y: Column) -> Column:
    """From a point to a symbol's box, 0 inside."""
    dx = F.greatest(F.col("x0") - x, x - F.col("x1"), F.lit(0.0))
    dy = F.greatest(F.col("y0") - y, y - F.col("y1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def connections(symbols: DataFrame, runs: DataFrame, reach: float = 20.0, long: float = 100.0) -> DataFrame:
    """(page, run, source, target, confidence): the symbols nearest to both ends of each run within ``reach``.

    Confidence: .40, and .35 by nearness, .15 by length up to ``long``, .10 for an arrow. Ends
    meet symbols by cells of twice the reach, so a page's ends never meet all its symbols.
    """
    cell = 2 * reach
    cells = symbols.select("page", "id", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.floor((F.col("x0") - reach) / cell), F.floor((F.col("x1") + reach) / cell))).alias("cx"))
    cells = cells.withColumn("cy", F.explode(F.sequence(F.floor((F.col("y0") - reach) / cell), F.floor((F.col("y1") + reach) / cell))))
    ends = runs.select("page", "run", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.lit(1).alias("end"), F.col("x1").alias("px"), F.col("y1").alias("py")))).alias("e")).select("page", "run", "e.*")
    ends = ends.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    near = ends.join(cells, ["page", "cx", "cy"]).withColumn("d", _distance(F.col("px"), F.col("py"))).where(F.col("d") <= reach)
    best = near.groupBy("page", "run", "end").agg(F.min(F.struct("d", "id")).alias("b"))
    both = best.groupBy("page", "run").agg(*[F.max(F.when(F.col("end") == k, F.col("b"))).alias(n) for k, n in ((0, "s"), (1, "t"))]).where("s IS NOT NULL AND t IS NOT NULL AND s.id <> t.id")
    size = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    rows = both.join(runs.select("page", "run", size.alias("size"), "arrow"), ["page", "run"])
    near_share = 1 - (F.col("s.d") + F.col("t.d")) / (2 * reach)
    confidence = 0.40 + 0.35 * near_share + 0.15 * F.least(F.col("size") / long, F.lit(1.0)) + 0.10 * F.col("arrow").cast("int")
    return rows.select("page", "run", F.col("s.id").alias("source"), F.col("t.id").alias("target"), F.round(confidence, 6).alias("confidence"))


def page_confidence(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(page, confidence): .5 the mean score of symbols, .3 the share with a tag, .2 the share that is connected. symbols: page, id, score, tag."""
    tied = links.select("page", F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("tied", F.lit(1))
    rows = symbols.join(tied, ["page", "id"], "left")
    score = 0.5 * F.avg("score") + 0.3 * F.avg(F.col("tag").isNotNull().cast("int")) + 0.2 * F.avg(F.coalesce("tied", F.lit(0)))
    return rows.groupBy("page").agg(F.round(score, 6).alias("confidence"))


def drawing_edges(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target, type, confidence): links between tagged symbols as edges of the graph, best confidence. symbols: page, id, tag."""
    tags = symbols.where("tag IS NOT NULL").select("page", "id", "tag")
    rows = links.join(tags.select("page", F.col("id").alias("source"), F.col("tag").alias("s")), ["page", "source"]).join(tags.select("page", F.col("id").alias("target"), F.col("tag").alias("t")), ["page", "target"])
    return rows.where("s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target"), F.lit("CONNECTED_TO").alias("type")).agg(F.max("confidence").alias("confidence"))


def is_drawing(width: Column, height: Column, line_share: Column, text_share: Column) -> Column:
    """Whether a page is a drawing: wide or large, many lines, little text."""
    return ((F.greatest(width, height) >= 2000) | (width > 1.25 * height)) & (line_share >= 0.02) & (text_share < 0.15)
