"""The queries of the problems tagged llm, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import canonical, languages, nearest, packing, scans, spam, split, tokens
from millrace.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(table(spark, sf_dir, "parse_outcome"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_blocks(table(spark, sf_dir, "parse_outcome"))


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.rebuilt_blocks(split.split_blocks(table(spark, sf_dir, "parse_outcome")))


def p1_page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_outcomes(table(spark, sf_dir, "parse_outcome"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.defects(table(spark, sf_dir, "parse_outcome"), table(spark, sf_dir, "equipment"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "parse_outcome"), table(spark, sf_dir, "equipment"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = nearest.plant_records(table(spark, sf_dir, "failure"), table(spark, sf_dir, "maintenance"))
    readings = table(spark, sf_dir, "reading").selectExpr("reading_id", "equipment_tag AS entity", "measured_at AS at")
    return nearest.nearest_readings(records, readings).select("record_id", "reading_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_labels(table(spark, sf_dir, "voice_query"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.label_segments(table(spark, sf_dir, "voice_query"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.resolve(table(spark, sf_dir, "tag_resolution"), table(spark, sf_dir, "equipment"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(packing.pack(table(spark, sf_dir, "documents"), keys=True))


def p8_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.covered(packing.pack(docs), docs)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_documents(table(spark, sf_dir, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p1_page_pieces, p2_found, p2_paragraphs, p3_found, p5_found, p5_segments, p6_found, p7_ids, p8_containers, p8_usage, p8_covered, p9_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT outcome_id, b.block_index AS block_index FROM (SELECT outcome_id, unnest(blocks) AS b FROM parse_outcome)
            WHERE length(b.text) > 1800
            UNION
            SELECT outcome_id, CAST(-1 AS INTEGER) FROM parse_outcome
            WHERE greatest(coalesce(page_count, 0), coalesce(list_max(list_transform(blocks, lambda x: x.page)), 0)) > 30""",
        "p1_rebuilt": """
            SELECT outcome_id, b.block_index AS block_index, CAST(length(coalesce(b.text, '')) AS INTEGER) AS size, md5(coalesce(b.text, '')) AS text_md5,
              CAST(0 AS INTEGER) AS too_long, CAST(0 AS INTEGER) AS bad_joins
            FROM (SELECT outcome_id, unnest(blocks) AS b FROM parse_outcome)""",
        # The bisection of the pages, span by span; cut is the number of pages before a cut.
        "p1_page_pieces": """
            WITH RECURSIVE outcomes AS (
              SELECT outcome_id, CAST(greatest(coalesce(page_count, 0), coalesce(list_max(list_transform(blocks, lambda x: x.page)), 0)) AS BIGINT) AS pages,
                list_distinct(list_transform(list_filter(blocks, lambda x: x.kind = 'heading' AND x.page IS NOT NULL), lambda x: CAST(x.page AS BIGINT) - 1)) AS cuts
              FROM parse_outcome),
            spans AS (
              SELECT outcome_id, cuts, CAST(0 AS BIGINT) AS a, pages AS b, pages FROM outcomes WHERE pages > 0
              UNION ALL
              SELECT outcome_id, cuts, unnest([a, cut]) AS a, unnest([cut, b]) AS b, pages FROM (
                SELECT *, coalesce(
                  list_min(list_transform(list_filter(cuts, lambda p: p >= greatest(a + 1, m - r) AND p <= least(b - 1, m + r)), lambda p: {'d': abs(p - m), 'p': p})).p,
                  list_min(list_transform(list_filter(cuts, lambda p: p >= a + 1 AND p <= b - 1), lambda p: {'d': abs(p - m), 'p': p})).p, m) AS cut
                FROM (SELECT *, (a + b) // 2 AS m, (b - a) // 4 AS r FROM spans WHERE b - a > 29 AND pages > 30))),
            cores AS (SELECT * FROM spans WHERE pages <= 30 OR b - a <= 29)
            SELECT outcome_id, CAST(-1 AS INTEGER) AS block_index, CAST(row_number() OVER w AS INTEGER) AS piece_no, CAST(count(*) OVER (PARTITION BY outcome_id) AS INTEGER) AS pieces,
              CAST(CASE WHEN a = 0 THEN 1 ELSE a END AS INTEGER) AS start, CAST(b AS INTEGER) AS "end"
            FROM cores WINDOW w AS (PARTITION BY outcome_id ORDER BY a)""",
        # Every text that is not empty, once, in whole pieces, no container above its capacity.
        "p8_covered": """
            SELECT doc_id, CAST(length(text) AS BIGINT) AS characters, TRUE AS whole, TRUE AS "within" FROM documents WHERE text <> ''""",
        "p3_found": """
            WITH records AS (
              SELECT event_id AS record_id, upper(trim(equipment_tag)) AS tag, CAST(occurred_on AS TIMESTAMP) AS day, INTERVAL 12 HOUR AS reach FROM failure
              UNION SELECT record_id, upper(trim(equipment_tag)), CAST(performed_on AS TIMESTAMP), INTERVAL 6 HOUR FROM maintenance),
            readings AS (SELECT DISTINCT reading_id, upper(trim(equipment_tag)) AS tag, measured_at FROM reading WHERE measured_at IS NOT NULL),
            pairs AS (
              SELECT record_id, reading_id, row_number() OVER (PARTITION BY record_id
                ORDER BY abs(epoch_us(measured_at) - epoch_us(day)), measured_at, reading_id) AS k
              FROM records JOIN readings USING (tag) WHERE measured_at BETWEEN day - reach AND day + reach)
            SELECT record_id, reading_id FROM pairs WHERE k = 1""",
    }
