"""Signals, risk and documentary evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.confidence import aggregate_confidence, clamp, noisy_or

CRITICALITY = {"A": 1.0, "B": 0.88, "C": 0.76}


def by_key(values: dict[str, float], key: Column, default: float) -> Column:
    return reduce(lambda out, kv: out.when(key == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(default))


def combined_risk(signals: DataFrame, equipment: DataFrame, weight: float = 0.9) -> DataFrame:
    """(tag, signals, conjunction, confidence, risk): noisy-or of a machine's signals by criticality."""
    grouped = signals.groupBy("tag").agg(F.count("*").alias("signals"), F.round(noisy_or(F.col("strength")), 6).alias("conjunction"), aggregate_confidence(F.col("strength")).alias("confidence"))
    scale = by_key(CRITICALITY, F.col("criticality"), CRITICALITY["C"])
    return grouped.join(equipment.select("tag", "criticality"), "tag").select("tag", "signals", "conjunction", "confidence", F.round(clamp(weight * F.col("conjunction") * scale), 6).alias("risk"))


def fired(signals: DataFrame, rules: list[tuple[str, list[str], str]]) -> DataFrame:
    """(tag, rule): rules whose kinds of signals a machine all has and whose condition holds.

    A rule is (name, kinds, SQL condition over columns named like the kinds: the strongest
    strength, null without). One aggregation serves all rules.
    """
    kinds = sorted({k for _, need, _ in rules for k in need})
    wide = signals.groupBy("tag").agg(*[F.max(F.when(F.col("kind") == k, F.col("strength"))).alias(k) for k in kinds])
    hits = F.array_compact(F.array(*[F.when(reduce(lambda a, k: a & F.col(k).isNotNull(), need, F.lit(True)) & F.expr(condition), F.lit(name)) for name, need, condition in rules]))
    return wide.select("tag", F.explode(hits).alias("rule"))


def conflicts(values: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """Groups whose least and greatest value come from different documents and differ by over ``share``."""
    out = values.groupBy(*keys).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("document", F.struct("value", "document")).alias("low_document"), F.max_by("document", F.struct("value", "document")).alias("high_document")
    )
    return out.where((F.col("low_document") != F.col("high_document")) & (F.col("high") - F.col("low") > share * F.abs("high")))


def capped(rows: DataFrame, group: str | list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group: a report's limit on its citations."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def concentration(shares: DataFrame, group: str, weight: str) -> DataFrame:
    """(group, holders, hhi): sum of squared shares of the weight, 1 for a single holder."""
    total = F.sum(weight).over(Window.partitionBy(group))
    part = shares.withColumn("_p", F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0)))
    return part.groupBy(group).agg(F.count("*").alias("holders"), F.round(F.sum(F.col("_p") * F.col("_p")), 6).alias("hhi"))


def assessed(equipment: DataFrame, requirements: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """(tag, requirement, status, last, days_overdue) of every machine and requirement of its type.

    equipment: tag, equipment_type; requirements: requirement, equipment_type, evidence_type,
    days; evidence: tag, evidence_type, dated (null if undated). Missing without evidence,
    incomplete if undated only, outdated past the interval, else compliant.
    """
    due = equipment.join(requirements, "equipment_type")
    seen = evidence.groupBy("tag", "evidence_type").agg(F.max("dated").alias("last"), F.count("*").alias("items"))
    rows = due.join(seen, ["tag", "evidence_type"], "left")
    over = F.datediff(as_of, "last") - F.col("days")
    status = F.when(F.col("items").isNull(), "missing").when(F.col("last").isNull(), "incomplete").when(over > 0, "outdated").otherwise("compliant")
    return rows.select("tag", "requirement", status.alias("status"), "last", F.when(over > 0, over).alias("days_overdue"))


def knapsack_in_order(items: DataFrame, group: str, budget: int) -> DataFrame:
    """Items by priority while they fit a group's byte budget; one that does not fit is skipped.

    items: group, id, priority, size. A group's items are one bundle, hence bounded by it.
    """
    packed = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "id", F.col("size").cast("long").alias("size")))).alias("items"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))

    def step(state, item):
        fits = state["used"] + item["size"] <= budget
        return F.struct(F.when(fits, state["used"] + item["size"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["ids"], F.array(item["id"].cast("long")))).otherwise(state["ids"]).alias("ids"))

    return packed.select(group, F.explode(F.aggregate("items", empty, step)["ids"]).alias("id"))


def checksum(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, rows, checksum): the sum of 48 bits of each row's SHA-256, whatever the order of rows.

    Nulls count as empty. Nothing of a group is collected.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
    return rows.groupBy(group).agg(F.count("*").alias("rows"), F.sum(part).alias("checksum"))
