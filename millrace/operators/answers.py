"""What an answer is put together from: keys of a question, graph boosts, budgets, chains, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.confidence import clamp, recency
from millrace.functions.tags import positional_reading
from millrace.operators.evidence import capped


def question_tags(text: Column) -> Column:
    """Tags of a question in order, with or without their dash."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z]{1,4}[- ]?[0-9]{2,5}[A-Z]?)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, "^([A-Z]+)[- ]?([0-9])", "$1-$2")))


def overlap(asked: Column, held: Column) -> Column:
    """Matched keys over all keys of the question and the surplus of the passage: m / (q + max(p, m) - m)."""
    m, q, p = F.size(F.array_intersect(asked, held)), F.size(asked), F.size(held)
    return F.when(q > 0, m / (q + F.greatest(p, m) - m)).otherwise(0.0)


def graph_boost(candidates: DataFrame, asked: DataFrame, held: DataFrame, degrees: DataFrame, groups: DataFrame, half_life: float = 180.0) -> DataFrame:
    """(query_id, id, overlap, centrality, path, boost): .4 overlap, .2 centrality, .2 path, .2 recency.

    candidates: query_id, id, age (days or null); asked: query_id, keys; held: id, keys (of a
    passage); degrees: key, centrality; groups: key, group. Centrality is that of a passage's
    best known key. A path is a key in common (.9) or a key of the same group (.81).
    """
    best = held.select("id", F.explode("keys").alias("key")).join(degrees, "key").groupBy("id").agg(F.max("centrality").alias("centrality"))
    mine = asked.select("query_id", F.explode("keys").alias("key")).join(groups, "key").groupBy("query_id").agg(F.collect_set("group").alias("asked_groups"))
    theirs = held.select("id", F.explode("keys").alias("key")).join(groups, "key").groupBy("id").agg(F.collect_set("group").alias("held_groups"))
    rows = candidates.join(asked.select("query_id", F.col("keys").alias("_asked")), "query_id").join(held.select("id", F.col("keys").alias("_held")), "id")
    rows = rows.join(best, "id", "left").join(mine, "query_id", "left").join(theirs, "id", "left")
    meet = F.size(F.array_intersect("_asked", "_held")) > 0
    near = F.coalesce(F.arrays_overlap("asked_groups", "held_groups"), F.lit(False))
    path = F.when(meet, 0.9).when(near, 0.81).otherwise(0.0)
    central = F.coalesce("centrality", F.lit(0.0))
    boost = 0.4 * overlap(F.col("_asked"), F.col("_held")) + 0.2 * central + 0.2 * path + 0.2 * recency(F.col("age"), half_life)
    return rows.select("query_id", "id", F.round(overlap(F.col("_asked"), F.col("_held")), 6).alias("overlap"), F.round(central, 6).alias("centrality"), path.alias("path"), F.round(boost, 6).alias("boost"))


def within_budget(passages: DataFrame, budget: int, least: int = 40) -> DataFrame:
    """Passages in rank order within a budget: the one that overflows is cut to what is left, none once under ``least`` is left.

    passages: query_id, id, rank, tokens; few per query. A running sum, no sequential step.
    """
    used = F.coalesce(F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = passages.withColumn("_left", F.lit(budget) - used).where(F.col("_left") >= least)
    return rows.select("query_id", "id", "rank", F.least("tokens", "_left").cast("long").alias("kept"), (F.col("tokens") > F.col("_left")).alias("cut"))


def digest(asked: DataFrame, sections: dict[str, DataFrame], most: int = 8) -> DataFrame:
    """(tag, section, found, items): up to ``most`` items a section, and sections that were searched in vain.

    asked: tag; sections: name -> (tag, item). Every section stands for every tag.
    """
    rows = [s.where("tag IS NOT NULL").select("tag", F.lit(n).alias("section"), F.col("item").cast("string").alias("item")) for n, s in sections.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every = every.distinct().join(asked, "tag", "left_semi")
    listed = capped(every, ["tag", "section"], [F.asc("item")], most).groupBy("tag", "section").agg(F.concat_ws(", ", F.array_sort(F.collect_list("item"))).alias("items"))
    counts = every.groupBy("tag", "section").agg(F.count("*").alias("found"))
    wanted = asked.withColumn("section", F.explode(F.array(*map(F.lit, sections))))  # a handful of sections for each tag
    out = wanted.join(counts, ["tag", "section"], "left").join(listed, ["tag", "section"], "left")
    return out.select("tag", "section", F.coalesce("found", F.lit(0).cast("long")).alias("found"), F.coalesce("items", F.lit("searched, nothing found")).alias("items"))


def chains(links: DataFrame) -> DataFrame:
    """(tag, chain, steps, confidence): a machine's links in order of their step, then strength; 70 % weakest and 30 % mean.

    links: tag, step (order), label, strength. One link a step, so a chain is short.
    """
    best = links.groupBy("tag", "step").agg(F.max_by(F.struct("label", "strength"), F.struct("strength", "label")).alias("b")).where("b.strength > 0")
    grouped = best.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("step", F.col("b.label").alias("label")))).alias("l"), F.count("*").alias("steps"), F.round(0.7 * F.min("b.strength") + 0.3 * F.avg("b.strength"), 4).alias("confidence"))
    return grouped.select("tag", F.array_join(F.transform("l", lambda x: x["label"]), " → ").alias("chain"), "steps", "confidence")


def reconciled(raws: DataFrame, registry: DataFrame) -> DataFrame:
    """(raw, tag, corrections, verified, ambiguous, confidence): the likeliest reading of each recognised tag.

    Every reading (one to three letters in front, none or one behind) is scored 100 less 6 a
    corrected character, 40 less if the registry does not hold it; another reading within 5
    makes it ambiguous. Confidence: the score, .72 of it if ambiguous, .09 less a correction,
    at most .74 unverified. raws: raw, distinct; registry: tag.
    """
    plain = F.regexp_replace(F.upper("raw"), "[^A-Z0-9]", "")
    rows = raws.where("raw IS NOT NULL").select("raw", plain.alias("plain")).where(F.length("plain").between(3, 9))
    readings = F.array(*[F.struct(positional_reading(F.col("plain"), p, s).alias("tag"), F.lit(p).alias("p")) for p in (1, 2, 3) for s in (0, 1)])
    rows = rows.select("raw", "plain", F.inline(readings)).where(F.col("tag").rlike("^[A-Z]{1,3}-[0-9]{2,5}[A-Z]?$"))
    cost = F.levenshtein(F.regexp_replace("tag", "-", ""), "plain")
    rows = rows.groupBy("raw", "tag").agg(F.min(cost).alias("corrections"))
    known = registry.select("tag").where("tag IS NOT NULL").distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "tag", "left").withColumn("verified", F.coalesce("known", F.lit(False)))
    score = F.greatest(100 - 6 * F.col("corrections") - F.when(F.col("verified"), 0).otherwise(40), F.lit(0))
    w = Window.partitionBy("raw").orderBy(F.desc("score"), "tag")
    rows = rows.withColumn("score", score).withColumns({"k": F.row_number().over(w), "second": F.lead("score").over(w)}).where("k = 1")
    unsure = F.coalesce(F.col("score") - F.col("second") <= 5, F.lit(False))
    sure = F.col("score") / 100 * F.when(unsure, 0.72).otherwise(1.0) - 0.09 * F.col("corrections")
    return rows.select("raw", "tag", "corrections", "verified", unsure.alias("ambiguous"), F.round(clamp(F.when(F.col("verified"), sure).otherwise(F.least(sure, F.lit(0.74)))), 6).alias("confidence"))


def aliases(names: DataFrame) -> DataFrame:
    """(alias, key): each name's normal form with the first key that claims it; under three characters none. names: key, name, place."""
    form = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    rows = names.select("key", "place", form.alias("alias")).where(F.length("alias") >= 3)
    return rows.groupBy("alias").agg(F.min_by("key", F.struct("place", "key")).alias("key"))
