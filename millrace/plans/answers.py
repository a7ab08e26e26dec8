"""Queries that put answers together: keys, boosts, budgets, digests, chains, actions, tags as recognised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.clock import machine
from millrace.functions.tags import scan_tags
from millrace.operators import answers as ops
from millrace.operators import signals as ops_signals
from millrace.operators import evidence, graph, retrieval, trend
from millrace.plans import extraction, machines, signals
from millrace.plans import graph as graphs
from millrace.plans import retrieval as search
from millrace.plans.vocabulary import ANOMALY_SQL
from millrace.session import checkpointed, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def question_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "voice_query").where("transcript IS NOT NULL")
    return q.select("query_id", F.posexplode(ops.question_tags(F.col("transcript"))).alias("position", "tag"))


def question_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machines of a question: the one it was asked at, then those it names, at most six: a limit of the answer."""
    q = table(spark, sf_dir, "voice_query")
    own = F.filter(F.array(machine(F.col("equipment_tag"))), lambda t: t.isNotNull())
    tags = F.slice(F.array_distinct(F.concat(own, F.coalesce(ops.question_tags(F.col("transcript")), F.array().cast("array<string>")))), 1, 6)
    return q.select("query_id", F.posexplode(tags).alias("position", "tag"))


def _candidates(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Lexical candidates of each query (a document's title) with their age."""
    d = _docs(spark, sf_dir)
    newest = d.agg(F.max("document_date")).scalar()
    dated = d.select(F.col("doc_id").alias("id"), F.datediff(newest, "document_date").cast("double").alias("age"))
    return found.join(dated, "id")


def _boosted(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    d = _docs(spark, sf_dir)
    named = F.filter(F.array(machine(F.col("equipment_tag"))), lambda t: t.isNotNull())
    asked = d.where("doc_id % 20 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.array_distinct(F.concat(named, scan_tags(F.col("title")))).alias("keys"))
    held = checkpointed(d.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), scan_tags(F.col("text")).alias("keys")))  # the texts are scanned once
    degree = held.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    top = degree.agg(F.max("n").cast("double")).scalar()
    degree = degree.select("key", (F.log1p(F.col("n").cast("double")) / F.log1p(top)).alias("centrality"))
    groups = table(spark, sf_dir, "equipment").where("unit IS NOT NULL").select(F.col("tag").alias("key"), F.col("unit").alias("group"))
    return ops.graph_boost(_candidates(spark, sf_dir, found).select("query_id", "id", "age"), asked, held, degree, groups)


def graph_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir, search.lexical_tfidf_topk(spark, sf_dir))


def graph_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical score and graph boost fused by query, with the floor and the best kept."""
    found = checkpointed(search.lexical_tfidf_topk(spark, sf_dir))
    both = found.select("query_id", "id", F.col("score").alias("vector_score")).join(_boosted(spark, sf_dir, found).select("query_id", "id", F.col("boost").alias("graph_score")), ["query_id", "id"])
    return retrieval.fused(both).select("query_id", "id", "fused", "rank")


def step_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: the mean score of what was retrieved, and the share that was kept times its mean relevance."""
    found = search.lexical_tfidf_topk(spark, sf_dir)
    kept = F.when(F.col("score") >= 0.5, F.col("score"))
    return found.groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("retrieval"), F.round(F.count(kept) / F.count("*") * F.coalesce(F.avg(kept), F.lit(0.0)), 6).alias("generation"))


def retrieval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits and documents of the query's own machine as one list, the best score of each kept."""
    d = _docs(spark, sf_dir)
    found = search.lexical_tfidf_topk(spark, sf_dir).select("query_id", "id", "score")
    tagged = d.select("doc_id", machine(F.col("equipment_tag")).alias("tag"), "document_date").where("tag IS NOT NULL")
    newest = evidence.capped(tagged, "tag", [F.desc_nulls_last("document_date"), F.asc("doc_id")], 3)
    same = d.where("doc_id % 20 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), machine(F.col("equipment_tag")).alias("tag")).join(newest.select("tag", F.col("doc_id").alias("id")), "tag")
    return found.unionByName(same.select("query_id", "id", F.lit(0.6).alias("score"))).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the passages fits into 72 % of 6,000 tokens, the one that overflows cut."""
    sizes = _docs(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("id"), text.token_estimate(F.col("text")).alias("tokens"))
    return ops.within_budget(search.lexical_tfidf_topk(spark, sf_dir).select("query_id", "id", "rank").join(sizes, "id"), 4320)


def evidence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found on each machine that is asked about, section by section, and what was searched in vain."""
    tag = machine(F.col("equipment_tag")).alias("tag")
    asked = table(spark, sf_dir, "voice_query").select(tag).where("tag IS NOT NULL").distinct()
    sections = {
        "maintenance": table(spark, sf_dir, "maintenance").select(tag, F.col("record_id").alias("item")), "failures": table(spark, sf_dir, "failure").select(tag, F.col("event_id").alias("item")),
        "procedures": _docs(spark, sf_dir).where("document_type = 'sop'").select(tag, F.col("doc_id").alias("item")), "limits": table(spark, sf_dir, "equipment").select("tag", F.explode(F.map_keys("oem_thresholds")).alias("item")),
    }
    return ops.digest(asked, sections)


def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons to doubt a machine's evidence: poorly read, sparse, stale, conflicting, read from pictures only."""
    weak = extraction.uncertainty_flags(spark, sf_dir)
    dated = _docs(spark, sf_dir).select(machine(F.col("equipment_tag")).alias("tag"), "document_date").where("tag IS NOT NULL")
    stale = dated.groupBy("tag").agg(F.max("document_date").alias("last")).where(F.datediff(F.lit(machines.AS_OF).cast("date"), "last") > 45).select("tag", F.lit("stale").alias("flag"))
    conflict = machines.conflict_detection(spark, sf_dir).select("tag", F.lit("conflict").alias("flag")).distinct()
    read = table(spark, sf_dir, "parse_outcome").select(machine(F.col("equipment_tag")).alias("tag"), F.col("ocr_confidence").isNotNull().alias("scan")).where("tag IS NOT NULL")
    vision = read.groupBy("tag").agg(F.min(F.col("scan").cast("int")).alias("all")).where("all = 1").select("tag", F.lit("vision").alias("flag"))
    return weak.unionByName(stale).unionByName(conflict).unionByName(vision)


def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits whose document is of some types, dated within a range and not of the unknown source."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "document_type", "document_date", "lang")
    where = retrieval.conditions({"document_type": ["inspection_report", "work_order", "shift_log"], "document_date": ("2024-05-01", None), "lang": "en"})
    return search.lexical_tfidf_topk(spark, sf_dir).join(d.where(where).select("id"), "id", "left_semi").select("query_id", "id", "rank")


def interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other ways to read weak evidence: from flags and from alerts of low confidence, five a machine."""
    flags = extraction.uncertainty_flags(spark, sf_dir)
    said = F.when(F.col("flag") == "low_ocr", F.lit("A poorly read paper may say something else.")).otherwise(F.lit("A single document may not be typical."))
    weak = signals.compound_alerts(spark, sf_dir).where("confidence < 0.55").select("tag", F.concat(F.lit("The signals behind "), F.col("rule"), F.lit(" may be chance.")).alias("reading"))
    rows = flags.select("tag", said.alias("reading")).unionByName(weak).distinct()
    return evidence.capped(rows, "tag", [F.asc("reading")], 5)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.all_signals(spark, sf_dir)
    step = F.when(F.col("kind") == "precursor_match", 1).when(F.col("kind") == "threshold_approach", 2).when(F.col("kind") == "alarm_bypass", 3)
    label = F.when(F.col("kind") == "threshold_approach", F.concat(F.lit("limit of "), F.col("source"))).when(F.col("kind") == "alarm_bypass", F.lit("alarm bypassed")).otherwise(F.lit("precursor seen"))
    now = s.withColumn("step", step).where("step IS NOT NULL").select("tag", "step", label.alias("label"), "strength")
    past = table(spark, sf_dir, "failure").where("failure_mode IS NOT NULL").select(machine(F.col("equipment_tag")).alias("tag"), F.lower(F.trim(F.regexp_replace("failure_mode", "[_ -]+", " "))).alias("label"))
    past = past.where("tag IS NOT NULL").groupBy("tag", "label").agg(F.count("*").alias("n")).select("tag", F.lit(4).alias("step"), "label", F.round(F.least(F.lit(1.0), 0.4 + 0.2 * F.col("n")), 6).alias("strength"))
    return now.unionByName(past)


def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chains(_links(spark, sf_dir))


def diagnostic_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each link of a machine's chain asks for, at most five."""
    act = F.when(F.col("step") == 1, F.lit("Inspect for the earlier failure")).when(F.col("step") == 2, F.concat(F.lit("Bring down the "), F.col("label"))).when(F.col("step") == 3, F.lit("Restore the alarm")).otherwise(F.concat(F.lit("Check against "), F.col("label")))
    rows = _links(spark, sf_dir).select("tag", "step", act.alias("action")).distinct()
    return evidence.capped(rows, "tag", [F.asc("step"), F.asc("action")], 5)


def diagnostic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven steps of a diagnosis for every machine of the registry that any of them finds something on, as counts."""
    e = table(spark, sf_dir, "equipment").select("tag")
    done = extraction.diagnostic_steps(spark, sf_dir)
    limits = table(spark, sf_dir, "equipment").select("tag", F.explode(F.map_keys("oem_thresholds")).alias("p")).groupBy("tag").agg(F.count("*").alias("items")).select("tag", F.lit("limits").alias("step"), "items")
    kinds = {"precursor_match": "precursors", "threshold_approach": "thresholds", "alarm_bypass": "bypasses", "maintenance_anomaly": "anomalies"}
    named = F.when(F.lit(False), F.lit(""))
    for kind, name in kinds.items():
        named = named.when(F.col("kind") == kind, name)
    found = signals.all_signals(spark, sf_dir).withColumn("step", named).where("step IS NOT NULL").groupBy("tag", "step").agg(F.count("*").alias("items"))
    links = causal_chain(spark, sf_dir).select("tag", F.lit("chain").alias("step"), F.col("steps").alias("items"))
    alerts = signals.compound_alerts(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("items")).select("tag", F.lit("answer").alias("step"), "items")
    return done.unionByName(limits).unionByName(found).unionByName(links).unionByName(alerts).join(e, "tag", "left_semi")


def knowledge_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a machine's experience is shared, by the days from each person's first to last job on it."""
    held = ops_signals.experts(trend.records_of(table(spark, sf_dir, "maintenance")))
    return evidence.concentration(held.select("tag", "person", (F.datediff("last", "first") + 1).alias("days")), "tag", "days")


def knowledge_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds of gaps in what is known of a machine."""
    manuals = _docs(spark, sf_dir).where("document_type = 'oem_manual'").select(machine(F.col("equipment_tag")).alias("tag")).where("tag IS NOT NULL").distinct()
    failed = table(spark, sf_dir, "failure").select(machine(F.col("equipment_tag")).alias("tag")).where("tag IS NOT NULL").distinct()
    no_manual = failed.join(manuals, "tag", "left_anti").select("tag", F.lit("no_manual").alias("gap"), F.lit("failures").alias("subject"))
    held = ops_signals.experts(trend.records_of(table(spark, sf_dir, "maintenance")))
    single = held.groupBy("tag").agg(F.count("*").alias("n"), F.sum("jobs").alias("jobs"), F.min("person").alias("subject")).where("n = 1 AND jobs > 1").select("tag", F.lit("single_holder").alias("gap"), "subject")
    return extraction.knowledge_gaps(spark, sf_dir).unionByName(no_manual).unionByName(single)


def matching_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clause of each document that speaks of an anomaly, clipped to 120 characters."""
    pattern = "|".join(f"(?:{p})" for _, p, _ in text.ANOMALY_TERMS)
    d = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", text.matching_clause(F.col("text"), pattern).alias("clause"))
    return d.where("clause IS NOT NULL").select("doc_id", text.clipped(F.col("clause"), 120).alias("clause"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each text between blank lines, as headings, lists and paragraphs, counted by kind."""
    blocks = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda b: F.btrim(b, F.lit(" \t\n"))), lambda b: F.length(b) > 0)
    rows = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(blocks).alias("position", "block"))
    return rows.select("doc_id", "position", text.block_kind(F.col("block")).alias("kind"), F.length("block").alias("characters"))


def script_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of most letters of a transcript; Devanagari as Hindi or Marathi by words that only one of them has."""
    q = table(spark, sf_dir, "voice_query").where("transcript IS NOT NULL")
    counts = [F.regexp_count("transcript", F.lit(p)).alias(n) for n, p in (("latin", "[A-Za-z]"), ("devanagari", "[ऀ-ॿ]"), ("kannada", "[ಀ-೿]"), ("tamil", "[஀-௿]"))]
    rows = q.select("query_id", "transcript", *counts)
    marathi, hindi = F.regexp_count("transcript", F.lit("आहे|नाही|आणि|झाली|पाहिजे")), F.regexp_count("transcript", F.lit("है|नहीं|और|गया|चाहिए"))
    most = F.greatest("latin", "devanagari", "kannada", "tamil")
    name = F.when(most == 0, F.lit("none")).when(F.col("latin") == most, "latin").when(F.col("devanagari") == most, F.when(marathi > hindi, "mr").otherwise("hi")).when(F.col("kannada") == most, "kn").otherwise("ta")
    return rows.select("query_id", name.alias("script"))


def tag_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reconciled(table(spark, sf_dir, "tag_resolution").select("raw").distinct(), table(spark, sf_dir, "equipment"))


def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "equipment")
    named = e.select(F.col("tag").alias("key"), F.col("name"), F.lit(1).alias("place")).where("name IS NOT NULL")
    return ops.aliases(e.select(F.col("tag").alias("key"), F.col("tag").alias("name"), F.lit(0).alias("place")).unionByName(named))


def procedures_for_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures that are filed under a machine or name it, newest first, eight a machine: a report's limit."""
    d = _docs(spark, sf_dir).where("document_type = 'sop'")
    own = F.filter(F.array(machine(F.col("equipment_tag"))), lambda t: t.isNotNull())
    tags = F.array_distinct(F.concat(own, F.coalesce(scan_tags(F.col("text")), F.array().cast("array<string>"))))
    rows = d.select(F.explode(tags).alias("tag"), "doc_id", "document_date").join(table(spark, sf_dir, "equipment").select("tag"), "tag", "left_semi")
    return evidence.capped(rows, "tag", [F.desc_nulls_last("document_date"), F.asc("doc_id")], 8).select("tag", "doc_id")


def seed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key with the best way to it from any seed: fewest hops, then surest, then the first seed."""
    ways = graphs.khop_paths(spark, sf_dir)
    best = F.min(F.struct("hops", (-F.col("confidence")).alias("c"), "seed"))
    return ways.groupBy("key").agg(best.alias("b")).select("key", "b.hops", (-F.col("b.c")).alias("confidence"), "b.seed")


def graph_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture's worth of the supply graph: the fifty surest links and their ends' degrees within it; the limit is the feature."""
    e = graphs.edge_upsert(spark, sf_dir).orderBy(F.desc("confidence"), F.desc("evidence"), "source", "target", "type").limit(50)
    return e.select(F.explode(F.array("source", "target")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))


def bundle_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bundle of a machine leaves out, and why: too large by itself, or no room left."""
    d = _docs(spark, sf_dir).where("equipment_tag IS NOT NULL AND n_chars > 0 AND document_date IS NOT NULL")
    items = d.select(machine(F.col("equipment_tag")).alias("tag"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size")).where("tag IS NOT NULL")
    left = items.join(machines.bundle_knapsack(spark, sf_dir).select("tag", "id"), ["tag", "id"], "left_anti")
    return left.select("tag", "id", F.when(F.col("size") > 4000, "too large").otherwise("no room").alias("reason"))


def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the handler that their class leads to."""
    rows = extraction.question_classes(spark, sf_dir).select("class")
    handlers = spark.createDataFrame([(k, v.__name__) for k, v in HANDLERS.items()], "class string, handler string")
    return rows.join(F.broadcast(handlers), "class", "left").groupBy(F.coalesce("handler", F.lit("graph_fusion")).alias("handler")).agg(F.count("*").alias("questions"))


#: The plan that answers a class of question; any other class is answered by search.
HANDLERS = {"diagnostic": causal_chain, "history": evidence_digest, "procedure": procedures_for_tag, "compliance": procedures_for_tag}

_T = "regexp_extract_all(upper({c}), '\\b([A-Z]{{1,4}}-[0-9]{{2,5}}[A-Z]?)\\b', 1)"
_NOT = "('ISO', 'API', 'IEC', 'ASME', 'DN', 'PN', 'REV', 'RPM', 'HW', 'OISD', 'IS', 'SS')"


def _scan(c: str) -> str:
    return f"list_filter({_T.format(c=c)}, lambda t: regexp_extract(t, '^([A-Z]+)', 1) NOT IN {_NOT})"


_QT = "list_transform(regexp_extract_all(upper(transcript), '\\b([A-Z]{1,4}[- ]?[0-9]{2,5}[A-Z]?)\\b', 1), lambda t: regexp_replace(t, '^([A-Z]+)[- ]?([0-9])', '\\1-\\2'))"
_FIRST = """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS position, tag FROM (
    SELECT query_id, tag, min(i) AS i FROM (SELECT query_id, unnest(l) AS tag, generate_subscripts(l, 1) AS i FROM q) GROUP BY 1, 2)"""
_LEX = "lx AS (" + search.SQL["lexical_tfidf_topk"].strip() + ")"
_BOOST = f"""{_LEX},
    sk AS (SELECT doc_id AS query_id, list_distinct(list_concat(CASE WHEN nullif(upper(trim(equipment_tag)), '') IS NULL THEN CAST([] AS VARCHAR[]) ELSE [upper(trim(equipment_tag))] END, {_scan("title")})) AS qk FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL),
    hk AS (SELECT doc_id AS id, list_distinct({_scan("text")}) AS pk FROM documents WHERE text IS NOT NULL),
    dg AS (SELECT key, count(*) AS n FROM (SELECT unnest(pk) AS key FROM hk) GROUP BY 1), ce AS (SELECT id, max(ln(1 + n) / ln(1 + (SELECT max(n) FROM dg))) AS c FROM (SELECT id, unnest(pk) AS key FROM hk) JOIN dg USING (key) GROUP BY 1),
    qu AS (SELECT query_id, list(DISTINCT unit) AS u FROM (SELECT query_id, unnest(qk) AS tag FROM sk) JOIN equipment USING (tag) WHERE unit IS NOT NULL GROUP BY 1),
    pu AS (SELECT id, list(DISTINCT unit) AS u FROM (SELECT id, unnest(pk) AS tag FROM hk) JOIN equipment USING (tag) WHERE unit IS NOT NULL GROUP BY 1),
    cd AS (SELECT lx.query_id, lx.id, lx.score, qk, pk, len(list_intersect(qk, pk)) AS m, coalesce(c, 0) AS c, coalesce(list_has_any(qu.u, pu.u), FALSE) AS near, document_date AS dd
      FROM lx JOIN sk USING (query_id) JOIN hk USING (id) JOIN documents d ON d.doc_id = lx.id LEFT JOIN ce USING (id) LEFT JOIN qu ON qu.query_id = lx.query_id LEFT JOIN pu ON pu.id = lx.id),
    bo AS (SELECT query_id, id, score, CASE WHEN len(qk) > 0 THEN m / (len(qk) + greatest(len(pk), m) - m)::DOUBLE ELSE 0.0::DOUBLE END AS ov, c, CASE WHEN m > 0 THEN 0.9::DOUBLE WHEN near THEN 0.81::DOUBLE ELSE 0.0::DOUBLE END AS path,
      CASE WHEN dd IS NULL THEN 0.5::DOUBLE ELSE pow(2.0::DOUBLE, -greatest(date_diff('day', dd, (SELECT max(document_date) FROM documents)), 0) / 180.0::DOUBLE) END AS rec FROM cd),
    bs AS (SELECT query_id, id, score, ov, c, path, round(0.4::DOUBLE * ov + 0.2::DOUBLE * c + 0.2::DOUBLE * path + 0.2::DOUBLE * rec, 6) AS boost FROM bo)"""
_LINKS = f"""{signals._ALL},
    lk AS (SELECT tag, CASE kind WHEN 'precursor_match' THEN 1 WHEN 'threshold_approach' THEN 2 ELSE 3 END AS step, CASE kind WHEN 'threshold_approach' THEN 'limit of ' || source WHEN 'alarm_bypass' THEN 'alarm bypassed' ELSE 'precursor seen' END AS label, strength
        FROM allsig WHERE kind IN ('precursor_match', 'threshold_approach', 'alarm_bypass')
      UNION ALL SELECT upper(trim(equipment_tag)), 4, lower(trim(regexp_replace(failure_mode, '[_ -]+', ' ', 'g'))), round(least(1.0::DOUBLE, 0.4::DOUBLE + 0.2::DOUBLE * count(*)), 6) FROM failure WHERE failure_mode IS NOT NULL AND trim(equipment_tag) <> '' GROUP BY 1, 3)"""
_GREEDY = """it AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, doc_id AS id, n_chars AS size, row_number() OVER (PARTITION BY nullif(upper(trim(equipment_tag)), '') ORDER BY document_date DESC, doc_id) AS k
      FROM documents WHERE equipment_tag IS NOT NULL AND n_chars > 0 AND document_date IS NOT NULL),
    go AS (SELECT tag, id, k, CASE WHEN size <= 4000 THEN size ELSE 0 END AS used, size <= 4000 AS taken, size FROM it WHERE k = 1
      UNION ALL SELECT it.tag, it.id, it.k, go.used + CASE WHEN go.used + it.size <= 4000 THEN it.size ELSE 0 END, go.used + it.size <= 4000, it.size FROM go JOIN it ON it.tag IS NOT DISTINCT FROM go.tag AND it.k = go.k + 1)"""
QUERIES = {
    f.__name__: f
    for f in (
        question_tags, question_machines, graph_boost, graph_fusion, step_confidence, retrieval_merge, context_budget, evidence_digest, evidence_flags, filtered_search, interpretations, causal_chain, diagnostic_actions, diagnostic_table, knowledge_years, knowledge_holes, matching_clauses, text_blocks,
        script_decision, tag_reconcile, alias_table, procedures_for_tag, seed_expansion, graph_preview, bundle_drops, question_routes,
    )
}
SQL = {
    "question_tags": f"WITH q AS (SELECT query_id, {_QT} AS l FROM voice_query WHERE transcript IS NOT NULL) {_FIRST}",
    "question_machines": f"""
        WITH q AS (SELECT query_id, list_concat(CASE WHEN nullif(upper(trim(equipment_tag)), '') IS NULL THEN CAST([] AS VARCHAR[]) ELSE [upper(trim(equipment_tag))] END, coalesce({_QT}, CAST([] AS VARCHAR[]))) AS l FROM voice_query)
        SELECT * FROM ({_FIRST}) WHERE position < 6""",
    "graph_boost": f"WITH {_BOOST} SELECT query_id, id, round(ov, 6) AS overlap, round(c, 6) AS centrality, path, boost FROM bs",
    "graph_fusion": f"""
        WITH {_BOOST}, sp AS (SELECT *, min(score) OVER w AS v0, max(score) OVER w AS v1, min(boost) OVER w AS g0, max(boost) OVER w AS g1 FROM bs WINDOW w AS (PARTITION BY query_id)),
        fu AS (SELECT query_id, id, score, round(0.6::DOUBLE * (CASE WHEN v1 - v0 > 1e-12 THEN (score - v0) / (v1 - v0) WHEN v1 > 1e-12 THEN 1.0 ELSE 0.0 END) + 0.4::DOUBLE * (CASE WHEN g1 - g0 > 1e-12 THEN (boost - g0) / (g1 - g0) WHEN g1 > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS fused FROM sp),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, score DESC, id) AS rank FROM fu) SELECT query_id, id, fused, rank FROM k WHERE fused >= 0.15 OR rank = 1""",
    "step_confidence": f"""
        WITH {_LEX} SELECT query_id, round(avg(score), 6) AS retrieval, round(count(*) FILTER (score >= 0.5) / count(*)::DOUBLE * coalesce(avg(score) FILTER (score >= 0.5), 0), 6) AS generation FROM lx GROUP BY 1""",
    "retrieval_merge": f"""
        WITH {_LEX}, nw AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, doc_id, row_number() OVER (PARTITION BY nullif(upper(trim(equipment_tag)), '') ORDER BY document_date DESC NULLS LAST, doc_id) AS k FROM documents),
        u AS (SELECT query_id, id, score FROM lx UNION ALL SELECT d.doc_id, nw.doc_id, 0.6::DOUBLE FROM documents d JOIN nw ON nw.tag = nullif(upper(trim(d.equipment_tag)), '') AND k <= 3 WHERE d.doc_id % 20 = 0 AND d.title IS NOT NULL)
        SELECT query_id, id, max(score) AS score FROM u GROUP BY 1, 2""",
    "context_budget": f"""
        WITH {_LEX}, p AS (SELECT query_id, id, rank, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM lx JOIN documents ON doc_id = id),
        b AS (SELECT *, 4320 - coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p)
        SELECT query_id, id, rank, CAST(least(tokens, room) AS BIGINT) AS kept, tokens > room AS cut FROM b WHERE room >= 40""",
    "evidence_digest": """
        WITH a AS (SELECT DISTINCT nullif(upper(trim(equipment_tag)), '') AS tag FROM voice_query), n AS (SELECT unnest(['maintenance', 'failures', 'procedures', 'limits']) AS section),
        i AS (SELECT DISTINCT tag, section, item FROM (SELECT upper(trim(equipment_tag)) AS tag, 'maintenance' AS section, record_id AS item FROM maintenance UNION ALL SELECT upper(trim(equipment_tag)), 'failures', event_id FROM failure
          UNION ALL SELECT upper(trim(equipment_tag)), 'procedures', CAST(doc_id AS VARCHAR) FROM documents WHERE document_type = 'sop' UNION ALL SELECT tag, 'limits', unnest(map_keys(oem_thresholds)) FROM equipment)),
        k AS (SELECT *, row_number() OVER (PARTITION BY tag, section ORDER BY item) AS k FROM i)
        SELECT a.tag, n.section, count(item) AS found, coalesce(string_agg(item, ', ' ORDER BY item) FILTER (k <= 8), 'searched, nothing found') AS items FROM a CROSS JOIN n LEFT JOIN k ON k.tag = a.tag AND k.section = n.section WHERE a.tag IS NOT NULL GROUP BY 1, 2""",
    "evidence_flags": f"""
        WITH fg AS ({extraction.SQL["uncertainty_flags"]}), cf AS ({machines.SQL["conflict_detection"]}), d AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, max(document_date) AS last FROM documents GROUP BY 1),
        v AS (SELECT nullif(upper(trim(equipment_tag)), '') AS tag, bool_and(ocr_confidence IS NOT NULL) AS every FROM parse_outcome GROUP BY 1)
        SELECT tag, flag FROM fg UNION ALL SELECT tag, 'stale' FROM d WHERE tag IS NOT NULL AND date_diff('day', last, DATE '2024-06-30') > 45 UNION ALL SELECT DISTINCT tag, 'conflict' FROM cf UNION ALL SELECT tag, 'vision' FROM v WHERE tag IS NOT NULL AND every""",
    "filtered_search": f"""
        WITH {_LEX} SELECT query_id, id, rank FROM lx WHERE id IN (SELECT doc_id FROM documents WHERE document_type IN ('inspection_report', 'work_order', 'shift_log') AND document_date >= DATE '2024-05-01' AND lang = 'en')""",
    "interpretations": f"""
        WITH {signals._FIRED}, fg AS ({extraction.SQL["uncertainty_flags"]}),
        rd AS (SELECT tag, CASE flag WHEN 'low_ocr' THEN 'A poorly read paper may say something else.' ELSE 'A single document may not be typical.' END AS reading FROM fg UNION SELECT tag, 'The signals behind ' || rule || ' may be chance.' FROM al WHERE confidence < 0.55),
        k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY reading) AS k FROM rd) SELECT tag, reading FROM k WHERE k <= 5""",
    "causal_chain": f"""
        WITH {_LINKS}, b AS (SELECT tag, step, arg_max(label, (strength, label)) AS label, max(strength) AS s FROM lk GROUP BY 1, 2 HAVING max(strength) > 0)
        SELECT tag, string_agg(label, ' → ' ORDER BY step) AS chain, count(*) AS steps, round(0.7::DOUBLE * min(s) + 0.3::DOUBLE * avg(s), 4) AS confidence FROM b GROUP BY 1""",
    "diagnostic_actions": f"""
        WITH {_LINKS}, d AS (SELECT DISTINCT tag, step, CASE step WHEN 1 THEN 'Inspect for the earlier failure' WHEN 2 THEN 'Bring down the ' || label WHEN 3 THEN 'Restore the alarm' ELSE 'Check against ' || label END AS action FROM lk),
        k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY step, action) AS k FROM d) SELECT tag, step, action FROM k WHERE k <= 5""",
    "diagnostic_table": f"""
        WITH {_LINKS.replace(signals._ALL, signals._FIRED, 1)}, ds AS ({extraction.SQL["diagnostic_steps"]}), lb AS (SELECT tag, step, max(strength) AS s FROM lk GROUP BY 1, 2 HAVING max(strength) > 0),
        st AS (SELECT tag, step, items FROM ds UNION ALL SELECT tag, 'limits', count(*) FROM (SELECT tag, unnest(map_keys(oem_thresholds)) FROM equipment) GROUP BY 1
          UNION ALL SELECT tag, CASE kind WHEN 'precursor_match' THEN 'precursors' WHEN 'threshold_approach' THEN 'thresholds' WHEN 'alarm_bypass' THEN 'bypasses' ELSE 'anomalies' END, count(*) FROM allsig
            WHERE kind IN ('precursor_match', 'threshold_approach', 'alarm_bypass', 'maintenance_anomaly') GROUP BY 1, 2
          UNION ALL SELECT tag, 'chain', count(*) FROM lb GROUP BY 1 UNION ALL SELECT tag, 'answer', count(*) FROM al GROUP BY 1) SELECT tag, step, items FROM st WHERE tag IN (SELECT tag FROM equipment)""",
    "knowledge_years": f"""
        WITH {machines._M}, {signals._HELD}, s AS (SELECT tag, (date_diff('day', first, last) + 1) / sum(date_diff('day', first, last) + 1) OVER (PARTITION BY tag)::DOUBLE AS p FROM held) SELECT tag, count(*) AS holders, round(sum(p * p), 6) AS hhi FROM s GROUP BY 1""",
    "knowledge_holes": f"""
        WITH kg AS ({extraction.SQL["knowledge_gaps"]}), {machines._M}, {signals._HELD} SELECT tag, gap, subject FROM kg
        UNION ALL SELECT DISTINCT upper(trim(equipment_tag)), 'no_manual', 'failures' FROM failure WHERE trim(equipment_tag) <> '' AND upper(trim(equipment_tag)) NOT IN (SELECT upper(trim(equipment_tag)) FROM documents WHERE document_type = 'oem_manual' AND equipment_tag IS NOT NULL)
        UNION ALL SELECT tag, 'single_holder', min(person) FROM held GROUP BY 1 HAVING count(*) = 1 AND sum(jobs) > 1""",
    "matching_clauses": f"""
        WITH c AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?][ \\t\\n\\r\\f\\v]+|[\\r\\n]+')) AS c, unnest(range(len(string_split_regex(text, '[.!?][ \\t\\n\\r\\f\\v]+|[\\r\\n]+')))) AS i FROM documents WHERE text IS NOT NULL),
        h AS (SELECT doc_id, i, trim(regexp_replace(c, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM c WHERE EXISTS (SELECT 1 FROM {ANOMALY_SQL} WHERE regexp_matches(lower(regexp_replace(c.c, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), pattern))),
        f AS (SELECT doc_id, arg_min(c, i) AS c FROM h GROUP BY 1) SELECT doc_id, CASE WHEN length(c) > 120 THEN rtrim(substring(c, 1, 119)) || '…' ELSE c END AS clause FROM f""",
    "text_blocks": """
        WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t]*\\n'), lambda b: trim(b, ' ' || chr(9) || chr(10))), lambda b: length(b) > 0) AS l FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS position, unnest(l) AS block FROM b), t AS (SELECT *, trim(string_split(block, chr(10))[1]) AS f, len(string_split(block, chr(10))) = 1 AS one FROM e)
        SELECT doc_id, position, CASE WHEN one AND length(f) BETWEEN 1 AND 90 AND (starts_with(f, '#') OR (length(regexp_replace(f, '[^A-Za-z]', '', 'g')) > 2 AND regexp_replace(f, '[^A-Za-z]', '', 'g') = upper(regexp_replace(f, '[^A-Za-z]', '', 'g')))
            OR regexp_matches(f, '^[0-9]+([.][0-9]+)*[.)]?[ \\t\\n\\r\\f\\v]+[A-Z]') OR (length(f) <= 60 AND ends_with(f, ':'))) THEN 'heading'
          WHEN regexp_matches(f, '^([-*•]|[0-9]+[.)])[ \\t\\n\\r\\f\\v]') THEN 'list' ELSE 'paragraph' END AS kind, CAST(length(block) AS INTEGER) AS characters FROM t""",
    "script_decision": """
        WITH c AS (SELECT query_id, transcript AS t, len(regexp_extract_all(transcript, '[A-Za-z]')) AS l, len(regexp_extract_all(transcript, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(transcript, '[ಀ-೿]')) AS k, len(regexp_extract_all(transcript, '[஀-௿]')) AS a FROM voice_query WHERE transcript IS NOT NULL)
        SELECT query_id, CASE WHEN greatest(l, d, k, a) = 0 THEN 'none' WHEN l = greatest(l, d, k, a) THEN 'latin' WHEN d = greatest(l, d, k, a) THEN
          CASE WHEN len(regexp_extract_all(t, 'आहे|नाही|आणि|झाली|पाहिजे')) > len(regexp_extract_all(t, 'है|नहीं|और|गया|चाहिए')) THEN 'mr' ELSE 'hi' END WHEN k = greatest(l, d, k, a) THEN 'kn' ELSE 'ta' END AS script FROM c""",
    "tag_reconcile": """
        WITH p AS (SELECT DISTINCT raw, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS x FROM tag_resolution WHERE raw IS NOT NULL),
        g AS (SELECT raw, x, translate(substring(x, 1, p), '015826', 'OISBZG') || '-' || translate(substring(x, p + 1, length(x) - p - s), 'OQDILZSGTB', '0001125678') || CASE WHEN s = 1 THEN translate(substring(x, length(x), 1), '015826', 'OISBZG') ELSE '' END AS tag
          FROM p, (SELECT unnest([1, 2, 3]) AS p) a, (SELECT unnest([0, 1]) AS s) b WHERE length(x) BETWEEN 3 AND 9),
        r AS (SELECT raw, tag, min(levenshtein(replace(tag, '-', ''), x)) AS c FROM g WHERE regexp_full_match(tag, '[A-Z]{1,3}-[0-9]{2,5}[A-Z]?') GROUP BY 1, 2),
        v AS (SELECT r.*, e.tag IS NOT NULL AS ok FROM r LEFT JOIN equipment e USING (tag)), s AS (SELECT *, greatest(100 - 6 * c - CASE WHEN ok THEN 0 ELSE 40 END, 0) AS score FROM v),
        k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY raw ORDER BY score DESC, tag)), f AS (SELECT *, coalesce(score - nxt <= 5, FALSE) AS amb FROM k WHERE k = 1),
        z AS (SELECT *, score / 100.0::DOUBLE * CASE WHEN amb THEN 0.72::DOUBLE ELSE 1.0::DOUBLE END - 0.09::DOUBLE * c AS conf FROM f)
        SELECT raw, tag, CAST(c AS INTEGER) AS corrections, ok AS verified, amb AS ambiguous, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN ok THEN conf ELSE least(conf, 0.74::DOUBLE) END)), 6) AS confidence FROM z""",
    "alias_table": """
        WITH n AS (SELECT tag AS key, tag AS name, 0 AS place FROM equipment UNION ALL SELECT tag, name, 1 FROM equipment WHERE name IS NOT NULL), a AS (SELECT key, place, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS alias FROM n)
        SELECT alias, arg_min(key, (place, key)) AS key FROM a WHERE length(alias) >= 3 GROUP BY 1""",
    "procedures_for_tag": f"""
        WITH d AS (SELECT DISTINCT unnest(list_concat(CASE WHEN nullif(upper(trim(equipment_tag)), '') IS NULL THEN CAST([] AS VARCHAR[]) ELSE [upper(trim(equipment_tag))] END, coalesce({_scan("text")}, CAST([] AS VARCHAR[])))) AS tag, doc_id, document_date FROM documents WHERE document_type = 'sop'),
        k AS (SELECT tag, doc_id, row_number() OVER (PARTITION BY tag ORDER BY document_date DESC NULLS LAST, doc_id) AS k FROM d WHERE tag IN (SELECT tag FROM equipment)) SELECT tag, doc_id FROM k WHERE k <= 8""",
    "seed_expansion": f"""
        WITH w AS ({graphs.SQL["khop_paths"]}), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hops, confidence DESC, seed) AS k FROM w) SELECT key, hops, confidence, seed FROM k WHERE k = 1""",
    "graph_preview": f"""
        WITH e AS ({graphs.SQL["edge_upsert"]}), t AS (SELECT * FROM e ORDER BY confidence DESC, evidence DESC, source, target, type LIMIT 50) SELECT key, count(*) AS links FROM (SELECT source AS key FROM t UNION ALL SELECT target FROM t) GROUP BY 1""",
    "bundle_drops": f"WITH RECURSIVE {_GREEDY} SELECT tag, id, CASE WHEN size > 4000 THEN 'too large' ELSE 'no room' END AS reason FROM go WHERE tag IS NOT NULL AND NOT taken",
    "bundle_knapsack": f"WITH RECURSIVE {_GREEDY} SELECT tag, id FROM go WHERE taken",
    "question_routes": f"""
        WITH c AS ({extraction.SQL["question_classes"]}) SELECT CASE class WHEN 'diagnostic' THEN 'causal_chain' WHEN 'history' THEN 'evidence_digest' WHEN 'procedure' THEN 'procedures_for_tag' WHEN 'compliance' THEN 'procedures_for_tag' ELSE 'graph_fusion' END AS handler,
          count(*) AS questions FROM c GROUP BY 1""",
}
