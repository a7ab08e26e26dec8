"""Documents: identity, chunking, term counts, measurements, similarity, hash embeddings."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.clock import machine
from millrace.functions.text import block_kind, sentences
from millrace.session import spread


def by_content(docs: DataFrame) -> DataFrame:
    """(content_hash, first_doc, copies) of the distinct texts; null texts have no content."""
    return docs.where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def not_loaded(new: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows of ``new`` whose text is not among ``loaded``."""
    key = F.sha2("text", 256)
    return new.withColumn("content_hash", key).join(loaded.select(key.alias("content_hash")).distinct(), "content_hash", "left_anti")


def term_counts(docs: DataFrame, terms: list[tuple[str, str, float]]) -> DataFrame:
    """(doc_id, term, hits, weight) of the terms a text has; one pass, no shuffle."""
    low = F.lower("text")
    counted = F.array(*[F.struct(F.lit(n).alias("term"), F.regexp_count(low, F.lit(p)).alias("hits"), F.lit(w).alias("weight")) for n, p, w in terms])
    # One look for any of them first: most texts have none, and counting is the dear part.
    any_term = low.rlike("|".join(f"(?:{p})" for _, p, _ in terms))
    return spread(docs.where("text IS NOT NULL")).where(any_term).select("doc_id", F.inline(F.filter(counted, lambda c: c["hits"] > 0)))


def measurements(docs: DataFrame) -> DataFrame:
    """(doc_id, value, unit, times) of the measured values of a text."""
    found = F.regexp_extract_all("text", F.lit(r"\b[0-9]+(?:\.[0-9]+)? (?:mm/s|mm|bar|kPa|degC|m3/h|percent|hours|minutes)\b"), F.lit(0))
    rows = docs.where("text IS NOT NULL").select("doc_id", F.explode(found).alias("m"))
    return rows.groupBy("doc_id", F.regexp_extract("m", "^([0-9.]+) ", 1).cast("double").alias("value"), F.regexp_extract("m", " (.*)$", 1).alias("unit")).agg(F.count("*").alias("times"))


def packed_chunks(tokens: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """[begin, end) ranges of sentences: as many as fit, then back by up to ``overlap`` tokens."""
    if not tokens:
        return []
    total = np.concatenate([[0], np.cumsum(tokens)])
    out, begin, last = [], 0, len(tokens)
    while not out or out[-1][1] < last:
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + size, "right")) - 1)
        out.append((begin, end))
        begin = max(begin + 1, int(np.searchsorted(total, total[end] - overlap, "left")))
    return out


def chunks(docs: DataFrame, size: int = 384, overlap: int = 50, least: int = 40) -> DataFrame:
    """(doc_id, chunk_no, sentences, tokens, text): atoms packed up to ``size`` tokens.

    Atoms are headings and the sentences of the other blocks between blank lines; one of more
    than ``size`` tokens is cut between words. Chunks under ``least`` tokens are dropped unless
    the document has no other. Blocks and sentences are split in the JVM; only the sequential
    packing of one document's atoms runs in Python.
    """
    word = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")

    def cost_of(text: str) -> int:
        return max(1, round(1.33 * len(word.findall(text))))

    def fitting(atom: str) -> list[str]:
        if cost_of(atom) <= size:
            return [atom]
        out, own, n = [], [], 0
        for piece in re.findall(r"\S+", atom):
            k = len(word.findall(piece))
            if own and round(1.33 * (n + k)) > size:
                out.append(" ".join(own))
                own, n = [], 0
            own.append(piece)
            n += k
        return [*out, " ".join(own)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, parts in frame.itertuples(index=False):
                parts = [p for atom in parts for p in fitting(atom)]
                cost = [cost_of(p) for p in parts]
                found = [(b - a, sum(cost[a:b]), " ".join(parts[a:b])) for a, b in packed_chunks(cost, size, overlap)]
                kept = [c for c in found if c[1] >= least] or sorted(found, key=lambda c: -c[1])[:1]
                rows += [(doc, k, n, t, x) for k, (n, t, x) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "sentences", "tokens", "text"])

    blocks = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda b: F.btrim(b, F.lit(" \t\r\n"))), lambda b: F.length(b) > 0)
    atoms = F.flatten(F.transform(blocks, lambda b: F.when(block_kind(b) == "heading", F.array(b)).otherwise(sentences(b))))
    split = spread(docs.where("text IS NOT NULL")).select("doc_id", atoms.alias("parts")).where(F.size("parts") > 0)
    return split.mapInPandas(run, "doc_id long, chunk_no int, sentences int, tokens int, text string")


def common_subsequence(p: str, q: str) -> int:
    """The length of the longest common subsequence, a whole row of the usual table in each machine word of q's bits."""
    at: dict[str, int] = {}
    for k, c in enumerate(q):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(q)) - 1
    row = full  # bits that are 0 are steps of the row
    for c in p:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(q) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two texts by their shared and own words, in [0, 1]; order does not count."""
    x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    first, second = (" ".join([*([shared] if shared else []), *sorted(z)]) for z in (x - y, y - x))

    def ratio(p: str, q: str) -> float:
        return 2 * common_subsequence(p, q) / (len(p) + len(q)) if p or q else 1.0

    best = ratio(first, second)
    return max(best, ratio(shared, first), ratio(shared, second)) if shared else best


def similar_texts(findings: DataFrame, precursors: DataFrame, least: float = 0.72) -> DataFrame:
    """(event_id, record_id, similarity): the most similar finding of the same machine per event.

    Equal texts are scored once. Texts meet on machine and word; a pair is scored if it shares
    at least a third of the words of the text that has fewer, and only the best pair is kept.
    """

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a, b):
            if p not in known:
                known[p] = token_set_ratio(*p)
            out.append(known[p])
        return pd.Series(out)

    left = findings.where(F.length("findings") > 0).select("record_id", machine(F.col("equipment_tag")).alias("tag"), "findings").where("tag IS NOT NULL")
    right = precursors.where(F.length("precursor_text") > 0).select("event_id", machine(F.col("equipment_tag")).alias("tag"), "precursor_text").where("tag IS NOT NULL")
    # Texts repeat far more than machines: one row per machine and text on either side.
    left = left.groupBy("tag", "findings").agg(F.min("record_id").alias("record_id"))
    texts = right.select("tag", "precursor_text").distinct()
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0)))
    own = left.select("tag", F.md5("findings").alias("f"), words("findings").alias("w"))
    other = texts.select("tag", F.md5("precursor_text").alias("p"), words("precursor_text").alias("w"))
    said = own.select("tag", "f", F.size("w").alias("n"), F.explode("w").alias("word")).join(other.select("tag", "p", F.size("w").alias("m"), F.explode("w").alias("word")), ["tag", "word"])
    shared = said.groupBy("tag", "f", "p", "n", "m").agg(F.count("*").alias("shared")).where(3 * F.col("shared") >= F.least("n", "m")).select("tag", "f", "p")
    pairs = shared.join(left.withColumn("f", F.md5("findings")), ["tag", "f"]).join(texts.withColumn("p", F.md5("precursor_text")), ["tag", "p"])
    pairs = pairs.withColumn("similarity", F.round(similarity("findings", "precursor_text"), 6)).where(F.col("similarity") >= least)
    best = pairs.groupBy("tag", "precursor_text").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "record_id")).alias("b"))
    return right.join(best, ["tag", "precursor_text"]).select("event_id", "b.record_id", (-F.col("b.s")).alias("similarity"))


@lru_cache(maxsize=200_000)
def _slots(gram: str) -> tuple[int, int]:
    """The two numbers of a gram; texts share most of their grams."""
    digest = hashlib.blake2b(gram.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")


def hash_embedding(text: str, dims: int) -> list[float]:
    """Words, word pairs and character 4-grams hashed to two signed slots each; unit length."""
    words = re.findall(r"\w+", text.lower())
    grams = Counter()
    for w in words:
        grams["w:" + w] += 1.0
        for k in range(len(w) - 3):
            grams["c:" + w[k : k + 4]] += 0.3
    for a, b in zip(words, words[1:]):
        grams[f"b:{a} {b}"] += 0.45
    out = np.zeros(dims)
    for gram, weight in grams.items():
        value = weight * (1 + math.log(max(weight, 1.0))) / math.sqrt(2)
        for number in _slots(gram):
            out[number % dims] += value if number >> 63 else -value
    size = np.linalg.norm(out)
    return (out / size if size else out).tolist()


def hash_embeddings(docs: DataFrame, dims: int = 768) -> DataFrame:
    """(doc_id, embedding) of every non-null text."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([hash_embedding(t, dims) for t in texts])

    return spread(docs.where("text IS NOT NULL")).select("doc_id", embed("text").alias("embedding"))
