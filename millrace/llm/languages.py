"""Problem 5: the language of each transcript and of each of its segments, with a confidence.

Evidence is fused as in Bayes' rule. Every word has a log-likelihood per language, from its
script and from counts of words per language; a best path over the words (Viterbi) pays for
each change of language, less at punctuation, so that tags, numbers and borrowed words begin
no segment. The declared language and the languages usual for the machine enter as prior:
P(language | machine), smoothed towards P(language), from one grouped aggregation.

The word counts are learned from the corpus itself: a first pass labels words by script,
declared language and a few function words; counts per (word, language) are summed by a
grouped aggregation into a table of likelihoods, one row a word, which stays distributed.
The second pass works on buckets of transcripts: the distinct words of a bucket are joined
to that table, so what travels is a bucket's vocabulary and not every word of every text.
The machine's usual languages are those that the first pass found, not the declared ones.

Defined results: null, empty and wordless transcripts (tags and numbers only) -> no segment;
null, blank and unknown declared languages and null machines -> no evidence; very long
transcripts are read whole; repeated rows give repeated segments of the same kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.clock import machine
from millrace.operators.skew import hot_keys, join_to_unique
from millrace.session import checkpointed, spread

LANGUAGES = ("en", "hi", "mr", "ta", "kn")
ROWS_A_BUCKET = 5_000
CLIP, FOREIGN, BORROWED = 2.5, 7.0, 2.2
SWITCH, SWITCH_AT_STOP = 6.5, 3.0
DECLARED, USUAL, SMOOTHING = 0.8, 0.3, 20.0

#: Frequent function words, fixed values: what the first pass knows of languages that share a script.
SEEDS = {
    ("latin", "en"): "the of and is was were has have had been be are in on at to from with for by that this what when why who how which not no nobody it its near since after before during until while please show tell should could there again yet all me we our do does did an a as or".split(),
    ("latin", "hi"): "hai hain hua hui ho ka ki ke ko se mein main par aur bhi nahin nahi kya kyon kyun yeh woh mujhe humne hamne aap raha rahi rahe gaya gayi kiya karna karo chahiye lekin koi kal aaj subah raat jaldi bahut ne baad tak kab kahan wala jaise abhi".split(),
    ("devanagari", "hi"): "है हैं था थी थे हो का की के को से में पर और भी नहीं क्या क्यों यह वह मुझे हमने आप रहा रही रहे गया गई किया करना करो चाहिए लेकिन कोई कल आज सुबह रात बहुत ने बाद तक कब कर दिया हुआ हुई कृपया कि".split(),
    ("devanagari", "mr"): "आहे आहेत होता होती होते चा ची चे च्या ला ना मध्ये वर आणि पण नाही काय हा ही हे तो ती ते मला आम्ही तुम्ही केले केली केला पाहिजे काही कोणी आज सकाळी रात्री खूप नंतर पर्यंत कधी झाली झाला झाले येत कृपया अजून नंतरही".split(),
}
_SCRIPTS = (("devanagari", "ऀ-ॣॲ-ॿ", ("hi", "mr")), ("tamil", "஀-௿", ("ta",)), ("kannada", "ಀ-೿", ("kn",)), ("latin", "A-Za-zÀ-ɏ", ("en", "hi")))
_TOKEN = re.compile(
    r"(?P<tag>[A-Za-z]{0,4}[-–/ ]?\d[\w.:/%-]*)|" + "|".join(rf"(?P<{n}>[{r}][{r}‌‍'’]*)" for n, r, _ in _SCRIPTS) + r"|(?P<stop>[.?!।॥;,\n/|]|\s[-–—]\s|[-–—]\s)"
)
_SPOKEN = {n: langs for n, _, langs in _SCRIPTS}
#: By the first letter of a word's key, its script: which languages are written in it, and what the others get.
_OWN = {n[0]: np.array([lang in langs for lang in LANGUAGES]) for n, langs in _SPOKEN.items()}
_OTHER = {n[0]: np.float32(-BORROWED if n == "latin" else -FOREIGN) for n in _SPOKEN}


def words_of(text: str) -> tuple[list[str], list[bool]]:
    """(keys, at_stop) in order; a key is the script's first letter and the word, at_stop says that punctuation stands before it."""
    keys, stops, stop = [], [], True
    for m in _TOKEN.finditer(text if text.isascii() else unicodedata.normalize("NFKC", text)):
        kind = m.lastgroup
        if kind == "stop":
            stop = True
        elif kind != "tag":
            keys.append(kind[0] + m.group().lower().strip("'’"))
            stops.append(stop)
            stop = False
    return keys, stops


def seed_rows() -> dict[str, np.ndarray]:
    """Log-likelihoods per language of the function words alone, by key."""
    rows: dict[str, np.ndarray] = {}
    for (script, lang), words in SEEDS.items():
        for w in words:
            for other in _SPOKEN[script]:
                if other != lang and w not in SEEDS[script, other]:
                    rows.setdefault(script[0] + w, np.zeros(len(LANGUAGES), np.float32))[LANGUAGES.index(other)] = -CLIP
    return rows


def emissions(keys: list[str], rows: np.ndarray) -> np.ndarray:
    """The log-likelihoods of words, given those in the languages of their own script."""
    script = [k[0] for k in keys]
    own = np.array([_OWN[c] for c in script]).reshape(-1, len(LANGUAGES))
    return np.where(own, rows, np.array([_OTHER[c] for c in script], np.float32)[:, None])


def best_paths(e: np.ndarray, stops: np.ndarray, sizes: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The language (as an index) of each word, texts one after the other.

    Every step is taken for all texts that are that long at once.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    score, path = prior[order].astype(np.float64), np.zeros(len(e), np.int8)
    if not len(e):
        return path
    back = np.zeros((len(e), len(LANGUAGES)), np.int8)
    live = np.searchsorted(-left, -np.arange(left[0]), side="left")  # texts longer than t
    own = np.arange(len(LANGUAGES), dtype=np.int8)
    for t in range(left[0]):
        m = live[t]
        at = begin[:m] + t
        if t:
            top = score[:m].argmax(1)
            change = score[np.arange(m), top] - np.where(stops[at], SWITCH_AT_STOP, SWITCH)
            stay = score[:m] >= change[:, None]
            back[at] = np.where(stay, own, top[:, None])
            score[:m] = np.where(stay, score[:m], change[:, None])
        score[:m] += e[at]
    last = score.argmax(1).astype(np.int8)
    for t in range(left[0] - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        path[at] = last[:m]
        if t:
            last[:m] = back[at, last[:m]]
    return path


def declared_code(label: Column) -> Column:
    """The part of a declared language before - or _, in lower case."""
    return F.lower(F.trim(F.regexp_extract(label, "^([^-_]*)", 1)))


def priors(declared: list[str | None], usual: np.ndarray | None) -> np.ndarray:
    usual = np.full((len(declared), len(LANGUAGES)), 1 / len(LANGUAGES)) if usual is None else usual
    return USUAL * np.log(np.maximum(usual, 1e-6)) + DECLARED * np.array([[lang == d for lang in LANGUAGES] for d in declared]).reshape(-1, len(LANGUAGES))


_FIRST = "row long, keys array<string>, stops array<boolean>, langs array<tinyint>, most int"


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = seed_rows()
    nothing = np.zeros(len(LANGUAGES), np.float32)
    for batch in batches:
        rows, keys, stops, sizes, declared = [], [], [], [], []
        for row, text, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own, at_stop = words_of(text)
            if own:
                rows.append(row)
                keys += own
                stops += at_stop
                sizes.append(len(own))
                declared.append(label)
        sizes = np.array(sizes, np.int64)
        stops = np.array(stops, bool)
        e = emissions(keys, np.array([known.get(k, nothing) for k in keys], np.float32).reshape(-1, len(LANGUAGES)))
        path = best_paths(e, stops, sizes, priors(declared, None))
        text_no = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.zeros((len(sizes), len(LANGUAGES)), np.int64)
        np.add.at(counts, (text_no, path), 1)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((keys, pa.string()), (stops, pa.bool_()), (path, pa.int8()))]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *lists, pa.array(counts.argmax(1), pa.int32())], ["row", "keys", "stops", "langs", "most"])


def likelihoods(first: DataFrame) -> DataFrame:
    """(key, n, e): clipped log-likelihoods of each word in each language, 0 for the likeliest.

    Exact counts of every word; only the languages' totals, five numbers, reach the driver.
    """
    spoken = F.lit(False)
    for script, own in _OWN.items():
        spoken = spoken | (F.startswith("key", F.lit(script)) & F.col("lang").isin([k for k in range(len(LANGUAGES)) if own[k]]))
    words = first.select(F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("langs").alias("lang"))).alias("w")).select("w.key", "w.lang").where(spoken)
    counts = words.groupBy("key").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("lang") == k, 1)).alias(f"c{k}") for k in range(len(LANGUAGES))])
    counts = checkpointed(counts)
    total = [n or 0 for n in counts.agg(*[F.sum(f"c{k}") for k in range(len(LANGUAGES))]).first()]
    logs = [F.log(F.greatest((F.col(f"c{k}") + 0.5 * total[k] / max(1, sum(total))) / max(1, total[k]), F.lit(1e-12))) for k in range(len(LANGUAGES))]
    best = F.greatest(*logs)
    return counts.select("key", "n", F.array(*[F.greatest(x - best, F.lit(-CLIP)).cast("float") for x in logs]).alias("e"))


def machine_priors(found: DataFrame) -> DataFrame:
    """(tag, n, usual): P(language | machine), smoothed towards P(language). found: tag, most (a language's index)."""
    per = found.groupBy("tag").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("most") == k, 1)).alias(f"c{k}") for k in range(len(LANGUAGES))])
    per = checkpointed(per)
    # The parent level of the hierarchy: five numbers.
    whole = per.agg(*[F.sum(f"c{k}") for k in range(len(LANGUAGES))]).first()
    n = sum(x or 0 for x in whole)
    usual = F.array(*[((F.col(f"c{k}") + F.lit(SMOOTHING * ((whole[k] or 0) + 1) / (n + len(LANGUAGES)))) / (F.col("n") + SMOOTHING)).cast("float") for k in range(len(LANGUAGES))])
    return per.where("tag IS NOT NULL").select("tag", "n", usual.alias("usual"))


_LABELS = "query_id long, segment_no int, segments int, lang string, confidence double, declared string"


def _matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are not null, their values as a matrix of one column a language)."""
    valid = pc.is_valid(lists).to_numpy(zero_copy_only=False)
    return valid, lists.drop_null().combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(LANGUAGES))


def _second_pass(texts: pa.Table, words: pa.Table) -> pa.Table:
    keys = texts["keys"].combine_chunks()
    sizes = np.diff(keys.offsets.to_numpy()).astype(np.int64)
    flat = keys.flatten()
    seen, rows = _matrix(words["e"])
    table = np.zeros((len(seen) + 1, len(LANGUAGES)), np.float32)  # the last row: words that the corpus does not tell apart
    table[:-1][seen] = rows
    distinct = pc.unique(flat)
    place = pc.fill_null(pc.index_in(distinct, words["key"].combine_chunks()), len(seen)).to_numpy(zero_copy_only=False)
    e = emissions(distinct.to_pylist(), table[place])[pc.index_in(flat, distinct).to_numpy(zero_copy_only=False)]
    known, own = _matrix(texts["usual"])
    usual = np.full((len(sizes), len(LANGUAGES)), 1 / len(LANGUAGES))
    usual[known] = own
    declared = texts["declared"].to_pylist()
    prior = priors(declared, usual)
    path = best_paths(e, texts["stops"].combine_chunks().flatten().to_numpy(zero_copy_only=False), sizes, prior)
    text_no = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text_no[1:] != text_no[:-1])]) if len(path) else np.zeros(0, np.int64)
    owner = text_no[begins]
    log = prior[owner] + np.add.reduceat(e.astype(np.float64), begins, axis=0) if len(begins) else np.zeros((0, len(LANGUAGES)))
    odds = np.exp(log - log.max(1, keepdims=True)) if len(log) else log
    sure = odds[np.arange(len(begins)), path[begins]] / odds.sum(1)
    number = np.arange(len(begins)) - np.searchsorted(owner, owner) + 1
    several = np.bincount(owner, minlength=len(sizes))
    ids = texts["query_id"].combine_chunks().take(pa.array(owner))
    labels = texts["declared"].combine_chunks().take(pa.array(owner))
    return pa.table([ids, pa.array(number, pa.int32()), pa.array(several[owner], pa.int32()), pa.array([LANGUAGES[k] for k in path[begins]], pa.string()), pa.array(sure, pa.float64()), labels], ["query_id", "segment_no", "segments", "lang", "confidence", "declared"])


def label_segments(queries: DataFrame) -> DataFrame:
    """(query_id, segment_no, segments, lang, confidence, declared) of every transcript with words.

    queries: query_id, transcript, language, equipment_tag.
    """
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("transcript").alias("text"), declared_code(F.col("language")).alias("declared"), machine(F.col("equipment_tag")).alias("tag"))
    # The row number is written with the row, so that repeated query ids stay apart.
    rows = checkpointed(spread(rows.where("text <> ''")).withColumn("row", F.monotonically_increasing_id()))
    first = checkpointed(rows.select("row", "text", "declared").mapInArrow(_first_pass, _FIRST))
    buckets = max(1, -(-first.count() // ROWS_A_BUCKET))
    first = first.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    words = likelihoods(first)
    own = first.select("bucket", F.explode("keys").alias("key")).distinct()
    own = join_to_unique(own, words.select("key", "e"), "key", hot_keys(words, "key", "n"), F.xxhash64("bucket"))
    found = first.select("row", "most", "bucket", "keys", "stops").join(rows.select("row", "query_id", "declared", "tag"), "row")
    usual = machine_priors(found.select("tag", "most"))
    texts = join_to_unique(found.drop("most"), usual.select("tag", "usual"), "tag", hot_keys(usual, "tag", "n"), F.xxhash64("row"))
    tasks = max(1, -(-buckets // 4))
    left = texts.select("bucket", "query_id", "declared", "keys", "stops", "usual").repartition(tasks, "bucket").groupBy("bucket")
    right = own.select(F.col("bucket").alias("group"), "key", "e").repartition(tasks, "group").groupBy("group")
    return left.cogroup(right).applyInArrow(_second_pass, _LABELS)


def wrong_labels(queries: DataFrame) -> DataFrame:
    """(query_id, segment_no, lang) of transcripts with several segments or a label that is not right."""
    found = label_segments(queries)
    return found.where((F.col("segments") > 1) | ~F.coalesce(F.col("declared") == F.col("lang"), F.lit(False))).select("query_id", "segment_no", "lang")
