"""Problem 2: noise of scanned pages, found per line and repaired into paragraphs.

Furniture: lines at the edges of a page that are page numbers, or whose letters stand at the
same edge of many pages of their outcome, or do so in other outcomes and are hardly ever
seen elsewhere (edge-line counts by a grouped aggregation).

Misreadings: the anagram hash of a word is the sum of its characters' values, so a confusion
of characters changes it by a fixed difference, wherever it occurs. Rare words are joined in
SQL to words that are much more frequent on hash plus difference, for one or two confusions,
verified by levenshtein(), and ranked by edits and frequency. Tags are corrected in the same
way against the registry.

Hyphens: the parts of a word cut at a line end are joined if the joined word is better known
in the corpus than the compound with its own hyphen.

An outcome is scanned if it or one of its blocks has an OCR confidence. Defined results: null
and empty texts and blank lines have no defect; null pages count as one page; repeated
blocks are judged alike; without a registry, tags are not corrected; no outcomes -> no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.rows import map_rows
from millrace.operators.skew import hot_keys, join_to_measured
from millrace.session import checkpointed, spread

#: Confusions as (right, wrong), fixed values; the second list is for tags, of digits taken for letters.
CONFUSIONS = [
    ("e", "c"), ("i", "l"), ("t", "+"), ("a", "ä"), ("n", "ri"), ("o", "0"), ("l", "1"), ("s", "5"), ("d", "cl"), ("u", "ii"), ("c", "¢"),
    ("g", "9"), ("h", "b"), ("m", "rn"), ("v", "y"), ("b", "6"), ("f", "ƒ"), ("w", "vv"), ("r", "n"), ("li", "h"), ("i", "1"), ("b", "8"), ("rn", "m"), ("cl", "d"),
]
TAG_CONFUSIONS = [("1", "l"), ("0", "o"), ("5", "s"), ("2", "z"), ("8", "b"), ("6", "g"), ("6", "b"), ("9", "g"), ("1", "i"), ("7", "t"), ("4", "a")]
MUCH, LEAST = 8, 3  # how much more frequent, and how frequent at least, the right word is
EDGE = 3  # lines from the top and bottom of a page that are looked at first for furniture
EDGE_SHARE, PAGE_SHARE, OUTCOMES = 0.9, 0.45, 2

# What is confused is made alike: characters first, then pairs of what these have become.
_LOOSE = str.maketrans({"c": "e", "¢": "e", "1": "i", "l": "i", "|": "i", "0": "o", "5": "s", "9": "g", "+": "t", "6": "b", "8": "b", "y": "v", "ä": "a", "h": "b", "u": "b", "n": "r", "ƒ": "f"})
_ONE = re.compile(r"ii|ei|rr|ri|vv")
_ONES = {"ii": "b", "ei": "d", "rr": "m", "ri": "r", "vv": "w"}
# Words before a page number, and between it and the number of pages.
PAGE_WORDS, OF_WORDS = ("page", "pg", "p", "sheet", "seite", "blatt", "no"), ("of", "von", "de", "sur", "/")
_NUMERAL = re.compile(r"[0-9lioszb|]{1,4}|[ivxlc1]{1,7}")
_BETWEEN = re.compile(r"[\s·()\[\]–—-]+|(?<=[^\W\d_])[.:]+\s*|[.:]$|(?=/)|(?<=/)")
_MARKS = "-‐‑¬\u00ad"
_MARK = re.compile(r"(?P<left>\S*[^\W\d_]\S*?)(?P<mark>[-‐‑¬­])\s*$")
_HEAD = re.compile(r"^\s*(?P<right>[^\W\d_][^\s]*)")
_TAG = re.compile(r"^[^\W_]{1,4}-[^\W_]{2,6}$")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[-‐‑/]")
_PARTS = re.compile(r"[\s|/—–\d#]+")
_WORDY = re.compile(r"(?:[^\W\d_].*?){3}")
_STRIP = ".,;:()[]{}\"'’“”!?«»„…*<>"


class Known(dict):
    """What a function gives for tokens, kept while they are few: a corpus repeats its words."""

    def __init__(self, of, most: int = 200_000) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, token: str):
        if len(self) >= self.most:
            self.clear()
        self[token] = out = self.of(token)
        return out


def _fold(token: str) -> str:
    text = _ONE.sub(lambda m: _ONES[m.group()], token.lower().translate(_LOOSE))
    return "".join(_LETTERS.findall(text))


_FOLDS = Known(_fold)
#: The folded parts of a token that have three letters.
_WORDS_IN = Known(lambda token: tuple(_FOLDS[p] for p in _PARTS.split(token) if _WORDY.search(p)))


def edge_key(line: str) -> str:
    """The letters of a line with confusable ones made alike; equal for a header and its misreadings."""
    return "".join(map(_FOLDS.__getitem__, line.split()))


def is_page_number(line: str) -> bool:
    """One numeral, with a word for page before it and a number of pages behind it at most."""
    if len(line) > 40 or len(text := line.strip()) > 24:
        return False
    parts = [p for p in _BETWEEN.split(text.lower()) if p]
    if len(parts) > 1 and _FOLDS[parts[0]] in _PAGE_FOLDS:
        parts = parts[1:]
    if len(parts) == 3 and (parts[1] == "/" or _FOLDS[parts[1]] in _OF_FOLDS):
        parts = parts[::2]
    elif len(parts) > 1:
        return False
    return bool(parts) and all(map(_NUMERAL.fullmatch, parts))


def layout(blocks) -> list[dict]:
    """The lines with characters of an outcome in reading order, with their places on the pages."""
    lines, pages = [], defaultdict(list)
    order = sorted(enumerate(blocks), key=lambda x: (x[1]["page"] if x[1]["page"] is not None else -1, x[1]["block_index"] if x[1]["block_index"] is not None else x[0]))
    for k, block in order:
        page = block["page"] if block["page"] is not None else -1
        for number, text in enumerate((block["text"] or "").split("\n"), 1):
            if text.strip():
                line = {"block": block["block_index"] if block["block_index"] is not None else k, "number": number, "text": text, "page": page}
                lines.append(line)
                pages[page].append(line)
    for own in pages.values():
        for k, line in enumerate(own):
            line["top"], line["bottom"] = k, len(own) - 1 - k
    return lines


_PAGE_FOLDS, _OF_FOLDS = set(map(_fold, PAGE_WORDS)), set(map(_fold, OF_WORDS[:-1]))


def edge_keys(line: str) -> list[str]:
    """Keys under which a line is counted: its letters, and those of its first and last two words."""
    tokens = line.split()
    key = "".join(map(_FOLDS.__getitem__, tokens))
    if len(key) < 5:
        return []
    front, back = [], []
    for token in tokens:
        front += _WORDS_IN[token]
        if len(front) >= 3:
            break
    else:
        return [key]
    for token in reversed(tokens):
        back[:0] = _WORDS_IN[token]
        if len(back) >= 2:
            break
    first, last = front[0] + front[1], back[-2] + back[-1]
    return [key] + ([f"<{first}"] if len(first) > 5 else []) + ([f"{last}>"] if len(last) > 5 else [])


def edges(lines: list[dict]) -> tuple[Counter, Counter, set[str]]:
    """(lines at edges, lines elsewhere, repeated on many pages) by key, page numbers left out.

    The edge of a page is its first and last EDGE lines; where all of these repeat on many
    pages it goes on by a line, and so forth, so that a header of any height is seen.
    """
    by_page = defaultdict(list)
    for x in lines:
        by_page[x["page"]].append(x)
        x["keys"] = [] if is_page_number(x["text"]) else edge_keys(x["text"])
    n = len(by_page)
    depth = {(page, side): EDGE for page in by_page for side in ("top", "bottom")}
    while True:
        sides = defaultdict(set)
        for (page, side), deep in depth.items():
            own = by_page[page]
            for x in own[:deep] if side == "top" else own[-deep:]:
                for key in x["keys"]:
                    sides[key, side].add(page)
        repeated = {(key, side) for (key, side), pages in sides.items() if len(pages) >= max(2, PAGE_SHARE * n)}
        deeper = False
        for (page, side), deep in depth.items():
            own = by_page[page]
            # The innermost line decides first: it hardly ever repeats.
            inward = own[:deep][::-1] if side == "top" else own[-deep:]
            if deep < len(own) and all(not x["keys"] or any((k, side) in repeated for k in x["keys"]) for x in inward):
                depth[page, side] += 1
                deeper = True
        if not deeper:
            break
    at, off = Counter(), Counter()
    for page, own in by_page.items():
        top, bottom = depth[page, "top"], len(own) - depth[page, "bottom"]
        for k, x in enumerate(own):
            (at if k < top or k >= bottom else off).update(x["keys"])
    return at, off, {key for key, _ in repeated}


def local_furniture(lines: list[dict], at: Counter, off: Counter, repeated: set[str]) -> set[str]:
    """Whole lines that repeat on many pages of their own outcome and hardly elsewhere."""
    n = len({x["page"] for x in lines})
    sentences = {k for x in lines if x["text"].rstrip()[-1:] in ".,;" for k in x["keys"]}
    return {k for k in repeated - sentences if k[0] != "<" and k[-1] != ">" and at[k] >= EDGE_SHARE * (at[k] + off[k]) and (n > 2 or at[k] == 2)}


def mark_furniture(lines: list[dict], known: set[str]) -> None:
    """Sets "furniture": an unbroken run from the edge of the page of page numbers and known keys."""
    by_page = defaultdict(list)
    for x in lines:
        x["furniture"] = False
        by_page[x["page"]].append(x)
    for own in by_page.values():
        for run in (own, own[::-1]):
            for x in run:
                if not (known.intersection(x["keys"]) or is_page_number(x["text"])):
                    break
                x["furniture"] = True


def _token_words(token: str) -> tuple[str, ...]:
    word = token.strip(_STRIP).lower()
    if not _LETTERS.search(word):
        return ()
    if _SPLIT.search(word) and not _TAG.match(word):
        return word, *[p for p in (p.strip(_STRIP) for p in _SPLIT.split(word)) if sum(map(str.isalpha, p)) > 1]
    return (word,)


_TOKEN_WORDS = Known(_token_words)


def words_of(text: str) -> list[str]:
    """The words and tags of a line in lower case; compounds whole and in parts."""
    return [w for token in text.split() for w in _TOKEN_WORDS[token]]


def body_rows(lines: list[dict]) -> list[tuple]:
    """(block, number, furniture, words, left, right, mark, next block, next number) per line."""
    out = [(x["block"], x["number"], True, [], None, None, None, None, None) for x in lines if x["furniture"]]
    body = [x for x in lines if not x["furniture"]]
    tail = False  # the last line ended with a mark, so the first word of this one is not whole
    for x, after in zip(body, [*body[1:], None]):
        text = x["text"]
        if tail:
            text = re.sub(r"^\s*\S+", "", text)
        cut = _MARK.search(x["text"]) if x["text"].rstrip()[-1:] in _MARKS else None
        head = _HEAD.match(after["text"]) if cut and after else None
        if cut:
            text = text[: len(text) - len(x["text"]) + cut.start()] if len(text) >= len(x["text"]) - cut.start() else ""
        words = words_of(text)
        if head:
            out.append((x["block"], x["number"], False, words, cut["left"].strip(_STRIP).lower(), head["right"].strip(_STRIP + "-‐‑¬­").lower(), cut["mark"], after["block"], after["number"]))
        else:
            out.append((x["block"], x["number"], False, words, None, None, None, None, None))
        tail = head is not None
    return out


def _value(char: Column) -> Column:
    return F.shiftright(F.xxhash64(char), 16)


def anagram_hash(word: Column) -> Column:
    """The sum of the characters' 48-bit values; equal for anagrams."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: total + F.when(c == "", F.lit(0).cast("long")).otherwise(_value(c)))


def differences(spark, confusions: list[tuple[str, str]], most: int) -> Column:
    """An array of (diff, cost, mask): what one to ``most`` confusions change in an anagram hash, their edits, and which they are.

    A few hundred entries, fixed by the list of confusions; computed once by Spark, whose hash it is.
    """
    numbered = list(enumerate(confusions))
    sets = [c for n in range(1, most + 1) for c in combinations_with_replacement(numbered, n)]
    # Not where one confusion works on the outcome of another.
    sets = [c for c in sets if not any(set(w) & set(r) for i, (_, (_, w)) in enumerate(c) for j, (_, (r, _)) in enumerate(c) if i != j)]
    rows = [("".join(r for _, (r, _) in c), "".join(w for _, (_, w) in c), sum(max(len(r), len(w)) for _, (r, w) in c), sum({1 << k for k, _ in c})) for c in sets]
    table = spark.createDataFrame(rows, "right string, wrong string, cost int, mask long")
    costs: dict[tuple[int, int], int] = {}
    for diff, cost, mask in table.select(anagram_hash(F.col("right")) - anagram_hash(F.col("wrong")), "cost", "mask").collect():
        costs[diff, mask] = max(cost, costs.get((diff, mask), 0))
    # One expression as text: building it call by call takes the driver seconds.
    return F.expr("array(" + ", ".join(f"named_struct('diff', {d}L, 'cost', {c}, 'mask', {m}L)" for (d, m), c in sorted(costs.items())) + ")")


def shown(word: Column, confusions: list[tuple[str, str]]) -> Column:
    """The confusions whose outcome stands in a word, as bits; no other can have made it."""
    return sum((F.when(F.contains(word, F.lit(w)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, w) in enumerate(confusions)), F.lit(0).cast("long"))


def corrections(vocabulary: DataFrame, registry: DataFrame | None) -> DataFrame:
    """(word, right, edits): the best correction of each misread word. vocabulary: word, n."""
    spark = vocabulary.sparkSession
    hashed = vocabulary.withColumn("hash", anagram_hash(F.col("word")))
    known = hashed.where((F.col("n") >= 1) & F.col("word").rlike(r"^[\p{L}][\p{L}'’-]*$")).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "hash")
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    # Only words that some word can be MUCH more frequent than, or that hold what no word does.
    odd = ~F.col("word").rlike(r"^[\p{L}][\p{L}'’-]*$")
    doubtful = hashed.where((F.length("word") >= 2) & ((F.col("n") * MUCH <= most) | odd))

    def shift(words: DataFrame, confusions: list[tuple[str, str]]) -> DataFrame:
        masked = words.withColumn("mask", shown(F.col("word"), confusions)).where("mask <> 0")
        able = F.filter(differences(spark, confusions, 2), lambda d: d["mask"].bitwiseAND(F.col("mask")) == d["mask"])
        each = masked.select("word", "n", "hash", F.explode(able).alias("d"))
        return each.select("word", "n", "d.cost", (F.col("hash") + F.col("d.diff")).alias("hash"))

    shifted = shift(doubtful, CONFUSIONS)
    # A word with a character that stands in no word is wrong whatever its right form's frequency.
    mixed = F.col("word").rlike(r"^(?=.*\p{L}.*\p{L})[\p{L}'’-]*[^\p{L}'’.,:/_-][\p{L}'’-]*$")
    much = F.col("n_right") >= F.greatest(MUCH * F.col("n"), F.lit(LEAST))
    pairs = shifted.join(known, "hash").where((much | mixed) & (F.col("word") != F.col("right")))
    if registry is not None:
        tags = registry.select(F.lower(F.trim("tag")).alias("right")).where("right <> ''").distinct()
        tags = tags.select("right", F.lit(1 << 40).alias("n_right"), anagram_hash(F.col("right")).alias("hash"))
        like_tags = doubtful.where(F.col("word").rlike(r"^[^\W_]{1,4}-[^\W_]{2,6}$")).join(tags.select(F.col("right").alias("word")), "word", "left_anti")
        shifted = shift(like_tags, CONFUSIONS + TAG_CONFUSIONS)
        pairs = pairs.join(tags.select(F.col("right").alias("word")), "word", "left_anti").unionByName(shifted.join(tags, "hash").select(pairs.columns))
    pairs = pairs.withColumn("edits", F.levenshtein("word", "right")).where("edits <= cost")
    best = pairs.groupBy("word").agg(F.min(F.struct("edits", (-F.col("n_right")).alias("rank"), "right")).alias("b"))
    return best.select("word", "b.right", "b.edits")


def scanned(outcomes: DataFrame) -> DataFrame:
    any_block = F.exists("blocks", lambda b: b["ocr_confidence"].isNotNull())
    # Only what the layout needs goes to Python.
    lean = F.transform("blocks", lambda b: F.struct(b["page"].alias("page"), b["block_index"].alias("block_index"), b["text"].alias("text")))
    return outcomes.where((F.col("ocr_confidence").isNotNull() | F.coalesce(any_block, F.lit(False))) & F.col("blocks").isNotNull()).select("outcome_id", lean.alias("blocks"))


def lines_of(outcomes: DataFrame) -> DataFrame:
    """The lines of scanned outcomes, furniture marked, with words and cuts; see body_rows."""

    def edge_rows(outcome: int, blocks: list) -> list[tuple]:
        at, off, repeated = edges(layout(blocks))
        return [(outcome, key, at[key], off[key], key in repeated) for key in at.keys() | off.keys()]

    pages = spread(scanned(outcomes))
    # Written once: the corpus' totals and the outcomes' own keys are read from it.
    keys = checkpointed(map_rows(pages, edge_rows, "outcome_id long, key string, at int, off int, repeated boolean"))
    totals = keys.groupBy("key").agg(F.sum("at").alias("at"), F.sum("off").alias("off"), F.sum(F.col("repeated").cast("int")).alias("outcomes"), F.count("*").alias("n"))
    least = F.when(F.col("key").rlike("^<|>$"), OUTCOMES + 1).otherwise(OUTCOMES)
    good = checkpointed(totals.where((F.col("outcomes") >= least) & (F.col("at") >= EDGE_SHARE * (F.col("at") + F.col("off")))).select("key", "n"))
    hot = lambda: hot_keys(good, "key", "n")
    own = join_to_measured(keys.where("at > 0").select("outcome_id", "key"), good.select("key"), "key", hot, F.xxhash64("outcome_id"), "inner")
    own = own.groupBy("outcome_id").agg(F.collect_set("key").alias("known"))

    def line_rows(outcome: int, blocks: list, known: list | None) -> list[tuple]:
        lines = layout(blocks)
        local = local_furniture(lines, *edges(lines))
        mark_furniture(lines, local | set(known or ()))
        return [(outcome, *r) for r in body_rows(lines)]

    schema = "outcome_id long, block_index int, line_no int, furniture boolean, words array<string>, left string, right string, mark string, next_block int, next_line int"
    return map_rows(pages.join(own, "outcome_id", "left").select("outcome_id", "blocks", "known"), line_rows, schema)


def evidence(outcomes: DataFrame, registry: DataFrame | None) -> dict[str, DataFrame]:
    """lines, words (by line), vocabulary, right (corrections) and cuts (with is_word)."""
    lines = checkpointed(lines_of(outcomes))
    at = ["outcome_id", "block_index", "line_no"]
    words = lines.select(*at, F.explode("words").alias("word"))
    cuts = lines.where("left IS NOT NULL").withColumns({"joined": F.concat("left", "right"), "compound": F.concat("left", F.lit("-"), "right"), "first": F.element_at(F.split("left", "-"), -1)})
    # Words as they stand in lines; joined ones only as candidates for correction.
    forms = words.select("word", F.lit(1).alias("n")).unionByName(cuts.select(F.col("joined").alias("word"), F.lit(0).alias("n")))
    vocabulary = checkpointed(forms.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
    right = checkpointed(corrections(vocabulary.select("word", "n"), registry))

    seen = vocabulary.where("n > 0")
    fixed = right.select(F.col("word").alias("joined"), F.col("right").alias("whole"))
    cuts = (
        cuts.join(seen.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
        .join(seen.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
        .join(fixed, "joined", "left")
    )
    # A part that often begins compounds keeps its hyphen where neither form is known.
    begins = seen.where(F.col("word").rlike(r"^[\p{L}]{2,}-[\p{L}-]+$")).groupBy(F.regexp_extract("word", r"^([\p{L}]+)-", 1).alias("first")).agg(F.sum("n").alias("n_begins"))
    cuts = cuts.join(seen.select(F.col("word").alias("whole"), F.col("n").alias("n_whole")), "whole", "left").join(begins, "first", "left")
    cuts = cuts.join(seen.select(F.col("word").alias("first"), F.col("n").alias("n_first")), "first", "left")
    cuts = cuts.na.fill(0, ["n_joined", "n_compound", "n_whole", "n_begins", "n_first"])
    as_word = F.greatest("n_joined", "n_whole")
    whole = (
        F.when((as_word > 0) | (F.col("n_compound") > 0), as_word >= F.col("n_compound"))
        .when(F.col("mark").isin("-", "‐", "‑"), ~((F.col("n_begins") > 0) & (F.col("n_first") > 0)))
        .otherwise(F.lit(True))
    )
    return {"lines": lines, "words": words, "vocabulary": vocabulary, "right": right, "cuts": checkpointed(cuts.withColumn("is_word", whole))}


def defects(outcomes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(outcome_id, block_index, line_no, defect) of the lines of scanned outcomes."""
    found = evidence(outcomes, registry)
    at = ["outcome_id", "block_index", "line_no"]
    after = ["outcome_id", F.col("next_block").alias("block_index"), F.col("next_line").alias("line_no")]
    lines, words, right, cuts = (found[k] for k in ("lines", "words", "right", "cuts"))
    hyphens = cuts.where("is_word").select(*at, F.lit("hyphen").alias("defect"))
    # The misread part of a joined word: the one that differs from the word it stands for.
    wrong = cuts.where(F.col("is_word") & F.col("whole").isNotNull() & (F.col("n_joined") * MUCH <= F.col("n_whole")))
    in_right = F.expr("startswith(whole, left)")
    split = wrong.where(~in_right).select(*at).unionByName(wrong.where(in_right).select(*after))
    kept = cuts.where("NOT is_word")
    parts = kept.select(*at, F.explode(F.split("left", "-")).alias("word")).unionByName(kept.select(*after, F.explode(F.split("right", "-")).alias("word")))
    hot = lambda: hot_keys(found["vocabulary"], "word", "rows")
    misread = join_to_measured(words.unionByName(parts), right.select("word"), "word", hot, F.xxhash64(*at), "inner").select(*at).unionByName(split)
    furniture = lines.where("furniture").select(*at, F.lit("furniture").alias("defect"))
    return furniture.unionByName(hyphens).unionByName(misread.withColumn("defect", F.lit("misread"))).distinct()


def _corrected(text: str, right: dict[str, str]) -> str:
    def fix(m: re.Match) -> str:
        word = m.group()
        new = right.get(word.lower())
        if new is None:
            return word
        return new.upper() if word[:2].isupper() or _TAG.match(word) else new[0].upper() + new[1:] if word[0].isupper() else new

    return re.sub(r"[^\s.,;:()\[\]\"“”!?]+", lambda m: fix(m) if m.group().lower() in right else re.sub(r"[^-/]+", fix, m.group()), text)


def repaired(outcomes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(outcome_id, paragraph_no, page, text): scanned outcomes as continuous paragraphs."""
    found = evidence(outcomes, registry)
    words, right, cuts = found["words"], found["right"], found["cuts"]
    hot = lambda: hot_keys(found["vocabulary"], "word", "rows")
    fixes = join_to_measured(words, right.select("word", "right"), "word", hot, F.xxhash64("outcome_id", "block_index", "line_no"), "inner")
    fixes = fixes.select("outcome_id", "word", "right").unionByName(cuts.where("is_word AND whole IS NOT NULL").select("outcome_id", F.col("joined").alias("word"), F.col("whole").alias("right")))
    fixes = fixes.distinct().groupBy("outcome_id").agg(F.collect_list(F.struct("word", "right")).alias("fixes"))
    joins = cuts.where("is_word").groupBy("outcome_id").agg(F.collect_list(F.struct("block_index", "line_no")).alias("joins"))
    removed = found["lines"].where("furniture").groupBy("outcome_id").agg(F.collect_list(F.struct("block_index", "line_no")).alias("removed"))
    pages = scanned(outcomes).join(fixes, "outcome_id", "left").join(joins, "outcome_id", "left").join(removed, "outcome_id", "left")

    def rebuild(outcome: int, blocks: list, fixes: list | None, joins: list | None, removed: list | None) -> list[tuple]:
        places = lambda x: {(p["block_index"], p["line_no"]) for p in x or ()}
        right, joins, removed = {f["word"]: f["right"] for f in fixes or ()}, places(joins), places(removed)
        paragraphs, glue, last = [], "", None
        for x in layout(blocks):
            at = (x["block"], x["number"])
            if at in removed:
                continue
            # Blank lines part paragraphs within a block; a page turn does not.
            gap = last is not None and last["block"] == x["block"] and x["number"] > last["number"] + 1
            if not paragraphs or gap:
                paragraphs.append([x["page"], ""])
                glue = ""
            text = x["text"].strip()
            paragraphs[-1][1] += glue + text
            glue = " "
            if _MARK.search(text):
                glue = ""
                if at in joins:
                    paragraphs[-1][1] = paragraphs[-1][1][:-1]
            last = x
        return [(outcome, k, page, _corrected(text, right)) for k, (page, text) in enumerate(paragraphs, 1)]

    return map_rows(pages.select("outcome_id", "blocks", "fixes", "joins", "removed"), rebuild, "outcome_id long, paragraph_no int, page int, text string")
