"""Problem 9: keyword stuffing, link lists and product tags or offers instead of sentences.

Five features of the whole text: density (the share of it that is links, or words outside
sentences without marks of the plant's own papers), repetition (of neighbouring words),
entropy, function words, and structure (words beside such marks: machine tags, quantities,
drawing numbers, links to papers). Per language they get a robust centre and spread (median
and median deviation, by grouped percentiles) and a robust correlation (of values clipped to
three spreads, by grouped means). A document's deviation is shrunk where it has few words.

It is spam if its squared Mahalanobis distance lies in the chi-square tail and its direction
is that of spam: the cosine, in the metric of the distance, of the angle between deviation
and SPAMWARD is above COSINE. Nothing else decides.

A sentence is a unit of four words or more of which a sixth are function words; in Indic
scripts, whose function words are few and joined to others, one of three words that ends with
a mark. Defined results: null, empty, blank and wordless texts -> never spam; one-word texts
-> not spam; repeated texts -> judged alike; a language with too few documents to estimate
from is judged by the figures of all documents together; an empty table -> no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpointed, spread

FEATURES = ("density", "repetition", "entropy", "function", "structure")
#: The direction of spam: denser, more repetitive, less entropy, function words and structure.
SPAMWARD = np.array([2, 0.5, -0.5, -1, -1])
COSINE = 0.3
#: Chi-square of 5 degrees of freedom at 0.999.
DISTANCE_2 = 20.515
#: The least spread of a feature, where most documents agree.
FLOOR = np.array([0.1, 0.1, 0.05, 0.08, 0.1])
CLIP, RIDGE, LEAST_DOCS = 3.0, 0.1, 50
#: Words at which a deviation counts half; words that a mark of structure stands for; characters that a word of a link has.
EVIDENCE, WORDS_A_MARK, LINK_WORD = 20.0, 8, 6.0
SENTENCE_WORDS, SENTENCE_FUNCTION = 4, 0.17
STUFFED = 0.4  # share of a unit's words in pairs that it repeats
SLICE = 1 << 20  # characters that are in work at a time, unless one text is longer

# Function words of the eight languages; Tamil and Kannada have few that stand alone.
FUNCTION = {
    "en": "the of and is was were has have had been be are in on at to from with for by that this not no it its near since after before during until while please there again yet all did does an a as or but must should although because".split(),
    "de": "der die das den dem des und ist war wurde wurden nicht auf im am zu mit von bei für es sich als wird nach dass aber ein eine zum bis durch ohne wieder".split(),
    "fr": "le la les de des du un une est été a au aux et en dans par pour sur ne que qui il elle mais n'a avant après sans plus lors d'une l'équipe".split(),
    "es": "el los las del una es fue se no con por para al lo su y en de la que un sin más pero ha antes después".split(),
    "hi": "है हैं था थी थे हो का की के को से में पर और भी नहीं क्या क्यों यह वह मुझे हमने आप रहा रही रहे गया गई किया करना चाहिए लेकिन कोई ने बाद तक कब कर दिया हुआ हुई कि जो तो ही इस उस एक या अगर जब".split(),
    "mr": "आहे आहेत होता होती होते हो चा ची चे च्या ला ना मध्ये वर आणि पण नाही काय का की हा ही हे तो ती ते मला आम्ही तुम्ही केले केली केला पाहिजे काही कोणी नंतर पर्यंत कधी केव्हा झाली झाला झाले येत अजून जो जर तर मग किंवा होत असून".split(),
    "ta": "இல் ஒரு இந்த அந்த இது அது என்று என என்ன எப்போது எனக்கு நாங்கள் நான் நீங்கள் அவர் மற்றும் அல்லது ஆனால் இல்லை வேண்டும் வேண்டுமா மேல் கீழ் பிறகு பிறகும் முன் வரை உள்ள உள்ளது இருக்கிறது இருந்து மிகவும் போது கடைசியாக எந்த எந்தக் கொண்டு".split(),
    "kn": "ನಿಂದ ಒಂದು ಈ ಆ ಇದು ಅದು ಎಂದು ಎಂಬ ಏನು ಯಾವ ಯಾವಾಗ ಯಾವುದೇ ನನಗೆ ನಾವು ನಾನು ನೀವು ಅವರು ಮತ್ತು ಅಥವಾ ಆದರೆ ಇಲ್ಲ ಬೇಕು ಮೇಲೆ ಕೆಳಗೆ ನಂತರ ನಂತರವೂ ಮೊದಲು ವರೆಗೆ ಇದೆ ಇತ್ತು ತುಂಬಾ ಆಗಿ ಆಯಿತು ಕೊನೆಯ ಗೆ ಅಲ್ಲಿ".split(),
}
LANGUAGES = tuple(FUNCTION)
_STOPS = set().union(*FUNCTION.values())
#: Marks of quantities and references in the plant's own lists, fixed values.
LIST_WORDS = ("pcs", "drawing")
_LINK = re.compile(
    r"\[url[^\]]*\][^\[]*\[/url\]|<a\s[^>]*>.*?</a>|\[[^\]\n]{0,60}\]\([^)\s]*\)|(?:https?|hxxps?)://[^\s,;|<>\")]+|www\.[^\s,;|<>\")]+|\b[\w-]+(?:\.[\w-]+)*(?:\.|\[\.\])[a-z]{2,}/[^\s,;|<>\")]*",
    re.I,
)
_LINK_SIGNS = ("/", "www.", "[url", "](", "[.]")
#: A paper of the plant itself: a kind of document and its number.
_PAPER = re.compile(r"^(?:https?|hxxps?)://[^/\s]+/\w+/\d+/?$", re.I)
_LETTER, _INDIC = r"[^\W\d_]", "ऀ-ॣॱ-෿"
_TOKEN = re.compile(
    r"[\n\r]|(?<=\S)[.!?।](?=\s)|\b(?:" + "|".join(LIST_WORDS) + r")\b|\b\d+ x\b|\b[a-z]{1,4}-\d{2,5}[a-z]?\b|\x01[^\x02]*\x02|[^\W_]*\d[^\W_]*|" + rf"{_LETTER}+(?:['’]{_LETTER}+)?(?:[{_INDIC}]+{_LETTER}*)*"
)
_LINE, _STOP, _LINKED, _STRUCTURE, _WORD, _CODE = range(6)
#: Scripts by their range of characters, with the languages written in each.
_SCRIPTS = ((0x900, 0x97F, ("hi", "mr")), (0xB80, 0xBFF, ("ta",)), (0xC80, 0xCFF, ("kn",)))


def _prepared(text: str) -> str:
    """A text in lower case, links enclosed in marks, those to the plant's papers turned into a word of lists."""
    if any(sign in text for sign in _LINK_SIGNS):
        text = _LINK.sub(lambda m: f" {LIST_WORDS[0]} " if _PAPER.match(m.group().rstrip(".,;")) else " \x01" + re.sub(r"\s", " ", m.group()) + "\x02 ", text.replace("\x01", " ").replace("\x02", " "))
    return text.lower() + "\n"


def _kinds(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, script as a number of _SCRIPTS or -1, which languages' function word) of each distinct token."""
    kind, script, function = np.full(len(vocabulary), _WORD, np.int8), np.full(len(vocabulary), -1, np.int8), np.zeros((len(vocabulary), len(LANGUAGES)), bool)
    for k, token in enumerate(vocabulary):
        first = token[0]
        if first in "\n\r":
            kind[k] = _LINE
        elif first in ".!?।":
            kind[k] = _STOP
        elif first == "\x01":
            kind[k] = _LINKED
        elif token in LIST_WORDS or "-" in token or token.endswith(" x"):
            kind[k] = _STRUCTURE
        elif not token.isalpha() and any(map(str.isdigit, token)) and sum(map(str.isalpha, token)) < 4:
            kind[k] = _CODE
        else:
            if first >= "\u0900":
                script[k] = next((i for i, (low, high, _) in enumerate(_SCRIPTS) if low <= ord(first) <= high), -1)
            if token in _STOPS:
                function[k] = [token in _FUNCTION_SETS[lang] for lang in LANGUAGES]
    return kind, script, function


_FUNCTION_SETS = {lang: set(words) for lang, words in FUNCTION.items()}


def features(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(features, language, words' worth) of each text; worth 0 where there are neither words nor links."""
    n, tokens, sizes = len(texts), [], []
    for text in texts:
        found = _TOKEN.findall(_prepared(text))
        tokens += found
        sizes.append(len(found))
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    code, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    kind, script, function = _kinds(vocabulary)
    length = np.array([len(t) for t in vocabulary] or [0], float)
    doc = np.repeat(np.arange(n), sizes)
    kinds = kind[code]
    word = kinds == _WORD
    # Units end with a line or a sentence's mark.
    unit = np.cumsum(np.r_[0, kinds[:-1] <= _STOP]) if len(code) else np.zeros(0, np.int64)
    units = int(unit[-1]) + 1 if len(unit) else 0
    owner = np.zeros(units, np.int64)
    owner[unit] = doc

    def per_unit(which: np.ndarray) -> np.ndarray:
        return np.bincount(unit[which], minlength=units).astype(float)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n)

    words, stops, marks = per_unit(word), per_unit(word & function.any(1)[code]), per_unit(kinds == _STRUCTURE)
    indic = 2 * per_unit(word & (script[code] >= 0)) > words
    # Neighbouring words: a phrase over and over within one unit makes no sentence.
    wcode, wdoc, wunit = code[word], doc[word], unit[word]
    pair = wcode[:-1] * len(vocabulary) + wcode[1:]
    near = wunit[1:] == wunit[:-1]
    at, times = _runs(wunit[1:][near], pair[near])
    stuffed = 2 * np.bincount(at, weights=np.where(times >= 3, times, 0), minlength=units) >= STUFFED * words
    sentence = ~stuffed & np.where(indic, (words >= SENTENCE_WORDS - 1) & (per_unit(kinds == _STOP) > 0), (words >= SENTENCE_WORDS) & (words > 0) & (stops >= SENTENCE_FUNCTION * words))
    own = np.where(sentence, 0, np.minimum(words, WORDS_A_MARK * marks))
    bare = np.where(sentence, 0, words - own)
    count = per_text(words)
    linked = np.bincount(doc[kinds == _LINKED], weights=length[code[kinds == _LINKED]] - 2, minlength=n) / LINK_WORD
    worth = count + linked
    total = np.maximum(worth, 1)

    first, times = _runs(wdoc, wcode)
    share = times / np.maximum(count[first], 1)
    entropy = np.bincount(first, weights=-share * np.log2(share), minlength=n)
    entropy = np.where(count > 8, entropy / np.log2(np.maximum(count, 2)), 1.0)
    together = wdoc[1:] == wdoc[:-1]
    first, times = _runs(wdoc[1:][together], pair[together])
    pairs = np.bincount(first, weights=times, minlength=n)
    repetition = np.bincount(first, weights=np.where(times >= 3, times, 0), minlength=n) / np.maximum(pairs, 1)
    values = np.c_[(linked + per_text(bare)) / total, repetition, entropy, per_text(stops) / np.maximum(count, 1), per_text(own) / total]

    letters = np.bincount(wdoc, weights=length[wcode], minlength=n)
    spoken = np.stack([np.bincount(wdoc, weights=function[wcode, k], minlength=n) for k in range(len(LANGUAGES))], 1)
    scripts = [np.bincount(wdoc, weights=length[wcode] * (script[wcode] == k), minlength=n) for k in range(len(_SCRIPTS))]
    latin = [lang for lang in LANGUAGES if not any(lang in langs for _, _, langs in _SCRIPTS)]
    languages = np.array(latin, object)[spoken[:, [LANGUAGES.index(x) for x in latin]].argmax(1)]
    for own_letters, (_, _, langs) in zip(scripts, _SCRIPTS):
        at = 2 * own_letters > letters
        languages[at] = np.array(langs, object)[spoken[at][:, [LANGUAGES.index(x) for x in langs]].argmax(1)]
    return values, list(languages), worth


def _runs(group: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, count) of each distinct (group, item)."""
    order = np.lexsort((item, group))
    group, item = group[order], item[order]
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (item[1:] != item[:-1])]) if len(group) else np.zeros(0, np.int64)
    return group[starts], np.diff(np.r_[starts, len(group)])


_MEASURED = "doc_id long, language string, worth double, " + ", ".join(f"{f} double" for f in FEATURES)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, language, worth, the features) of the documents with words. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, a, size = batch.column(0), batch.column(1).to_pylist(), 0, 0
            for b in range(len(texts) + 1):
                if b == len(texts) or size > SLICE:
                    if b > a:
                        values, languages, worth = features(texts[a:b])
                        keep = pa.array(np.flatnonzero(worth > 0))
                        columns = [ids.slice(a, b - a), pa.array(languages, pa.string()), pa.array(worth), *[pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(FEATURES))]]
                        yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], ["doc_id", "language", "worth", *FEATURES])
                    a, size = b, 0
                if b < len(texts):
                    size += len(texts[b])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length(F.trim("text")) > 0)
    return spread(texts).mapInArrow(run, _MEASURED)


def robust_figures(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language, and of all documents under "": centre, spread, inverse correlation.

    Three grouped aggregations; at most eight languages' figures reach the driver.
    """
    both = rows.withColumn("language", F.explode(F.array("language", F.lit(""))))
    middle = both.groupBy("language").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES]).toPandas().set_index("language")
    centre = {lang: row[list(FEATURES)].to_numpy(float) for lang, row in middle.iterrows() if row["n"] >= LEAST_DOCS or lang == ""}

    def minus(f: str, k: int):
        out = F.lit(0.0)
        for lang, c in centre.items():
            out = F.when(F.col("language") == lang, F.lit(float(c[k]))).otherwise(out)
        return F.col(f) - out

    both = both.where(F.col("language").isin(list(centre)))
    apart = both.groupBy("language").agg(*[F.percentile_approx(F.abs(minus(f, k)), 0.5, 1000).alias(f) for k, f in enumerate(FEATURES)]).toPandas().set_index("language")
    spread = {lang: np.maximum(1.4826 * row[list(FEATURES)].to_numpy(float), FLOOR) for lang, row in apart.iterrows()}

    def scaled(f: str, k: int):
        out = F.lit(0.0)
        for lang in spread:
            z = (F.col(f) - F.lit(float(centre[lang][k]))) / F.lit(float(spread[lang][k]))
            out = F.when(F.col("language") == lang, F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP))).otherwise(out)
        return out

    z = [scaled(f, k) for k, f in enumerate(FEATURES)]
    cells = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    moments = both.groupBy("language").agg(*[F.avg(z[i] * z[j]).alias(f"m{i}_{j}") for i, j in cells]).toPandas().set_index("language")
    out = {}
    for lang, row in moments.iterrows():
        m = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in cells:
            m[i, j] = m[j, i] = row[f"m{i}_{j}"]
        d = np.sqrt(np.maximum(np.diag(m), 1e-6))
        out[lang] = centre[lang], spread[lang], np.linalg.inv(m / np.outer(d, d) + RIDGE * np.eye(len(FEATURES)))
    return out


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, language, distance, cosine, the features) of the documents with words. docs: doc_id, text."""
    schema = "doc_id long, language string, distance double, cosine double, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = checkpointed(measured(docs))
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    figures = robust_figures(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, worth = frame[list(FEATURES)].to_numpy(float), frame["worth"].to_numpy(float)[:, None]
            distance, along = np.zeros(len(x)), np.zeros(len(x))
            own = np.array([lang if lang in figures else "" for lang in frame["language"]], object)
            for lang in set(own):
                centre, spread, inverse = figures[lang]
                at = own == lang
                z = (x[at] - centre) / spread * (worth[at] / (worth[at] + EVIDENCE))
                distance[at] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, inverse, z), 0))
                along[at] = z @ inverse @ SPAMWARD / np.sqrt(SPAMWARD @ inverse @ SPAMWARD)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "language": frame["language"], "distance": distance, "cosine": along / np.maximum(distance, 1e-9)} | {f: frame[f] for f in FEATURES})

    return rows.mapInPandas(run, schema)


def spam_documents(docs: DataFrame) -> DataFrame:
    """The rows of :func:`judged` that are spam: far out, in the direction of spam."""
    return judged(docs).where((F.col("distance") * F.col("distance") > DISTANCE_2) & (F.col("cosine") > COSINE))
