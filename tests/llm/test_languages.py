import itertools

import numpy as np

from millrace.llm import languages as L

SCHEMA = "query_id long, transcript string, language string, equipment_tag string"
EN = "why did the pump trip during the night shift"
RO = "kal raat se P-101 mein se tel nikal raha hai"
HI = "रात की पाली में P-101 से तेल का रिसाव देखा गया था।"
MR = "सील बदलल्यानंतरही गळती थांबलेली नाही. मला कंपनाचा मागील अहवाल पाहिजे."
TA = "முத்திரையை மாற்றிய பிறகும் கசிவு நிற்கவில்லை."
KN = "ಸೀಲ್ ಬದಲಾಯಿಸಿದ ನಂತರವೂ ಸೋರಿಕೆ ನಿಂತಿಲ್ಲ."


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS lang", "2 AS text", "3 AS tag", "4 AS usual", "5 AS declared")
    out = {}
    for r in sorted(L.wrong_labels(df).collect()):
        out.setdefault(r.query_id, []).append(r.lang)
    return out


def test_labels_and_segments(spark):
    rows = [
        (1, EN, "en", "P-1"), (2, EN, "EN_in", None), (3, EN, None, "P-1"), (4, EN, " ", "P-1"), (5, EN, "hi", "P-1"), (6, RO, "hi-IN", None), (7, RO.upper(), "en", None), (8, HI, "mr", None), (9, MR, "mr", None), (10, MR, "hi", None),
        (11, f"{EN} / {HI} {TA}", "en", None), (12, f"{RO} {EN}", None, None), (13, f"{KN}\n{MR}", "kn", None), (14, None, "en", None), (15, "", None, None), (16, "P-101 45.2 M-3", "xx", None), (17, f"{HI} {HI}", "hi", None), (18, f"{TA} - {TA}", "ta", "P-1"),
        (19, (HI + " ") * 3000, "hi", None),
    ]
    assert found(spark, rows) == {3: ["en"], 4: ["en"], 5: ["en"], 7: ["hi"], 8: ["hi"], 10: ["mr"], 11: ["en", "hi", "ta"], 12: ["hi", "en"], 13: ["kn", "mr"]}


def test_empty_table_and_confidence(spark):
    df = spark.createDataFrame([(1, EN, "en", None)], SCHEMA)
    assert L.label_segments(df.limit(0)).count() == 0
    assert 0.5 < L.label_segments(df).first().confidence <= 1


def by_seeds(text):
    keys, stops = L.words_of(text)
    rows = L.seed_rows()
    e = L.emissions(keys, np.array([rows.get(k, np.zeros(5)) for k in keys]).reshape(-1, 5))
    path = L.best_paths(e, np.array(stops, bool), np.array([len(keys)]), L.priors([None], None))
    return [L.LANGUAGES[k] for k, _ in itertools.groupby(path)]


def test_borrowed_words_and_tags_begin_no_segment():
    assert by_seeds("எனக்கு P-101 vibration report வேண்டும்.") == ["ta"]
    assert by_seeds("mujhe pump ki pichhli report chahiye") == ["hi"]
    assert L.words_of("P-101 12.5 / 33") == ([], [])


def plain_path(e, stops, prior):
    """One word after the other, every change tried."""
    score, back = list(prior + e[0]), []
    for row, stop in zip(e[1:], stops[1:]):
        cost = L.SWITCH_AT_STOP if stop else L.SWITCH
        back.append([max(range(5), key=lambda j: (score[j] - (cost if j != k else 0), j == k)) for k in range(5)])
        score = [score[j] - (cost if j != k else 0) + row[k] for k, j in enumerate(back[-1])]
    at = int(np.argmax(score))
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def test_paths_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 60)
    e = -rng.random((sizes.sum(), 5)).astype(np.float32) * 6
    stops, prior = rng.random(sizes.sum()) < 0.3, -rng.random((60, 5))
    want, at = [], 0
    for n, p in zip(sizes, prior):
        want += plain_path(e[at : at + n], stops[at : at + n], p)
        at += n
    assert L.best_paths(e, stops, sizes, prior).tolist() == want


def test_repeated_rows_hot_machines_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_A_BUCKET", 7)
    monkeypatch.setattr("millrace.operators.skew.ROWS_A_SALT", 5)
    rows = [(k, [EN, HI, RO, f"{EN}. {HI}"][k % 4], "ta", "P-1" if k % 3 else None) for k in range(60)] * 2
    got = L.label_segments(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2 * (60 + 15) and {r.query_id for r in got} == set(range(60))
    assert all(r.segments == (2 if r.query_id % 4 == 3 else 1) for r in got)
