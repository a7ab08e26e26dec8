import numpy as np

from millrace.llm import spam

PROSE = "The seal of the pump was replaced during the night shift, and the leak has stopped since then. No abnormality was found on the other machines of the area."
SPAM = [
    "pump price, seal shop, buy bearings, cheap valve sale, pump price, seal shop, best bearing supplier, cheap valve sale, motor rental, buy bearings",
    "A gap was measured between the halves. " + "pump kit Norvik, coupling kit Corvale, pump kit in Miresby, coupling kit Quenby, pump kit Estorra, pump supplier Norvik, " * 4,
    "\n".join(f"[url]http://pump-deals.example/pump-price-{k}.html[/url]" for k in range(8)),
    " | ".join(f"[link](https://steamhub.example/seal-shop/p/{k})" for k in range(8)),
    " ".join(f"#cheapPumpPrice #bestSealShop{k}" for k in range(8)),
    " • ".join(f"seal kit A{k}123 {k} EUR" for k in range(10, 30)),
    "पंप सस्ता | मोटर बिक्री | सील कीमत | " * 10,
    "Buy pump kit now, pump kit today, pump kit here. Our cheap pump kit is the best pump kit for your pump kit. " * 5,
]
HAM = [
    PROSE, PROSE + " " + PROSE, "Index of tags\n" + "\n".join(f"P-{k} . hot oil" for k in range(101, 160)), "Parts list\n" + "\n".join(f"{k}. gland packing, {k} pcs, drawing {k}00" for k in range(1, 20)),
    "Round sheet 2024-04-13\n" + "\n".join(f"HE-{k}A normal" for k in range(100, 140)), PROSE + "\n\nReferences\n" + "\n".join(f"- https://docs.halvorn.example/sop/{k}" for k in range(1000, 1006)),
    "tag,parameter,value\n" + "\n".join(f"P-{k},ph,{k}.5" for k in range(101, 130)), "\n".join(f"{k}. Check that the valve of P-{k} is open." for k in range(101, 120)), "void", "-",
    "रात की पाली में P-152 से तेल का रिसाव देखा गया था। तेल का नमूना प्रयोगशाला में भेज दिया गया है। रात की पाली में P-152 से तेल का रिसाव देखा गया था।",
]


def feature(texts, name):
    values, _, _ = spam.features(texts)
    return values[:, spam.FEATURES.index(name)]


def test_features():
    assert (feature(SPAM, "density") > 0.5).all()
    assert (feature(HAM[:-3], "density") < 0.5).all()
    assert feature([PROSE], "function")[0] > 0.3 and feature([SPAM[0]], "function")[0] == 0
    assert feature(["x y z " * 30], "repetition")[0] == 1 and feature([PROSE], "repetition")[0] == 0
    assert feature(["pump " * 30], "entropy")[0] == 0 and feature(["one two"], "entropy")[0] == 1
    values, languages, worth = spam.features(["", "123 ...", "word"])
    assert worth.tolist() == [0, 0, 1] and spam.features([])[0].shape == (0, 5)


def test_features_do_not_depend_on_the_batch():
    together, languages, _ = spam.features(SPAM + HAM)
    for k, text in enumerate(SPAM + HAM):
        values, language, _ = spam.features([text])
        assert np.allclose(values[0], together[k]) and language[0] == languages[k]


def test_documents(spark):
    texts = SPAM + HAM + [None, "", "  \n ", "...", "word " * 5] + [f"{PROSE} See the entry {k}. {PROSE if k % 2 else ''}" for k in range(120)] + SPAM[:2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS language", "2 AS share", "3 AS links")
    got = {r.doc_id for r in spam.spam_documents(df).collect()}
    assert got == {*range(len(SPAM)), len(texts) - 2, len(texts) - 1}
    assert spam.spam_documents(df.limit(0)).count() == 0


INDIC = {
    "hi": ("रात की पाली में पंप से तेल का रिसाव देखा गया है।", "पंप कीमत मोटर सील वाल्व खरीदें पाइप बेयरिंग।"),
    "mr": ("रात्रीच्या पाळीत पंपाची गळती झाली आहे आणि तपासणी केली नाही.", "पंप किंमत मोटर सील वाल्व खरेदी पाइप बेअरिंग."),
    "ta": ("எனக்கு அதிர்வு அறிக்கை வேண்டும் ஆனால் இயந்திரம் நிற்கவில்லை.", "வால்வு விலை தாங்கி முத்திரை எண்ணெய் விற்பனை மோட்டார்."),
    "kn": ("ನಾವು ಇಂದು ಪರಿಶೀಲನೆ ಮಾಡಿದೆವು ಆದರೆ ಯಾವುದೇ ದೋಷ ಸಿಗಲಿಲ್ಲ.", "ಕವಾಟ ಬೆಲೆ ಬೇರಿಂಗ್ ಸೀಲ್ ಎಣ್ಣೆ ಮಾರಾಟ ಮೋಟಾರ್."),
}


def test_function_words_of_indic_languages():
    for lang, (prose, menu) in INDIC.items():
        values, names, _ = spam.features([prose, menu.replace(".", "").replace("।", "")])
        assert names[0] == lang and values[0][3] > 0.15 and values[0][0] == 0, lang
        assert values[1][3] == 0 and values[1][0] == 1, lang
