from millrace.llm import scans

BLOCK = "array<struct<block_index int, page int, section string, kind string, text string, ocr_confidence double>>"
SCHEMA = f"outcome_id long, ocr_confidence double, blocks {BLOCK}"
LINES = [
    "The instrument was checked and the temperature of the machine", "was within the limit of the drawing during the whole shift.", "A follow-up visit of the engineer is planned for the morning.", "Lubricant was taken from the casing and sent to the laboratory.",
    "Nobody could say who had closed the bypass of the filter.", "The foundation was surveyed by two persons after the outage.", "Cleaning with warm water was enough for the coupling halves.", "Insulation of the header is missing and should be restored.",
]


def body(k):
    """Eight lines in an order of their own."""
    return [LINES[(k * 3 + i * (1 + 2 * (k % 3))) % 8] for i in range(8)]


def outcome(k, pages, header=None, conf=0.9, first=1):
    blocks = []
    for i, body in enumerate(pages):
        lines = ([header, ""] if header else []) + body + ["", f"Page {i + first} of {len(pages)}"]
        blocks.append((i, i + 1, None, "paragraph", "\n".join(lines), None))
    return (k, conf, blocks)


def corpus():
    rows = [outcome(k, [body(k), body(k + 1), body(k + 2)], f"Halvorn Works - Shift Log No. {k}") for k in range(1, 13)]
    rows.append(outcome(20, [["The instru-", "ment was checked at the follow-", "up visit of the en¬"], ["gineer, and the temperaturc rose.", "Machine P-l01 stopped."]], "Halvorn W0rks - Shift Log No. 77"))
    rows.append(outcome(21, [body(5)], "Halvorn Works - Shift Log No. 99"))
    rows.append((30, None, [(0, 1, None, "paragraph", "The instru-\nment\n1", None)]))
    rows.append((31, 0.5, None))
    rows.append((32, 0.5, [(0, None, None, None, None, None), (None, None, None, None, "", 0.2)]))
    return rows


def found(spark, rows, registry=(("P-101",),)):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS word", "3 AS n")
    reg = spark.createDataFrame(list(registry), "tag string")
    return sorted(tuple(r) for r in scans.defects(df, reg).collect()), scans.repaired(df, reg)


def test_defects_and_paragraphs(spark):
    got, repaired = found(spark, corpus())
    own = [r[1:] for r in got if r[0] == 20]
    assert own == [(0, 1, "furniture"), (0, 3, "hyphen"), (0, 5, "hyphen"), (0, 7, "furniture"), (1, 1, "furniture"), (1, 3, "misread"), (1, 4, "misread"), (1, 6, "furniture")]
    # A single page is judged by the headers of other outcomes.
    assert [r[1:] for r in got if r[0] == 21] == [(0, 1, "furniture"), (0, 12, "furniture")]
    assert not [r for r in got if r[0] in (30, 31, 32)]
    assert {r[3] for r in got if r[0] <= 12} == {"furniture"}
    text = " ".join(r.text for r in repaired.where("outcome_id = 20").orderBy("paragraph_no").collect())
    assert text == "The instrument was checked at the follow-up visit of the engineer, and the temperature rose. Machine P-101 stopped."


def test_empty_and_repeated(spark):
    got, _ = found(spark, corpus()[:3])
    twice, _ = found(spark, [*corpus()[:3], *[(k + 100, c, b) for k, c, b in corpus()[:3]]])
    assert [r for r in twice if r[0] < 100] == got
    df = spark.createDataFrame([], SCHEMA)
    assert scans.defects(df, None).count() == 0


def test_anagram_hash_differences(spark):
    words = [("machine", 50), ("machinc", 1), ("maohine", 1), ("during", 40), ("diiring", 2), ("intake", 10), ("taken", 300), ("modern", 50), ("modem", 30)]
    right = {r.word: r.right for r in scans.corrections(spark.createDataFrame(words, "word string, n long"), None).collect()}
    assert right == {"machinc": "machine", "diiring": "during"}


def test_page_numbers():
    for line in ("1", "- 12 -", "[3]", "p. 4", "Pg l9", "Page 3 of 10", "Sheet 2/7", "iv", "   17"):
        assert scans.is_page_number(line), line
    for line in ("FINDINGS", "sheet.", "12 bar", "Page of the log", "in", "2024-05-01"):
        assert not scans.is_page_number(line), line
