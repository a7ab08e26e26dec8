import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import split

BLOCK = "array<struct<block_index int, page int, section string, kind string, text string, ocr_confidence double>>"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c.\n!é́漢", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_pieces_cover_everything_within_the_limit(text, limit, overlap):
    pieces = split.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= overlap


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ax \n", max_size=300), st.integers(2, 40), st.data())
def test_no_piece_starts_before_its_predecessor(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = split.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= limit for a, b in pieces)
    assert all(a < c <= b < d and b - c <= overlap for (a, b), (c, d) in zip(pieces, pieces[1:]))
    whole = text[pieces[0][0] : pieces[0][1]] + "".join(text[b:d] for (_, b), (_, d) in zip(pieces, pieces[1:]))
    assert whole == text


def test_a_short_first_part_at_the_default_limits():
    for text in ("a " + "x" * 3000, "Heading\n" + "y" * 4000, "z" * 3000 + " b"):
        pieces = split.split_text(text)
        assert all(a >= 0 and split.OVERLAP < b - a <= split.LIMIT for a, b in pieces)
        assert all(a < c <= b for (a, b), (c, _) in zip(pieces, pieces[1:]))
    assert all(a > 0 and a <= b for a, b in split.split_pages(12, {2, 3}, 3, 2))


def test_pieces_put_together_are_the_text(spark):
    texts = ["a " + "x" * 3000, "Word é́. " * 900, None, "", "short", "line\n" * 1000]
    df = spark.createDataFrame([(1, [(k, 1, None, None, t, None) for k, t in enumerate(texts)])], f"outcome_id long, blocks {BLOCK}")
    got = {r.block_index: r for r in split.rebuilt_blocks(split.split_blocks(df)).collect()}
    for k, t in enumerate(texts):
        assert (got[k].size, got[k].too_long, got[k].bad_joins) == (len(t or ""), 0, 0)
        assert got[k].text_md5 == hashlib.md5((t or "").encode()).hexdigest()


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = "word " * 40 + "end.\n\n" + "more " * 40
    (_, end), _ = split.split_text(text, 300, 0)
    assert text[:end].endswith("end.\n\n")
    text = "x" * 5000
    assert all(b - a <= 1800 for a, b in split.split_text(text))


def test_pages():
    assert split.split_pages(30, set()) == [(1, 30)]
    assert split.split_pages(31, {14}) == [(1, 13), (13, 31)]
    for n in (31, 59, 60, 200, 1001):
        pieces = split.split_pages(n, {7, 40, 41})
        assert pieces[0][0] == 1 and pieces[-1][1] == n and all(b - a < 30 for a, b in pieces)
        assert all(c == b for (_, b), (c, _) in zip(pieces, pieces[1:]))


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [
        (1, None, [(0, 1, None, None, "a" * 1801, None), (1, None, None, None, None, None), (2, 40, None, "heading", "", None)]),
        (2, 31, None), (3, 30, []), (4, None, None), (5, 2, [(None, 1, None, None, "é" * 1800, None), (None, 1, None, None, "😀" * 1801, None)]),
    ]
    df = spark.createDataFrame(rows, f"outcome_id long, page_count int, blocks {BLOCK}").selectExpr("*", "1 AS start", "2 AS pieces", "3 AS text", "4 AS pages")
    assert sorted(tuple(r) for r in split.oversized(df).collect()) == [(1, -1), (1, 0), (2, -1), (5, 1)]
    assert sorted(tuple(r) for r in split.oversized(df.unionByName(df)).collect()) == [(1, -1), (1, 0), (2, -1), (5, 1)]
    assert split.oversized(df.limit(0)).count() == 0
    assert [(r.start, r.end, r.text) for r in split.split_blocks(df).where("outcome_id = 1 AND block_index = 1").collect()] == [(0, 0, None)]
