import random

import numpy as np
import pytest

from millrace.llm import packing, tokens

pytest.importorskip("tiktoken")


def test_best_fit_avoids_conflicts_where_room_allows():
    sizes, none = np.array([50, 50, 50, 50]), np.full(4, -1)
    got = packing.best_fit(sizes, np.array([0, 0, 1, 1]), none, 100)
    assert len(set(got)) == 2 and got[0] != got[1] and got[2] != got[3]
    # All of one cluster: room comes first.
    assert len(set(packing.best_fit(sizes, none, np.zeros(4, int), 100))) == 2


def test_best_fit_against_bounds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 101, 300)
        got = packing.best_fit(sizes, rng.integers(0, 5, 300), rng.integers(-1, 40, 300), 100)
        fill = np.bincount(got, weights=sizes)
        assert fill.max() <= 100
        assert len(fill) <= -(-sizes.sum() // 100) * 1.25 + 1


def plain_best_fit(sizes, sources, clusters, capacity):
    """The same rule by trying every container."""
    bins = []
    ideal = -(-int(sizes.sum()) // capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        pick = -1
        for level in range(3):
            if level and len(bins) < ideal:
                break
            free = [b for b, (room, items) in enumerate(bins) if room >= sizes[i]
                    and (level > 0 or sources[i] < 0 or all(sources[j] != sources[i] for j in items))
                    and (level > 1 or clusters[i] < 0 or all(clusters[j] != clusters[i] for j in items))]
            if free:
                pick = min(bins[b][0] for b in free)
                pick = min(b for b in free if bins[b][0] == pick)
                break
        if pick < 0:
            bins.append([capacity, []])
            pick = len(bins) - 1
        bins[pick][0] -= sizes[i]
        bins[pick][1].append(i)
    return bins


def test_the_tree_fills_as_the_plain_rule_does(monkeypatch):
    rng = np.random.default_rng(4)
    for hot in (0.02, 2.0):
        monkeypatch.setattr(packing, "HOT", hot)
        for _ in range(15):
            sizes = rng.integers(1, 101, 200)
            sources, clusters = rng.choice([-1, 0, 0, 0, 1, 2, 3], 200), rng.integers(-1, 60, 200)
            got = packing.best_fit(sizes, sources, clusters, 100)
            fill = np.bincount(got, weights=sizes)
            want = plain_best_fit(sizes, sources, clusters, 100)
            assert fill.max() <= 100 and abs(len(fill) - len(want)) <= 2


def test_conflicts_are_counted(spark):
    rows = [("a", 5, "s", b"x"), ("a", 5, "s", b"y"), ("b", 5, None, b"z"), ("b", 5, None, b"z"), ("c", 1, "t", None)]
    r = packing.usage(spark.createDataFrame(rows, "container string, n_tokens int, source string, cluster binary"), 10).first()
    assert (r["items"], r.containers, r.tokens, r.same_source, r.same_cluster) == (5, 3, 21, 1, 1)


@pytest.mark.parametrize("group", [20_000, 15])
def test_every_text_once_and_within_capacity(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "ITEMS_A_GROUP", group)
    rng = random.Random(3)
    texts = [None, "", " ", "pump " * 9000] + ["leak at the pump " * rng.randrange(1, 300) for _ in range(150)] + ["same text " * 40] * 30
    rows = [(k, t, None if k % 9 == 0 else f"s{k % 3}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS id", "2 AS cluster", "3 AS `group`", "4 AS tokens")
    got = packing.pack(df).collect()
    encode = tokens.encoding(tokens.vocabulary()).encode_ordinary
    want = {k: len(encode(t)) for k, t in enumerate(texts) if t}
    sums, fill = {}, {}
    for r in got:
        sums.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.n_tokens))
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert {k: sum(n for _, _, n in v) for k, v in sums.items()} == want
    for k, pieces in sums.items():
        at = 0
        for number, (piece, start, n) in enumerate(sorted(pieces), 1):
            assert (piece, start) == (number, at)
            at += n
        assert len(pieces) == -(-want[k] // 2048)
    assert max(fill.values()) <= 2048 and all(fill[r.container] == r.fill for r in got)
    assert len(fill) <= sum(want.values()) / 2048 * (1.02 if group > 1000 else 1.3) + 2
    assert packing.pack(df.limit(0)).count() == 0
