"""The dual-tree ranking against brute force over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import rows, table, words

from cabgrid.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(data, items, k=20):
    docs = [(r[0], terms(r[1])) for r in data]
    docs = [(i, len(t), Counter(t)) for i, t in docs if t]
    n, total = len(docs), sum(d[1] for d in docs)
    df = Counter(t for d in docs for t in d[2])
    out = []
    for item, text in items:
        found = []
        for i, size, own in docs:
            m = 75 + (25 * size * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 12 * m))
                for t in terms(text) if t in own
            )
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, at, None if none else i, -s) for at, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


def items_of(rng, n):
    texts = [words(rng, rng.choice([1, 3, 9, 30])) for _ in range(n)] + [None, "", "!!", "The THE the É 123", "unheard of", "a " * 50]
    texts += [rows()[60][1], "w1 w2 w3 w299", "v7 v8"]
    return [(i % 7, t) for i, t in enumerate(texts)]


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS score", "'x' AS item").repartition(2)


def ordered(rows_):
    return sorted((tuple(r) for r in rows_), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 18, 300])
def test_awkward_rows_against_brute_force(spark, block_bytes):
    """Repeated ids in both tables, ties, nulls; one block and several."""
    items = items_of(random.Random(3), 12)
    got = search.ranked(table(spark, clashes=True), frame(spark, items), block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(got.collect()) == ordered(brute(rows(), items))


def test_seeds_and_small_leaves_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(80)]
    data = [(i, words(rng, rng.randrange(1, 40), vocabulary), None, None, None) for i in range(700)]
    data += [(1000 + i, data[5][1], None, None, None) for i in range(120)]  # a group of ties
    items = [(i, words(rng, 6, vocabulary)) for i in range(30)] + [(99, data[5][1])]
    want = ordered(brute(data, items, 5))
    for seeds, leaf, fan, cells in ((1 << 14, 32, 8, 1 << 22), (50, 4, 2, 1 << 22), (1, 2, 3, 100)):
        monkeypatch.setattr(search, "SEED_DOCS", seeds)
        monkeypatch.setattr(search, "LEAF_DOCS", leaf)
        monkeypatch.setattr(search, "FAN", fan)
        monkeypatch.setattr(search, "CELLS", cells)
        assert ordered(search.ranked(table(spark, data, parts=4), frame(spark, items), k=5).collect()) == want


def test_bounds_hold_and_prune():
    """No pair scores above the bound of any nodes over it, and the search
    leaves most leaves unscored."""
    rng = np.random.default_rng(2)
    n_terms, n_docs = 60, 512
    tops = np.repeat(np.arange(16), 32) * 3  # documents of a leaf share terms
    size = np.full(n_docs, 3)
    term = (tops[:, None] + np.arange(3)).ravel() % n_terms
    impact = rng.integers(1, 1000, len(term))
    docs = search.document_tree(np.arange(n_docs), np.zeros(n_docs, int), size, term, impact, n_terms)
    vectors = [{int(t): int(rng.integers(1, 9)) for t in rng.choice(n_terms, 4, replace=False)} for _ in range(20)]
    root = search.item_tree(vectors)
    dense = np.zeros((n_terms, n_docs))
    dense[term, np.repeat(np.arange(n_docs), 3)] = impact
    exact = np.array([sum(w * dense[t] for t, w in v.items()) for v in vectors])

    def check(node):
        for level, maxima in enumerate(docs.levels):
            bound = search._bounds(docs, node, level, np.arange(maxima.shape[1]))
            span = search.LEAF_DOCS * search.FAN**level
            for at in range(maxima.shape[1]):
                assert exact[node.items][:, at * span : (at + 1) * span].max() <= bound[at]
        for child in node.below:
            check(child)

    check(root)
    scored = []
    real = search._score
    best = search.Best(np.zeros(20, dtype=np.int64), 3)
    try:
        search._score = lambda d, node, b, n, leaves: (scored.append(len(leaves)), real(d, node, b, n, leaves))
        search.search(docs, root, best, n_terms)
    finally:
        search._score = real
    for i in range(20):
        assert best.rows[i][:, 0].tolist() == [s for s in sorted(exact[i].astype(int), reverse=True)[:3] if s > 0]
    assert sum(scored) < 20 * 16 / 2


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = ["", "abc", "É" * 30, " ".join(f"w{rng.randrange(99)}!é" for _ in range(200))]
    for size in (1, 5, 64):
        monkeypatch.setattr(search, "PIECE", size)
        for t in texts:
            assert [w.decode() for ws in search.term_lists(t.encode()) for w in ws] == terms(t)


def test_empty_tables(spark):
    some, none = frame(spark, [(1, "the of")]), spark.createDataFrame([], "item_id long, text string")
    assert search.ranked(table(spark, []), some).count() == 0
    assert search.ranked(table(spark), none).count() == 0
    assert search.ranked(table(spark), spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0
