import collections
import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import rows, same, table

from cabgrid.llm import substring


def brute(data, window):
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in data]
    count = collections.Counter(tuple(w[p : p + window]) for _, w in texts for p in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def found(df, window, gram):
    out = substring.without_repeats(df, window, gram, keep=("doc_id",))
    return out.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept AS binary), 256)").collect()


def test_contract_query_equals_brute_force_on_awkward_rows(spark):
    data = [r[:2] for r in rows()]
    same(substring.digest(table(spark)).collect(), brute(data, 35))


@pytest.mark.parametrize("window,gram", [(9, 4), (5, 5)])
def test_repetitive_texts(spark, window, gram):
    rng = random.Random(5)
    data = []
    for i in range(150):
        letters = "ab" if rng.random() < 0.3 else "abcdefgh"
        data.append((i, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 8, 9, 20, 60, 200])))))
    data += [(900, "a " * 300), (901, "a b " * 90), (5, data[5][1])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    same(found(df, window, gram), brute(data, window))


@pytest.mark.parametrize("window,gram", [(35, 8), (9, 4), (5, 5)])
def test_every_period_up_to_a_window(spark, window, gram):
    """Each text repeats its own words only, so only its own windows are equal."""
    data = []
    for period in range(1, window + 2):
        for n in (window + period - 1, window + period, window + 2 * period + 3, 10 * period + window):
            for lead in (0, 3):
                i = len(data)
                own = [f"d{i}w{j}" for j in range(period)]
                data.append((i, " ".join([f"d{i}l{j}" for j in range(lead)] + [own[j % period] for j in range(n)])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    same(found(df, window, gram), brute(data, window))


def test_pieces_of_a_long_text_share_all_but_one_word_of_a_window():
    rng = random.Random(1)
    raw = " ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(500)).encode()
    whole = substring.word_hashes(raw).tolist()
    old = substring.PIECE
    substring.PIECE = 100
    try:
        seen = []
        for hashes, owner, parts in substring.pieces([b"x y", raw, b""], 7):
            for j, (i, at) in enumerate(parts):
                if i == 1:
                    own = hashes[owner == j].tolist()
                    assert own == whole[at : at + len(own)]
                    seen.append((at, at + len(own)))
    finally:
        substring.PIECE = old
    assert len(seen) > 5 and seen[0][0] == 0 and seen[-1][1] == len(whole)
    assert all(b[0] == a[1] - 6 for a, b in zip(seen, seen[1:]))


def test_empty_table_and_clashing_columns(spark):
    assert substring.digest(table(spark, [])).count() == 0
    out = substring.without_repeats(table(spark, clashes=True))
    assert out.count() == len(rows()) and out.columns.count("n_words") == 1


def test_a_window_needs_two_words():
    with pytest.raises(ValueError, match="two words"):
        list(substring.pieces([b"a"], 1))


def phrase(text):
    return text.encode().split(b" ")


def test_greedy_factors_are_the_longest_matches_and_go_on_at_their_boundary():
    own = phrase("a b c G H d e f g")
    indexed = [(phrase("x b c G H d e y"), 3), (phrase("c G H d e f g z"), 1), (phrase("a b c G X d e"), 3)]
    found, rest = substring.factors(own, 3, indexed, window=5, gram=2)
    # from b the first phrase gives 6 words; the next window starts at G, in the second phrase only
    assert found == [(1, 7, 0, 1), (3, 9, 1, 1)]
    assert rest == [0]
    assert substring.factors(own, 3, [], 5, 2) == ([], [0, 1, 2, 3, 4])


def test_a_factor_needs_equal_words_not_equal_hashes():
    """An indexed phrase whose anchor gram only shares the hash matches nothing."""
    found, rest = substring.factors(phrase("a b G H c d"), 2, [(phrase("a b X Y c d"), 2)], 4, 2)
    assert not found and rest == [0, 1, 2]


def test_blocks_with_more_phrases_than_their_index_holds(spark):
    """One anchor passage in very many texts with other words around it, of
    which pairs agree in part: most agree outside the index."""
    rng = random.Random(3)
    core = [f"c{j}" for j in range(8)]
    data = []
    for i in range(300):
        left, right = ([f"{s}{rng.randrange(2)}{j}" if j < 6 else f"{s}{i}x{j}" for j in range(12)] for s in "lr")
        data.append((i, " ".join(left[::-1] + core + right)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    for window in (12, 15, 18):
        same(found(df, window, 4), brute(data, window))


def test_spans_of_parts_of_phrases_come_from_the_factors(spark, monkeypatch):
    shared = " ".join(f"s{j}" for j in range(40))
    data = [(i, " ".join(f"d{i}w{j}" for j in range(30)) + " " + shared + f" e{i}") for i in range(2)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    same(found(df, 35, 8), brute(data, 35))
    real = substring._factored
    monkeypatch.setattr(substring, "_factored", lambda *a: real(*a).filter("hash IS NOT NULL"))
    assert sum(r[2] for r in found(df, 35, 8)) < 80


def test_a_hot_block_is_parsed_with_copies_of_its_index(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARE", 7)
    rng = random.Random(4)
    core = [f"c{j}" for j in range(9)]
    data = [(i, " ".join([f"l{rng.randrange(40)}", *core, f"r{rng.randrange(40)}", f"x{i}"])) for i in range(200)]
    data += [(200 + i, " ".join([*core, *core, f"y{i % 3}"])) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    same(found(df, 10, 4), brute(data, 10))


def exact_count(data):
    """The contract's rows by exact names of windows: equal stretches of words
    get equal numbers, from one word to 32 by doubling, then 35; no hashes."""
    words = [(t or "").encode().split() for _, t in data]
    number = {}
    cur = flat = np.array([number.setdefault(w, len(number)) for ws in words for w in ws])
    owner = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
    for step in (1, 2, 4, 8, 16, 3):
        pair = cur[:-step] * (int(cur.max()) + 1) + cur[step:]
        cur = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    inside = owner[: len(cur)] == owner[34:]
    count = np.bincount(cur[inside], minlength=int(cur.max()) + 1)
    start = np.flatnonzero(inside & (count[cur] > 1))
    edge = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + 35, -1)
    gone, at, out = np.cumsum(edge) > 0, 0, []
    for (i, _), ws in zip(data, words):
        own = gone[at : at + len(ws)]
        kept = b" ".join(w for w, g in zip(ws, own) if not g)
        out.append((i, len(ws), int(own.sum()), hashlib.sha256(kept).hexdigest()))
        at += len(ws)
    return out


def test_whole_table_equals_an_exact_count(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    data = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = substring.digest(df).collect()
    same(got, exact_count(data))
    assert sum(r.n_removed for r in got) > 0
