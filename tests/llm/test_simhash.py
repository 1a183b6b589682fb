import random
import re

import pytest
import xxhash
from fixtures import rows, same, table

from cabgrid.llm import simhash
from cabgrid.llm.components import components

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    k = min(3, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(nodes, linked):
    """Smallest node reachable, by brute force over all pairs."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def brute(data):
    fps = [(r[0], fingerprint(r[1])) for r in data]
    comp = closure(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return [(i, f"{f:016x}", least.get(comp[f])) for i, f in fps]


def test_contract_query_on_awkward_rows(spark):
    same(simhash.digest(table(spark, clashes=True)).collect(), brute(rows()))


@pytest.mark.parametrize("bucket", [0, 3, 64])
def test_links_reach_what_all_pairs_reach(spark, bucket):
    """Small and large buckets, chains and dense groups of fingerprints."""
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for seed in list(fps)[:6]:
        x = seed
        for _ in range(12):  # chains of steps of 0 to 3 bits
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
        fps |= {seed ^ (1 << b) for b in range(0, 64, 3)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.links(nodes, 2, bucket)).collect()}
    want = closure(sorted(signed), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    path = list(range(100))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(200, 200 + i) for i in range(1, 60)] + [(300, 300), (400, 401), (401, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(100)) and all(got[200 + i] == 200 for i in range(60))
    assert got[401] == 400 and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept_brute(data):
    """Of each component (by brute force over fingerprints) the (doc_id, text)
    rows that may stay: those of its smallest doc_id, null last."""
    comp = closure(sorted({fingerprint(r[1]) for r in data}), lambda a, b: (a ^ b).bit_count() <= 2)
    members = {}
    for r in data:
        members.setdefault(comp[fingerprint(r[1])], set()).add((r[0], r[1]))
    out = []
    for rows_ in members.values():
        least = min((i is None, i or 0) for i, _ in rows_)
        out.append({r for r in rows_ if (r[0] is None, r[0] or 0) == least})
    return out


def one_of_each(got, data):
    """Every component keeps exactly one row, one of those that may stay."""
    may = kept_brute(data)
    got = [tuple(r)[:2] for r in got]
    assert len(got) == len(may)
    assert all(sum(r in rows_ for r in got) == 1 for rows_ in may)


def test_one_row_of_each_component_stays(spark):
    docs = table(spark, clashes=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    one_of_each(kept.collect(), rows())


def test_unlike_texts_that_share_or_lack_an_id_all_stay(spark):
    rng = random.Random(6)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(50)) for _ in range(8)]
    data = [(i, t, None, None, None) for i, t in zip((7, 7, 8, None, None, None, 8, 7), texts)]
    data += [(7, texts[0], None, None, None), (None, texts[3], "en", None, None), (9, texts[4], None, None, None)]
    kept = simhash.keep_one(table(spark, data)).collect()
    assert sorted(r.text for r in kept) == sorted(texts)
    one_of_each(kept, data)


def test_empty_table_and_odd_distance(spark):
    assert simhash.digest(table(spark, [])).count() == 0
    assert simhash.keep_one(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([], "node long, fp long"), 3)


def test_pieces_give_the_same_fingerprint(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("ABcd"[rng.randrange(4)] * rng.randrange(1, 9) for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 400)]
    texts += ["", " ", "x" * 500, " a\t\nb  " * 60]
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert [simhash.simhash(t.encode(), 3) for t in texts] == [fingerprint(t) for t in texts]
