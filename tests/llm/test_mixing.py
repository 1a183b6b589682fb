import random

import pytest
from fixtures import rows, table

from cabgrid.llm import mixing


def goals(sizes, weights=(3, 1, 2), budget=1.5, ceiling=2.0):
    """The contract's targets by repeated resharing; None sorts last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > ceiling * sizes[s]}
        if not full:
            out.update({s: weight[s] * share for s in open_})
            break
        out.update({s: ceiling * sizes[s] for s in full})
        left -= sum(ceiling * sizes[s] for s in full)
        open_ -= full
    return out


def check(got, data):
    assert len(got) == len(data)
    want_size = {}
    for _, t, _, s, _ in data:
        want_size[s] = want_size.get(s, 0) + len((t or "").split())
    goal = goals(want_size)
    taken = {}
    for r in got:
        assert r.source_size == want_size[r.source]
        assert abs(r.target - goal[r.source]) <= 1e-6 * max(1, goal[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken.setdefault(r.source, []).append(r)
    for s, rs in taken.items():
        copies = {}
        for r in rs:  # documents that share id and text are taken together
            copies[(r.doc_id, r["size"])] = copies.get((r.doc_id, r["size"]), 0) + r["size"]
        off = abs(sum(r.taken for r in rs) - goal[s])
        assert off <= max(copies.values(), default=0), (s, off)


def test_targets_and_copies_on_awkward_rows(spark):
    check(mixing.digest(table(spark, clashes=True)).collect(), rows())


def test_sources_of_the_test_tables_meet_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.digest(docs).collect()
    check(got, [(d.doc_id, d.text, None, d.source, 0) for d in docs.collect()])
    for s in {r.source for r in got}:
        rs = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.02 * rs[0].target


def test_rates_are_the_exponential_tilt(spark):
    """log(rate / (2 - rate)) is linear in size within a source."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in mixing.digest(docs).collect() if 0.01 < r.rate < 1.99 and r["size"] > 0]
    slopes = {}
    for r in got:
        slopes.setdefault(r.source, []).append(math.log(r.rate / (2 - r.rate)) / r["size"])
    assert slopes and all(max(v) - min(v) <= 1e-6 * max(1e-3, abs(v[0])) for v in slopes.values())


def test_reruns_and_layouts_agree(spark):
    a = sorted(mixing.digest(table(spark, parts=1)).collect(), key=str)
    b = sorted(mixing.digest(table(spark, parts=7)).collect(), key=str)
    assert a == b


def test_rows_are_repeated_and_columns_stay(spark):
    docs = table(spark, clashes=True)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_empty_table_and_empty_texts(spark):
    assert mixing.digest(table(spark, [])).count() == 0
    got = mixing.digest(table(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0)] * 2


def test_tilts_that_do_not_converge_are_an_error(spark):
    hist = spark.createDataFrame([("a", n, 1) for n in range(1, 400)], "source string, size long, docs long")
    words = sum(range(1, 400))
    goal = spark.createDataFrame([("a", words, 399, 0.3 * words)], "source string, words long, docs long, target double")
    with pytest.raises(ArithmeticError, match="Newton steps"):
        mixing.tilts(hist, goal, rounds=1, chain=1)
    assert mixing.tilts(hist, goal).count() == 1


def test_a_source_of_very_many_sizes(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(null AS string) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    sized = docs.selectExpr("doc_id", "source", "doc_id + 1 AS size", "rand(1) AS draw")
    plan = mixing.plan_mix(sized).collect()
    assert len(plan) == 20_000
    rate = {(r.source, r["size"]): r for r in plan}
    for s in "ab":
        rs = [r for k, r in rate.items() if k[0] == s]
        took = sum((r.base + (1 if r.cut == mixing.BINS else 0)) * r["size"] for r in rs)
        assert abs(took - rs[0].target) <= 0.01 * rs[0].target


def brute_extra(cells):
    """Copies beyond the base by error diffusion, from the largest size down."""
    out, owed = {}, 0.0
    for size, docs, rate, base in sorted(cells, reverse=True):
        owed += docs * size * (rate - base)
        n = min(max(round(owed / max(size, 1)), 0), docs) if size > 0 and base < 2 else 0
        out[size] = n
        owed -= n * size
    return out


def test_cells_equal_error_diffusion_by_hand(spark):
    rng = random.Random(5)
    hist_rows = [("a", n, rng.randrange(1, 9)) for n in rng.sample(range(500), 200)]
    hist = spark.createDataFrame(hist_rows, "source string, size long, docs long")
    words = sum(n * d for _, n, d in hist_rows)
    docs = sum(d for *_, d in hist_rows)
    goal = spark.createDataFrame([("a", words, docs, 1.3 * words)], "source string, words long, docs long, target double")
    got = mixing.cells(hist, mixing.tilts(hist, goal)).collect()
    want = brute_extra([(r["size"], r.docs, r.rate, r.base) for r in got])
    assert {r["size"]: r.extra for r in got} == want
