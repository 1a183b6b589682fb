import hashlib
import random
import re

from fixtures import rows, same, table, words

from cabgrid.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(data, items, size=10):
    wins = {}
    for item, t in items:
        w = cut(t)
        for p in range(max(len(w) - size + 1, 1) if w else 0):
            wins.setdefault(tuple(w[p : p + size]), set()).add("" if item is None else str(item))
    lengths = {len(x) for x in wins}
    out = []
    for r in data:
        w, hit, ids = cut(r[1]), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    ids |= wins[tuple(w[p : p + n])]
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((r[0], len(w), len(hit), len(ids), sha, bool(hit)))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_awkward_rows_with_short_and_shared_items(spark):
    rng = random.Random(2)
    data = rows()
    long = next(t for i, t, *_ in data if i == 205 and len(t) > 100)
    items = [(i, words(rng, n)) for i, n in enumerate([0, 1, 2, 3, 5, 7, 9, 10, 11, 40])]
    items += [(50, data[60][1]), (51, data[60][1]), (52, " ".join(long.split()[100:130])), (None, "STRASSE straße"),
              (53, None), (3, "of the And"), (10, "😀 k"), (2, "K")]
    got = decontaminate.digest(table(spark, clashes=True), bench(spark, items)).collect()
    same(got, brute(data, items))


def test_marks_of_equal_windows_are_equal_wherever_they_stand(spark):
    """Every shared window is met, whatever stands around it."""
    rng = random.Random(4)
    shared = words(rng, 10)
    data = [(i, f"{words(rng, rng.randrange(40))} {shared.upper()} {words(rng, rng.randrange(40))}", "", "", 0) for i in range(60)]
    got = decontaminate.digest(table(spark, data), bench(spark, [(1, f"x y z {shared} p q")])).collect()
    assert all(r.contaminated and r.n_hit >= 10 for r in got)
    same(got, brute(data, [(1, f"x y z {shared} p q")]))


def test_clean_rows_stay_unchanged(spark):
    docs = table(spark, clashes=True)
    items = bench(spark, [(1, rows()[60][1])])
    want = {r[0] for r in brute(rows(), [(1, rows()[60][1])]) if not r[5]}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_empty_tables(spark):
    docs, items = table(spark), bench(spark, [])
    assert decontaminate.digest(table(spark, []), bench(spark, [(1, "a b")])).count() == 0
    got = decontaminate.digest(docs, items).collect()
    assert len(got) == len(rows()) and not any(r.contaminated for r in got)
