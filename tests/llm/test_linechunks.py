import collections
import hashlib
import random
import re

from fixtures import rows, same, table
from pyspark.sql import functions as F

from cabgrid.llm import linechunks, queries


def brute(spark, data):
    """Chunks and copies by hand; only the two hash values are Spark's."""
    lines = [(t or "").split("\n") for _, t in data]
    uniq = sorted({x for ls in lines for x in ls})
    h = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in uniq], "l string").select("l", F.xxhash64("l")).collect()}
    pairs = sorted({(h[a], h[b]) for ls in lines for a, b in zip(ls, ls[1:])})
    roll = {}
    if pairs:
        df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("b", "a"))
        roll = {(r[0], r[1]): r[2] for r in df.collect()}
    named = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(data)], "k long, t string")
    th = {r[0]: r[1] for r in named.select("k", F.when(F.col("t").isNull(), 0).otherwise(F.xxhash64("t"))).collect()}
    places = collections.defaultdict(set)
    for k, ls in enumerate(lines):
        starts = [0] + [i for i in range(2, len(ls)) if roll[h[ls[i - 2]], h[ls[i - 1]]] % 4 == 0]
        for a, b in zip(starts, [*starts[1:], len(ls)]):
            if sum(bool(re.search("[^ \t-\r]", x)) for x in ls[a:b]) >= 2:
                i = data[k][0]
                places["\n".join(ls[a:b])].add(((i is not None, i or 0), th[k], a, b - a, data[k]))
    gone = collections.defaultdict(set)
    for found in places.values():
        for p in sorted(found, key=lambda x: x[:4])[1:]:
            gone[p[4]].update(range(p[2], p[2] + p[3]))
    out = []
    for k, (i, t) in enumerate(data):
        kept = "\n".join(x for j, x in enumerate(lines[k]) if j not in gone[i, t])
        out.append((i, len(lines[k]), len(gone[i, t]), len(kept), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_contract_of_the_query_on_awkward_rows(spark):
    shared = "\n".join(f"shared line {i}" for i in range(40))
    data = [r[:2] for r in rows()] + [
        (400 + i, f"own {i}\n" * (i % 3) + shared + f"\nend {i}", ) for i in range(20)
    ] + [(500, "x\n" * 60), (501, "x\n" * 61), (502, "a\nb\nc\n" * 50), (None, shared)]
    df = table(spark, [(i, t, None, None, 0) for i, t in data], clashes=True)
    got = linechunks.digest(df).collect()
    same(got, brute(spark, data))
    assert sum(r.n_removed for r in got) > 300


def test_an_inserted_line_moves_only_its_own_chunk(spark):
    base = [f"line {i}" for i in range(200)]
    data = [(1, "\n".join(base), None, None, 0), (2, "\n".join(base[:100] + ["new"] + base[100:]), None, None, 0)]
    got = {r.doc_id: r for r in linechunks.digest(table(spark, data)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 170


def test_a_hash_collision_removes_nothing(spark, monkeypatch):
    """With one hash for all chunks, bytes alone decide."""
    data = [(1, "a\nb", None, None, 0), (2, "c\nd", None, None, 0), (3, "a\nb", None, None, 0)]
    real = linechunks.chunks
    monkeypatch.setattr(linechunks, "chunks", lambda *a: real(*a).withColumn("hash", F.lit(1).cast("long")))
    got = {r.doc_id: r.n_removed for r in linechunks.digest(table(spark, data)).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_empty_table_and_kept_columns(spark):
    assert linechunks.digest(table(spark, [])).count() == 0
    out = linechunks.deduplicated(table(spark, clashes=True))
    assert out.count() == len(rows()) and out.columns.count("kept") == 1


def brute_runs(data):
    """Every worded line in a pair of neighbouring worded lines that stands
    earlier goes, whatever the chunks; places in Spark's order of the rows."""
    lines = [(t or "").split("\n") for _, _, t in data]
    worded = [[j for j, x in enumerate(ls) if re.search("[^ \t-\r]", x)] for ls in lines]
    first, out = {}, []
    order = sorted(range(len(data)), key=lambda k: (data[k][0] is not None, data[k][0] or 0, data[k][1]))
    for k in order:
        for m, (a, b) in enumerate(zip(worded[k], worded[k][1:])):
            first.setdefault((lines[k][a], lines[k][b]), (data[k], m))
    for k, (i, _, _) in enumerate(data):
        ls, w = lines[k], worded[k]
        gone = set()
        for m, (a, b) in enumerate(zip(w, w[1:])):
            if first[ls[a], ls[b]] != (data[k], m):
                gone |= {a, b}
        for j in range(len(ls)):
            if w and j not in w:
                around = [x for x in w if x < j][-1:] + [x for x in w if x > j][:1]
                if all(x in gone for x in around):
                    gone.add(j)
        kept = "\n".join(x for j, x in enumerate(ls) if j not in gone)
        out.append((i, len(ls), len(gone), len(kept), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def queried(spark, scratch, data):
    df = table(spark, [(i, t, None, None, 0) for i, t in data], clashes=True)
    df.write.parquet(f"{scratch}/documents.parquet")
    hashes = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    keyed = [(i, 0 if t is None else hashes[t], t) for i, t in data]
    return queries.op10_line_chunks(spark, scratch).collect(), keyed


def test_query_takes_every_later_run_wherever_edges_fall(spark, scratch):
    rng = random.Random(11)
    shared = "\n".join(f"shared line {i}" for i in range(40))
    data = [r[:2] for r in rows()]
    data += [(400 + i, f"own {i}\n" * (i % 3) + shared + f"\nend {i}") for i in range(20)]
    data += [(500, "x\n" * 60), (501, "x\n" * 61), (502, "a\nb\nc\n" * 50), (None, shared)]
    for i in range(300):  # short and long passages of few lines, blank lines between
        lines = [rng.choice(["", " ", "\t", *"abcdefghijklmnopqrstuvwxyz"]) for _ in range(rng.choice([1, 2, 3, 8, 30]))]
        data.append((600 + i, "\n".join(x * (i % 40 + 1) for x in lines)))
    got, keyed = queried(spark, scratch, data)
    same(got, brute_runs(keyed))


def test_query_takes_short_passages_and_whole_copies(spark, scratch):
    data = [(1000 + i, f"one {i}\nfirst of the passage\n\nsecond of it\ntwo {i}") for i in range(40)]
    data += [(2000 + i, f"\nhead {i}\n\nbody {i}\n") for i in range(40)]
    data += [(3000 + i, f"\nhead {i}\n\nbody {i}\n") for i in range(40)]
    got, _ = queried(spark, scratch, data)
    got = {r.doc_id: r for r in got}
    assert got[1000].n_removed == 0 and all(got[1000 + i].n_removed == 3 for i in range(1, 40))
    assert all(got[2000 + i].n_removed == 0 and got[3000 + i].n_removed == 5 for i in range(40))


def test_a_collision_of_runs_removes_nothing(spark, monkeypatch):
    data = [(1, "a\nb\nx", None, None, 0), (2, "c\nd\ny", None, None, 0), (3, "z\na\nb", None, None, 0)]
    real = linechunks.runs
    monkeypatch.setattr(linechunks, "runs", lambda *a: real(*a).withColumn("hash", F.lit(1).cast("long")))
    got = {r.doc_id: r.n_removed for r in linechunks.whole_digest(table(spark, data)).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_runs_of_an_empty_table_and_kept_columns(spark):
    assert linechunks.whole_digest(table(spark, [])).count() == 0
    out = linechunks.without_repeats(table(spark, clashes=True))
    assert out.count() == len(rows()) and out.columns.count("kept") == 1
