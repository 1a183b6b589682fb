"""Small tables with the awkward cases every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# columns whose names the operators use inside
CLASHES = [
    "text_hash", "fp", "component_id", "node", "key", "words", "size", "rate", "copies", "target", "shard", "slot",
    "hash", "spans", "gone", "kept", "n_words", "first", "anchor", "number", "score", "lang_pred", "__row",
]


def words(rng, n, vocabulary="the of and to a in is it was for on are with as at be this from or had by but".split()):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows(seed=7, n=60):
    """(doc_id, text, lang, source, n_chars): nulls, empties, copies, ties, a long text."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = words(rng, rng.choice([0, 1, 2, 5, 20, 60, 120]))
        out.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "é"]), len(t)))
    base = words(rng, 80, [f"w{j}" for j in range(300)])
    for i in range(n, n + 12):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"x{i % 4}"
        out.append((i, " ".join(w), "en", "a", None))
    out += [
        (200, base, "en", "a", 1),
        (201, base, "en", "a", 1),
        (201, base, "en", "a", 1),  # a repeated row
        (202, "", "en", "b", 0),
        (203, None, "en", "b", None),
        (203, None, None, None, None),
        (None, base, None, "b", 3),
        (None, None, None, None, None),
        (204, "\n \t\n", "fr", "b", 4),
        (205, words(rng, 30_000, [f"v{j}" for j in range(2000)]), "fr", "é", 9),
        (205, "one id, two texts", "en", "a", 9),
        (206, "a " * 500, "en", "a", 1000),
        (207, "!!! ??? 123", "en", "b", 11),
        (208, "ÉÀ straße 😀 K", "de", "b", 11),
    ]
    return out


def table(spark, data=None, parts=3, clashes=False):
    df = spark.createDataFrame(rows() if data is None else data, DOCS).repartition(parts)
    if clashes:
        df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
    return df


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
