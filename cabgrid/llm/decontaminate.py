"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words: lower-case A-Z, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window
is ``window`` consecutive words of an item; an item with fewer (but some)
words is one window of its own length.

Winnowing keeps, for every window, the smallest hash among its ``gram``-word
grams.  A window that a document shares with an item has the same grams and
so the same smallest one: no shared window is missed.  In a document,
neighbouring windows with equal fingerprints form one run.  The runs' few
hashes are joined with the items' fingerprints; only documents with a hit are
read again, where each hit is extended: the windows of its run are compared,
as text, with the items' windows.

The items' windows and fingerprints are written first, so the planner knows
their size and broadcasts them only below its threshold; beyond it both joins
shuffle, and adaptive execution splits hot fingerprints.  A window lists its
items once, so a passage that many items and many documents share is not
paired item by document until the items of one document are gathered.

Defined results: null or empty text has no words; items without words have
no windows; a null item_id is written as an empty string; rows that repeat an
item_id count as one item; repeated documents get equal results; empty
tables give no hits; other columns are ignored (or kept by :func:`clean`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import left_lookup, let, n_pieces, positions, text_hash, text_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
GAP_BEFORE_LOWERING = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
KEY = ["doc_id", "text_hash"]


def bench_words(text: Column) -> Column:
    low = F.translate(text_of(text), UPPER, LOWER)
    return F.filter(F.split(low, GAP + "+"), lambda w: w != F.lit(""))


def _at(arr: Column, i: Column) -> Column:
    return F.get(arr, i)


def _window_marks(hashes: Column, length: int, gram: int) -> Column:
    """Smallest gram hash of every window of ``length`` words (by start)."""
    k = min(gram, length)
    span = length - k + 1
    grams = F.transform(
        positions(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*[_at(hashes, i + j) for j in range(k)])
    )
    if span == 1:
        return grams
    return let(
        grams,
        lambda g: F.transform(
            positions(F.size(hashes) - (length - 1)), lambda p: F.least(*[_at(g, p + j) for j in range(span)])
        ),
    )


def _runs(hashes: Column, length: int, gram: int) -> Column:
    """array<struct<len, mark, first, last>>: neighbouring windows with one mark."""

    def cut(marks):
        starts = F.filter(
            positions(F.size(marks)), lambda p: (p == 0) | (_at(marks, p) != _at(marks, p - 1))
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda p, j: F.struct(
                    F.lit(length).alias("len"),
                    _at(marks, p).alias("mark"),
                    p.alias("first"),
                    (F.coalesce(_at(s, j + 1), F.size(marks)) - 1).alias("last"),
                ),
            ),
        )

    return let(_window_marks(hashes, length, gram), cut)


def _windows(ws: Column, starts: Column, length: Column) -> Column:
    return F.transform(
        starts,
        lambda p: F.struct(p.alias("at"), F.array_join(F.slice(ws, p + 1, length), " ").alias("words")),
    )


def item_windows(items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """(len, words, mark, items): the distinct windows and who has them."""
    parts = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), bench_words(F.col("text")).alias("ws")
    ).filter(F.size("ws") > 0)
    hashed = parts.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    every = None
    for length in range(1, window + 1):
        fits = F.size("ws") >= length if length == window else F.size("ws") == length
        some = hashed.filter(fits).select(
            "item",
            F.lit(length).alias("len"),
            _windows(F.col("ws"), positions(F.size("ws") - (length - 1)), F.lit(length)).alias("wins"),
            _window_marks(F.col("hs"), length, gram).alias("marks"),
        )
        every = some if every is None else every.unionByName(some)
    flat = every.select(
        "item", "len", F.explode(F.arrays_zip("wins", "marks")).alias("w")
    ).select("item", "len", F.col("w.wins.words").alias("words"), F.col("w.marks").alias("mark"))
    return flat.groupBy("len", "words", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, text_hash, hits, n_hit, items) of the documents with a hit.

    ``hits`` are the (at, len) windows found, in order; ``n_hit`` the number
    of words they cover; ``items`` the ids (as text, sorted) they belong to.
    """
    wins = written(item_windows(items, window, gram), "bench-windows")
    marks = written(wins.select("len", "mark").distinct(), "bench-marks")
    lengths = sorted(r[0] for r in marks.select("len").distinct().collect())  # at most `window` numbers

    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    if not lengths:
        lengths = [window]
    runs = rows.select(
        *KEY,
        F.inline(
            let(
                F.transform(bench_words(F.col("text")), lambda w: F.xxhash64(w)),
                lambda h: F.concat(*[_runs(h, n, gram) for n in lengths]),
            )
        ),
    )
    met = runs.join(marks, ["len", "mark"], "left_semi")
    met = met.groupBy(*KEY).agg(F.collect_set(F.struct("len", "first", "last")).alias("runs"))
    met = written(met, "bench-hits")

    again = left_lookup(rows, met, KEY, "inner").select(*KEY, "runs", bench_words(F.col("text")).alias("ws"))
    tried = again.select(
        *KEY,
        F.inline(
            F.flatten(
                F.transform(
                    "runs",
                    lambda r: F.transform(
                        _windows(F.col("ws"), F.sequence(r["first"], r["last"]), r["len"]),
                        lambda w: F.struct(r["len"].alias("len"), w["at"].alias("at"), w["words"].alias("words")),
                    ),
                )
            )
        ),
    )
    hit = tried.join(wins.select("len", "words", "items"), ["len", "words"])
    found = hit.groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("at", "len"))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return written(found.withColumn("n_hit", _covered(F.col("hits"))), "bench-found")


def _covered(hits: Column) -> Column:
    """Number of words in the union of sorted (at, len) windows."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def add(s, h):
        end = (h["at"] + h["len"]).cast("long")
        return F.struct(
            (s["n"] + F.greatest(end - F.greatest(s["to"], h["at"].cast("long")), F.lit(0).cast("long"))).alias("n"),
            F.greatest(s["to"], end).alias("to"),
        )

    return F.aggregate(hits, start, add, lambda s: s["n"])


def clean(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The rows of ``docs`` in which no item window occurs, columns unchanged."""
    found = find(docs, items, window, gram).select("doc_id", "text_hash")
    rows = docs.select(
        F.struct("*").alias("__row"), F.col("doc_id"), text_hash(F.col("text")).alias("text_hash")
    )
    return left_lookup(rows, found, KEY, "left_anti").select("__row.*")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = find(docs, items).select(*KEY, "n_hit", "items")
    rows = docs.select(
        "doc_id",
        text_hash(F.col("text")).alias("text_hash"),
        n_pieces(text_of("text"), GAP_BEFORE_LOWERING).alias("n_words"),
    )
    items_col = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return left_lookup(rows, found, KEY).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS m, ws[i:i + least(len(ws), 10) - 1] AS win
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT row, m, i, ws[i:i + m - 1] AS win
  FROM (SELECT row, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, ms WHERE len(ws) >= m)),
hits AS (SELECT dw.row, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
covered AS (
  SELECT row, count(DISTINCT w) AS n_hit
  FROM (SELECT row, unnest(generate_series(i, i + m - 1)) AS w FROM (SELECT DISTINCT row, i, m FROM hits))
  GROUP BY row),
named AS (
  SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hits GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""
