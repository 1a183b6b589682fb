"""Host-level quality rules, with DataFrame functions only.

Per document, over the whole text: n_words, word_chars, n_symbols,
n_dup_lines, n_repeat_words (see :func:`features`).  A document fails if
``base_failed`` or one of the further rules (:func:`failed`) holds.

Failures are counted by host (``source``; null is a host of its own) with
combining aggregates.  Failure rates of small hosts are noisy, so each is
shrunk towards all hosts' rate by a beta prior fitted to the hosts
themselves: with the intra-host correlation ``rho`` of the beta-binomial
(method of moments), the prior weighs ``1 / rho - 1`` documents.  A host whose
shrunken rate exceeds ``max_rate`` is rejected, and its verdict is joined
back: a document is kept if it does not fail and its host is not rejected.

The features are written once (numbers only).  The host table is written too,
so the planner broadcasts it only below its own threshold; a hot host is
split by adaptive execution beyond that.

Defined results: null text has no words and fails; repeated rows are separate
documents; no documents: no hosts, no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, positions, text_of, words, written

SYMBOLS = "#*$%&|<>"
MAX_RATE = 0.5
FEW_KEYS = 8


def _repeat_words(ws: Column) -> Column:
    """Words covered by 3-word windows that the text holds twice or more."""
    n = F.size(ws)
    keys = F.transform(positions(n - 2), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(at):  # window starts in order
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda s, i: F.struct(
                (s["n"] + i + 3 - F.greatest(s["to"], i)).alias("n"), (i + 3).alias("to")
            ),
            lambda s: s["n"],
        )

    def few(h, twice):
        return covered(F.filter(positions(F.size(h)), lambda i: F.array_contains(twice, F.get(h, i))))

    def many(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = let(
            placed,
            lambda p: F.filter(
                p,
                lambda e, j: (F.get(p, j - 1)["x"] == e["x"]) | (F.get(p, j + 1)["x"] == e["x"]),
            ),
        )
        return covered(F.sort_array(F.transform(same, lambda e: e["i"])))

    def count(h):
        twice = let(
            F.sort_array(h),
            lambda s: F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (F.get(s, j - 1) == x))),
        )
        return let(
            twice,
            lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= FEW_KEYS, few(h, t)).otherwise(many(h)),
        )

    return let(keys, count).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words).

    Words ``[^\\x20\\x09-\\x0D]+``; word_chars: code points in words; n_symbols:
    characters of ``SYMBOLS``; n_dup_lines: ``\\n``-split lines with a word
    that equal an earlier line; n_lines: lines with a word.
    """
    text = text_of("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    made = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    lined = let(
        lines,
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(x).cast("long").alias("n_lines"),
        ),
    )
    symbols = F.regexp_count(text, F.lit("[" + SYMBOLS + "]")).cast("long")
    source = F.col("source").cast("string").alias("source")
    return docs.select("doc_id", source, made.alias("w"), lined.alias("l"), symbols.alias("n_symbols")).select(
        "doc_id", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failed() -> Column:
    """Base rules, more symbols than words, mostly repeated lines, or words of
    an implausible mean length."""
    return (
        base_failed()
        | (F.col("n_symbols") > F.col("n_words"))
        | (2 * F.col("n_dup_lines") > F.col("n_lines"))
        | (F.col("word_chars") > 25 * F.col("n_words"))
        | (F.col("word_chars") < 2 * F.col("n_words"))
    )


def hosts(feats: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, docs, fails, rate, rejected), a row per host."""
    by = feats.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("fails")
    )
    by = written(by, "hosts")
    rate = F.col("fails") / F.col("docs")
    d = "decimal(38,12)"
    # sum of docs * rate^2, from which the spread of the rates follows
    row = by.agg(
        F.count("*").alias("hosts"),
        F.sum("docs").alias("docs"),
        F.sum("fails").alias("fails"),
        F.sum((F.col("fails") * rate).cast(d)).cast("double").alias("squares"),
    ).first()
    mean, weight = prior(row["hosts"], row["docs"] or 0, row["fails"] or 0, row["squares"] or 0.0)
    shrunk = (F.col("fails") + weight * mean) / (F.col("docs") + weight)
    return written(
        by.withColumn("rate", shrunk).withColumn("rejected", F.col("rate") > max_rate), "host-verdicts"
    )


def prior(n_hosts: int, docs: int, fails: int, squares: float) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior of the hosts' rates."""
    if not docs:
        return 0.0, 1.0
    mean = fails / docs
    spread = squares - docs * mean * mean
    if n_hosts < 2 or docs <= n_hosts or mean in (0.0, 1.0):
        return mean, 1.0
    rho = (spread / (mean * (1 - mean)) - (n_hosts - 1)) / (docs - n_hosts)
    rho = min(max(rho, 1e-4), 0.5)
    return mean, 1 / rho - 1


def judged(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Features, base_failed, failed, host_rate and kept of every document."""
    feats = features(docs).withColumn("base_failed", base_failed()).withColumn("failed", failed())
    feats = written(feats, "quality-features")
    verdicts = hosts(feats, max_rate).select(F.col("source").alias("__s"), "rate", "rejected")
    both = feats.join(verdicts, feats["source"].eqNullSafe(verdicts["__s"]), "left")
    return both.select(
        *feats.columns, F.col("rate").alias("host_rate"), (~F.col("failed") & ~F.col("rejected")).alias("kept")
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT row, i, ws[i:i + 2] AS win FROM (SELECT row, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d)),
again AS (SELECT row, win FROM wins GROUP BY row, win HAVING count(*) > 1),
cov AS (
  SELECT row, count(DISTINCT i + o) AS n FROM wins JOIN again USING (row, win), (VALUES (0), (1), (2)) AS v(o)
  GROUP BY row),
f AS (
  SELECT row, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (row)),
g AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > n_words OR 2 * n_dup_lines > n_lines
      OR word_chars > 25 * n_words OR word_chars < 2 * n_words AS failed
  FROM f),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (failed) AS fails FROM g GROUP BY source),
t AS (
  SELECT count(*) AS hosts, sum(docs) AS docs, CAST(sum(fails) AS DOUBLE) / sum(docs) AS mean,
    sum(CAST(fails AS DOUBLE) * fails / docs) AS squares
  FROM h),
p AS (
  SELECT mean, CASE WHEN hosts < 2 OR docs <= hosts OR mean = 0 OR mean = 1 THEN 1.0
    ELSE 1 / least(greatest(((squares - docs * mean * mean) / (mean * (1 - mean)) - (hosts - 1)) / (docs - hosts),
      0.0001), 0.5) - 1 END AS weight
  FROM t),
v AS (SELECT source, (fails + weight * mean) / (docs + weight) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT failed AND NOT rejected AS kept
FROM g JOIN v ON g.source IS NOT DISTINCT FROM v.source
"""
