"""Line dedup with content-defined chunks of lines.

A text is split at ``\\n``; every line is hashed, and a rolling hash over the
last ``span`` line hashes ends a chunk where it is divisible by ``divisor``.
The edges depend on nearby lines only, so an inserted or deleted line moves
the chunk it falls into and leaves the others alike.  Chunks with ``min_lines``
lines that hold a word are compared over all documents:

1. chunk hashes are counted (numbers only);
2. chunks whose hash stands twice or more are read again with their bytes and
   grouped by the bytes themselves, so a hash collision removes nothing;
3. of equal chunks the first stays (smallest doc_id, text hash, line number),
   the others go;
4. chunks that differ at an edge only, and short ones, hold repeats too: each
   run of ``min_lines`` worded lines that is not wholly in a chunk that goes is
   counted, read again and grouped by its bytes in the same way.

Steps 1 to 3 alone are :func:`deduplicated`, all of them
:func:`without_repeats`.  There a worded line goes if and only if it lies in a
run of ``min_lines`` neighbouring worded lines (blank lines between them do
not matter) that also stands at an earlier place, wherever the chunk edges
fall.  A blank line goes where the nearest worded line on each side goes or is
missing, so that a copied text goes whole.

All grouping combines before the shuffle, and joins with the corpus are
sort-merge joins of written tables, which adaptive execution splits where one
chunk stands in very many documents.

Defined results: null or empty text is one empty line and stays; blank lines
are lines, but chunks need ``min_lines`` lines with a word, and a text of blank
lines stays; a chunk or run repeated inside one text loses its later copies; rows with one doc_id and one text are
one document (equal results); null doc_ids come first; an empty table gives
no rows; extra columns are ignored (or kept by :func:`deduplicated`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import left_lookup, let, positions, text_hash, text_of, unpacked, written

KEY = ["doc_id", "text_hash"]
SPAN, DIVISOR, MIN_LINES = 2, 4, 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(line: Column) -> Column:
    return line.rlike("[^ \\t-\\r]")


def _edges(lines: Column, span: int, divisor: int) -> Column:
    """array<struct<at, n>>: the chunks' first lines and line counts."""

    def rolled(h, i):
        return F.xxhash64(*[F.get(h, i - j) for j in range(span)])

    def starts(h):
        return F.filter(
            positions(F.size(h)), lambda i: (i == 0) | ((i >= span) & (F.pmod(rolled(h, i - 1), F.lit(divisor)) == 0))
        )

    def chunks(h):
        return let(
            starts(h),
            lambda s: F.transform(
                s, lambda p, j: F.struct(p.alias("at"), (F.coalesce(F.get(s, j + 1), F.size(h)) - p).alias("n"))
            ),
        )

    return let(F.transform(lines, lambda x: F.xxhash64(x)), chunks)


def _text_of_chunk(lines: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, at + 1, n), "\n")


def chunks(docs: DataFrame, span: int = SPAN, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text_hash, at, n, hash) of the chunks that may go."""

    def made(lines):
        wordy = F.transform(lines, _worded)
        return let(
            wordy,
            lambda w: F.transform(
                F.filter(
                    _edges(lines, span, divisor),
                    lambda c: (c["n"] >= min_lines)
                    & (F.size(F.filter(F.slice(w, c["at"] + 1, c["n"]), lambda x: x)) >= min_lines),
                ),
                lambda c: F.struct(
                    c["at"].alias("at"),
                    c["n"].alias("n"),
                    F.xxhash64(_text_of_chunk(lines, c["at"], c["n"])).alias("hash"),
                ),
            ),
        )

    return docs.select(
        "doc_id", text_hash(F.col("text")).alias("text_hash"), F.inline(let(_lines(text_of("text")), made))
    )


def repeated(docs: DataFrame, span: int = SPAN, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text_hash, gone array<struct<at, n>>): the chunks that go."""
    found = written(chunks(docs, span, divisor, min_lines).distinct(), "line-chunks")
    again = written(
        found.groupBy("hash", "n").agg(F.count("*").alias("c")).filter("c > 1").select("hash", "n"), "chunk-hashes"
    )
    suspects = found.join(again.hint("merge"), ["hash", "n"], "left_semi")
    todo = suspects.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n", "hash")).alias("todo"))
    todo = written(todo, "chunk-work")

    def read(lines, items):
        return F.transform(
            items,
            lambda c: F.struct(
                c["at"].alias("at"),
                c["n"].alias("n"),
                c["hash"].alias("hash"),
                _text_of_chunk(lines, c["at"], c["n"]).alias("bytes"),
            ),
        )

    later = _later(docs, todo, read, "chunk")
    return written(
        later.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("gone")), "chunks-gone"
    )


def _later(docs: DataFrame, todo: DataFrame, read, name: str) -> DataFrame:
    """The items of ``todo`` whose bytes also stand at an earlier place;
    ``read(lines, items)`` gives their fields, at, hash and bytes."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    both = left_lookup(rows, todo, KEY, "inner").select(*KEY, "todo", _lines(text_of("text")).alias("lines"))
    copies = both.select(*KEY, F.inline(read(F.col("lines"), F.col("todo"))))
    copies = written(copies, f"{name}-bytes")
    first = F.min(F.struct(*KEY, "at")).alias("first")
    kinds = copies.groupBy("hash", "bytes").agg(F.count("*").alias("c"), first).filter("c > 1").drop("c")
    kinds = written(kinds, f"{name}-kinds")
    k = kinds.withColumnsRenamed({"hash": "__h", "bytes": "__b"}).hint("merge")
    same = copies.join(k, (copies["hash"] == k["__h"]) & (copies["bytes"] == k["__b"]))
    return same.filter(~F.struct(*KEY, "at").eqNullSafe(F.col("first")))


def _places(lines: Column) -> Column:
    """The numbers of the worded lines."""
    return F.filter(positions(F.size(lines)), lambda i: _worded(F.get(lines, i)))


def _text_of_run(lines: Column, places: Column, first: Column, min_lines: int) -> Column:
    return F.concat_ws("\n", *[F.get(lines, F.get(places, first + d)) for d in range(min_lines)])


def runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text_hash, first, at, till, hash) of all runs of ``min_lines``
    worded lines: number of the first among the worded lines, line numbers of
    the first and the last."""

    def made(lines):
        return let(
            _places(lines),
            lambda w: F.transform(
                positions(F.size(w) - (min_lines - 1)),
                lambda j: F.struct(
                    j.alias("first"),
                    F.get(w, j).alias("at"),
                    F.get(w, j + (min_lines - 1)).alias("till"),
                    F.xxhash64(_text_of_run(lines, w, j, min_lines)).alias("hash"),
                ),
            ),
        )

    return docs.select(
        "doc_id", text_hash(F.col("text")).alias("text_hash"), F.inline(let(_lines(text_of("text")), made))
    )


def _owners(gone: Column) -> Column:
    """The first line of the chunk that goes with each line, else -1; up to
    the last such chunk."""
    begin = F.concat(F.array(F.lit(0)), F.transform(gone, lambda c: c["at"] + c["n"]))
    return F.flatten(
        F.zip_with(
            F.slice(begin, 1, F.size(gone)),
            gone,
            lambda a, c: F.concat(F.array_repeat(F.lit(-1), c["at"] - a), F.array_repeat(c["at"], c["n"])),
        )
    )


def _flags(numbers: Column) -> Column:
    """True at each of the sorted ``numbers``, up to the last."""
    begin = F.concat(F.array(F.lit(0)), F.transform(numbers, lambda i: i + 1))
    return F.flatten(
        F.zip_with(
            F.slice(begin, 1, F.size(numbers)),
            numbers,
            lambda a, i: F.concat(F.array_repeat(F.lit(False), i - a), F.array(F.lit(True))),
        )
    )


def repeated_runs(docs: DataFrame, gone: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text_hash, runs array<int>): the first worded lines' numbers of
    the runs that go and are not wholly in a chunk of ``gone``."""
    found = written(runs(docs, min_lines), "line-runs")
    again = written(found.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1").select("hash"), "run-hashes")
    suspects = found.join(again.hint("merge"), "hash", "left_semi")
    item = F.struct("first", "at", "till", "hash")
    todo = suspects.groupBy(*KEY).agg(F.collect_set(item).alias("todo"))

    def open_runs(owner):
        inside = lambda r: (F.get(owner, r["at"]) >= 0) & (F.get(owner, r["at"]) == F.get(owner, r["till"]))
        return F.filter("todo", lambda r: ~F.coalesce(inside(r), F.lit(False)))

    todo = left_lookup(todo, gone, KEY).select(*KEY, let(_owners(F.col("gone")), open_runs).alias("todo"))
    todo = written(todo.filter(F.size("todo") > 0), "run-work")

    def read(lines, items):
        return let(
            _places(lines),
            lambda w: F.transform(
                items,
                lambda r: F.struct(
                    r["first"].alias("at"),
                    r["hash"].alias("hash"),
                    _text_of_run(lines, w, r["first"], min_lines).alias("bytes"),
                ),
            ),
        )

    later = _later(docs, todo, read, "run")
    return written(later.groupBy(*KEY).agg(F.sort_array(F.collect_set("at")).alias("runs")), "runs-gone")


def _left(lines: Column, gone: Column) -> Column:
    """The lines outside the sorted, disjoint ``gone`` chunks."""
    after = F.transform(gone, lambda c: c["at"] + c["n"])
    begin = F.concat(F.array(F.lit(0)), after)
    end = F.concat(F.transform(gone, lambda c: c["at"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(lines, a + 1, b - a)))


def deduplicated(docs: DataFrame, keep=("*",), **how) -> DataFrame:
    """``keep`` columns of ``docs`` plus n_lines, n_removed and kept (the text
    without the lines that go; null text: empty)."""
    gone = repeated(docs, **how)
    rows = docs.select(
        F.struct(*keep).alias("__row"), F.col("doc_id"), text_hash(F.col("text")).alias("text_hash"),
        F.col("text").alias("__text"),
    )
    both = left_lookup(rows, gone, KEY).select("__row", "gone", "__text")

    def made(lines):
        out = F.when(F.col("gone").isNull(), lines).otherwise(_left(lines, F.col("gone")))
        lost = F.coalesce(F.aggregate("gone", F.lit(0), lambda s, c: s + c["n"]), F.lit(0))
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            lost.cast("long").alias("n_removed"),
            F.array_join(out, "\n").alias("kept"),
        )

    out = both.select("__row", let(_lines(text_of("__text")), made).alias("__made")).select("__row", "__made.*")
    return unpacked(out, "__row", ["n_lines", "n_removed", "kept"])


def _outside(lines: Column, gone: Column, later: Column, min_lines: int) -> Column:
    """The lines that stay where the chunks ``gone`` and the runs ``later`` go."""
    yes, no = F.lit(True), F.lit(False)
    none = F.array().cast("array<string>")

    def worded_gone(w):  # by number among the worded lines
        def one(started, owner):
            in_run = lambda m: [F.coalesce(F.get(started, m - d), no) for d in range(min_lines)]
            in_chunk = lambda m: F.coalesce(F.get(owner, F.get(w, m)) >= 0, no)
            return F.transform(positions(F.size(w)), lambda m: F.greatest(in_chunk(m), *in_run(m)))

        return let(_flags(later), lambda started: let(_owners(gone), lambda owner: one(started, owner)))

    def kept(w, g):
        def step(m):  # the blank lines before worded line m, and that line
            before, here = F.coalesce(F.get(w, m - 1), F.lit(-1)), F.coalesce(F.get(w, m), F.size(lines))
            lonely = F.coalesce(F.get(g, m - 1), yes) & F.coalesce(F.get(g, m), yes)
            blank = F.when(lonely, none).otherwise(F.slice(lines, before + 2, here - before - 1))
            return F.concat(blank, F.when(F.coalesce(F.get(g, m), yes), none).otherwise(F.slice(lines, here + 1, 1)))

        return F.when(F.size(w) == 0, lines).otherwise(F.flatten(F.transform(positions(F.size(w) + 1), step)))

    return let(_places(lines), lambda w: let(worded_gone(w), lambda g: kept(w, g)))


def without_repeats(
    docs: DataFrame, keep=("*",), span: int = SPAN, divisor: int = DIVISOR, min_lines: int = MIN_LINES
) -> DataFrame:
    """As :func:`deduplicated`, without any later copy of ``min_lines`` or
    more neighbouring worded lines."""
    gone = repeated(docs, span, divisor, min_lines)
    later = repeated_runs(docs, gone, min_lines)
    both = gone.withColumn("runs", F.lit(None).cast("array<int>")).unionByName(
        later.withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    )
    work = both.groupBy(*KEY).agg(F.first("gone", True).alias("gone"), F.first("runs", True).alias("runs"))
    rows = docs.select(
        F.struct(*keep).alias("__row"), F.col("doc_id"), text_hash(F.col("text")).alias("text_hash"),
        F.col("text").alias("__text"),
    )
    both = left_lookup(rows, written(work, "lines-gone"), KEY).select("__row", "gone", "runs", "__text")

    def made(lines):
        untouched = F.col("gone").isNull() & F.col("runs").isNull()
        out = F.when(untouched, lines).otherwise(_outside(lines, F.col("gone"), F.col("runs"), min_lines))
        return let(
            out,
            lambda left: F.struct(
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(left)).cast("long").alias("n_removed"),
                F.array_join(left, "\n").alias("kept"),
            ),
        )

    out = both.select("__row", let(_lines(text_of("__text")), made).alias("__made")).select("__row", "__made.*")
    return unpacked(out, "__row", ["n_lines", "n_removed", "kept"])


def _digest(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.char_length("kept").cast("long").alias("kept_chars"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_sha256 of the chunks alone."""
    return _digest(deduplicated(docs, keep=("doc_id",)))


def whole_digest(docs: DataFrame) -> DataFrame:
    """The same columns, of chunks and runs."""
    return _digest(without_repeats(docs, keep=("doc_id",)))


#: The rule of :func:`whole_digest`.  Texts with one doc_id are put in order by
#: the text itself where the library uses its hash: the same on unlike ids.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
runs AS (SELECT *, lead(i) OVER own AS till, lead(line) OVER own AS after, row_number() OVER own AS m
         FROM w WINDOW own AS (PARTITION BY r ORDER BY i)),
later AS (SELECT r, i, till FROM (
            SELECT r, i, till, rank() OVER (PARTITION BY line, after ORDER BY doc_id NULLS FIRST, text, m) AS place
            FROM runs WHERE till IS NOT NULL) WHERE place > 1),
gone AS (SELECT r, i FROM later UNION SELECT r, till FROM later),
told AS (SELECT l.r, l.i, l.line, CASE WHEN w.i IS NOT NULL THEN gone.i IS NOT NULL END AS worded_gone
         FROM l LEFT JOIN w ON w.r = l.r AND w.i = l.i LEFT JOIN gone ON gone.r = l.r AND gone.i = l.i),
near AS (SELECT *, max(worded_gone) OVER (PARTITION BY r) AS any_word,
           last_value(worded_gone IGNORE NULLS) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
           first_value(worded_gone IGNORE NULLS) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
         FROM told),
cut AS (SELECT r, i, line, any_word IS NOT NULL AND coalesce(before, true) AND coalesce(behind, true) AS goes FROM near),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '') AS kept FROM cut GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
  CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256
FROM d JOIN kept USING (r)
"""
