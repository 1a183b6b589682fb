"""Helpers shared by the training-data operators.

Row keys: a table may hold the same ``doc_id`` twice, with different texts or
as an exact repeat.  Results that are joined back to the rows they describe
use :func:`row_key` (doc_id and a hash of the text): rows with equal keys are
equal to every operator here, so one result serves them all and no join
multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_table_path

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = "[ \\t-\\r]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts lineage (a lost executor only costs the tasks that read its part)
    and gives the planner a real size, so that it broadcasts only what its
    own threshold allows.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order (empty text: no word)."""
    return F.filter(F.split(text, SPACES), lambda w: w != F.lit(""))


def n_pieces(text: Column, gap: str) -> Column:
    """Number of non-empty pieces between runs of the character class ``gap``."""
    n = F.size(F.split(text, gap + "+"))
    lead = text.rlike("\\A" + gap).cast("int")
    trail = text.rlike(gap + "\\z").cast("int")
    return F.when(text.rlike("[^" + gap[1:]), n - lead - trail).otherwise(F.lit(0)).cast("long")


def n_words(text: Column) -> Column:
    """Number of words, without keeping them."""
    return n_pieces(text, SPACES[:-1])


def text_hash(text: Column) -> Column:
    """64-bit hash of a text; null stays apart from empty."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def null_safe(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Equality of several columns where null equals null."""
    cond = None
    for a, b in pairs.items():
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def left_lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys of equal names where null equals null; the right keys go.

    The right side describes rows of the corpus and grows with it, so it is
    never broadcast: a sort-merge join, whose hot keys adaptive execution
    splits, at every size.
    """
    names = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(names).hint("merge")
    return left.join(r, null_safe(left, r, names), how).drop(*names.values())



def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A higher-order function's lambda may use a column many times per element;
    binding it as a lambda variable keeps the optimizer from copying its
    expression into the lambda, where it would run once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(n: Column) -> Column:
    """0, 1, ... n - 1 (empty for n <= 0)."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def running(items: Column, state: Column, step, row_type: str, chunk: int = 256) -> Column:
    """One row per item, in order, where ``step(state, item)`` gives the next
    state and the item's row.

    Appending to an array copies it, so rows are gathered in chunks: the cost
    is about ``chunk`` copies an item, not one per item before it.
    """
    none = F.array().cast(f"array<{row_type}>")

    def one(s, x):
        after, row = step(s["state"], x)
        return F.struct(after.alias("state"), F.concat(s["rows"], F.array(row)).alias("rows"))

    def many(s, part):
        done = F.aggregate(part, F.struct(s["state"].alias("state"), none.alias("rows")), one)
        return let(
            done,
            lambda r: F.struct(r["state"].alias("state"), F.concat(s["rows"], F.array(r["rows"])).alias("rows")),
        )

    parts = F.transform(
        positions(F.ceil(F.size(items) / chunk).cast("int")), lambda c: F.slice(items, c * chunk + 1, chunk)
    )
    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{row_type}>>").alias("rows"))
    return F.aggregate(parts, start, many, lambda s: F.flatten(s["rows"]))


def unpacked(df: DataFrame, row: str, made: list[str]) -> DataFrame:
    """The fields of struct ``row`` and the columns ``made``; a field whose
    name one of ``made`` has gives way."""
    taken = {m.lower() for m in made}
    fields = [f.name for f in df.schema[row].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col(row).getField(f).alias(f) for f in fields], *made)
