"""Writing results: ranked indexes, stand files, previews.

All writes go through Spark's commit protocol (``df.write``), so a retried
or lost task never leaves partial output behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _items(index: DataFrame):
    items = [c for c in index.columns if c not in ("weekday", "hour")]
    if len(items) != 1:
        raise ValueError("a text index needs exactly one item column")
    col = F.col(items[0])
    if not dict(index.dtypes)[items[0]].startswith("array"):
        col = F.split(col, ",")
    return col


def write_index(index: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Store a ranked index (one row per weekday/hour).

    * ``fmt="text"``: ``weekday<TAB>hour<TAB>items``, items comma-joined in
      rank order;
    * ``fmt="pairs"``: the key/list pair form of the original result files,
      ``(('monday', '08'), ['150.160-153.164', ...])``;
    * any other value is a Spark data source (``parquet``, ``json``, ...).

    An index holds at most one row per weekday and hour (168 rows), so it is
    written as one file.  ``repartition(1)`` moves just those rows; the
    narrow ``coalesce(1)`` would pull the whole ranking stage into one task.
    """
    index = index.repartition(1)
    if fmt == "text":
        line = F.concat_ws("\t", "weekday", "hour", F.array_join(_items(index), ","))
    elif fmt == "pairs":
        quoted = F.transform(_items(index), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
        line = F.concat(
            F.lit("(('"), F.col("weekday"), F.lit("', '"), F.col("hour"), F.lit("'), ["),
            F.array_join(quoted, ", "), F.lit("])"),
        )
    else:
        index.write.mode(mode).format(fmt).save(path)
        return
    index.select(line.alias("value")).write.mode(mode).text(path)


def write_stand_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per k (``k=5/``, ...) with ``lat,lon`` lines in stand order.

    The frame holds at most sum(ks) rows, so a single writer task is enough
    (``repartition(1)``, so whatever computed the lines stays parallel).
    """
    (
        lines.repartition(1)
        .sortWithinPartitions("k", "stand_id")
        .select("k", "line")
        .write.mode(mode)
        .partitionBy("k")
        .text(path)
    )


def preview(df: DataFrame, order_cols: Sequence, n: int) -> DataFrame:
    """The first n rows in a total order (Spark plans a top-n, not a full sort)."""
    return df.orderBy(*order_cols).limit(n)
