"""Top-n rows per group and the ordered index built from them.

``row_number() <= n`` over a window is planned by Spark as a partial
``WindowGroupLimit`` before the exchange and a final one after it, so each
map task ships at most ``n`` rows per group.  A group that holds a large
share of the input therefore never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence,
    n: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Rows ranked 1..n within each group by ``order_cols``.

    ``order_cols`` must give a total order (end with a unique tie-breaker)
    so the cut is the same on every run and partition layout.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def ranked_index(
    ranked: DataFrame,
    group_cols: Sequence[str],
    item_col: str,
    out_col: str,
    rank_col: str = "rank",
    sep: str | None = None,
) -> DataFrame:
    """One row per group with its items in rank order.

    ``ranked`` must come from :func:`top_n_per_group`, so each list holds at
    most n items.  With ``sep`` the list is joined into one string.
    """
    items = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(rank_col), F.col(item_col)))),
        lambda x: x[item_col],
    )
    if sep is not None:
        items = F.array_join(items, sep)
    return ranked.groupBy(*group_cols).agg(items.alias(out_col))
