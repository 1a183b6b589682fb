"""Connected components of a link table, as Spark joins and aggregates.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every step replaces a node's links by
links to its smallest neighbour, so the link count never grows beyond the
input's and a star with very many leaves stays a star.  Each step takes the
smallest neighbour by a combining aggregate, writes it and joins it back, so
that adaptive execution can split a node that holds very many links.  Each
round's links are written to the shared folder; only two numbers per round
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """``links`` point from the larger node ``a`` to the smaller ``b``."""
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``.

    ``component`` is the smallest node reachable.  Self links and repeats
    are allowed; no links give an empty table.
    """
    both = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now = written(links.filter("a <> b").select(*both).distinct(), "links")
    sign = None
    for _ in range(max_rounds):
        now = written(_small(_large(now)), "links")
        n, s = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, s) == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        sign = (n, s)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
