"""Uniform shuffle into shards of exact sizes, with DataFrame functions only.

Law ``rows``: shard sizes differ by one row at most, and every assignment of
rows to shards with these sizes is equally likely, up to the quality of the
hashed numbers.

1. *Local permutation.*  Rows are sorted inside their partition by a hash;
   the running number in the sorted partition is a row's local rank.  No
   exchange.
2. *Communication matrix.*  How many rows of partition p go to shard s is
   drawn without looking at rows: the matrix with row sums n_p and column
   sums N_s that a uniform shuffle would show.  The partitions are halved
   again and again; each half's share of every shard is a hypergeometric
   draw from what its parent has, so halves are independent of each other
   and the draws run as a Spark plan of log2(partitions) steps; every
   ``SPREAD`` steps the halves are written and spread over tasks.  A draw
   inverts the distribution's running sums within ten standard deviations
   of its mean (the rest weighs less than double precision).
3. *Exchange.*  Partition p sends its first rows by local rank to shard 0,
   the next to shard 1, and so on, as many as its matrix row says.
4. *Second permutation.*  Slots in a shard follow a second hash.  Its high
   bits cut the shard into buckets of about ``bucket_rows`` rows; bucket
   counts give every bucket its first slot, so no task sorts a whole shard.

The narrow rows (or, in :func:`sharded`, whole rows) are written once after
step 1, so local ranks and partition numbers are fixed facts, whatever
executors are lost later.  Equal texts are not kept together: a uniform
shuffle must not, and a group may be larger than a shard.

Defined results: null text has size 8 and CRC 0; repeated rows are separate
rows; fewer rows than shards leave some shards empty; an empty table gives no
rows; extra columns are ignored (or kept by :func:`sharded`).
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, positions, text_of, unpacked, written

SEED = 8
SPREAD = 6  # halvings in a job; after them 2^6, 2^12, ... halves go on side by side
SPREAD_TASKS = 512
RANK_BITS = 33  # of monotonically_increasing_id: the number inside the partition
ARRAY = "array<bigint>"


def _local_ranks(rows: DataFrame, seed: int, *by: Column) -> DataFrame:
    """``rows`` plus __part and __rank: a hashed order inside each partition."""
    keyed = rows.withColumn("__part", F.spark_partition_id()).withColumn("__by", F.xxhash64(*by, F.lit(seed)))
    ordered = keyed.sortWithinPartitions("__by")
    rank = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << RANK_BITS) - 1))
    return ordered.withColumn("__rank", rank).drop("__by")


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def _hypergeometric(good: Column, total: Column, take: Column, u: Column) -> Column:
    """Number of ``good`` among ``take`` drawn from ``total``; ``u`` in (0, 1)."""
    g, n, k = (c.cast("double") for c in (good, total, take))
    mean = F.when(n > 0, k * g / n).otherwise(0.0)
    var = F.when(n > 1, mean * (1 - g / n) * (n - k) / (n - 1)).otherwise(0.0)
    reach = 10 * F.sqrt(F.greatest(var, F.lit(0.0))) + 10
    low = F.greatest(F.lit(0.0), k + g - n, F.floor(mean - reach)).cast("long")
    high = F.least(g, k, F.ceil(mean + reach)).cast("long")

    def ratio(x):  # P(x + 1) / P(x)
        x = x.cast("double")
        return (g - x) * (k - x) / ((x + 1) * (n - g - k + x + 1))

    def walk(lo):
        """Running sums of weights from ``lo`` on, the first weight being 1."""
        span = F.sequence(lo, F.greatest(high, lo))

        def add(s, x):
            weight = s["w"] * F.greatest(ratio(x), F.lit(0.0))
            return (s["sum"] + s["w"]).alias("sum"), weight.alias("w")

        start = F.lit(0.0).alias("sum"), F.lit(1.0).alias("w")
        whole = F.aggregate(span, F.struct(*start), lambda s, x: F.struct(*add(s, x)), lambda s: s["sum"])

        def pick(goal):  # as many steps as there are sums below the goal
            def step(s, x):
                at = s["at"] + F.when(s["sum"] + s["w"] < goal, 1).otherwise(0)
                return F.struct(*add(s, x), at.alias("at"))

            return F.aggregate(span, F.struct(*start, lo.alias("at")), step, lambda s: s["at"])

        return let(whole * u, pick)

    return F.when(high <= low, low).otherwise(let(low, walk))


def communication_matrix(counts: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(__part, cells): how many rows each partition sends to each shard.

    ``counts(__part, n)``, a row per partition.  The first steps hold all
    partitions' counts in one row (some bytes a partition) and draw for at
    most 2^``SPREAD`` halves in one task; every step halves the row and
    doubles the rows, and all further draws run in parallel.
    """
    one = counts.agg(F.sort_array(F.collect_list(F.struct("__part", "n"))).alias("parts"))
    parts = counts.count()
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    quota = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: (F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0)).cast("long"),
    )
    nodes = (
        one.filter(F.size("parts") > 0)
        .withColumn("total", total)
        .select("parts", quota.alias("cells"), F.lit(1).cast("long").alias("node"))
    )
    for step in range(ceil(log2(parts)) if parts > 1 else 0):
        if step and step % SPREAD == 0:
            nodes = written(nodes.repartition(min(1 << step, SPREAD_TASKS), "node"), "shard-halves")
        half = F.ceil(F.size("parts") / 2).cast("int")
        sides = nodes.select(
            "node",
            "cells",
            F.slice("parts", F.lit(1), half).alias("left"),
            F.slice("parts", half + 1, F.greatest(F.size("parts") - half, F.lit(0))).alias("right"),
        )
        take = F.aggregate("left", F.lit(0).cast("long"), lambda s, p: s + p["n"])
        rest = F.aggregate("right", F.lit(0).cast("long"), lambda s, p: s + p["n"])
        start = F.struct(
            F.col("take").alias("take"),
            (F.col("take") + F.col("rest")).alias("total"),
            F.array().cast(ARRAY).alias("got"),
        )

        def draw(s, i):
            good = F.get(F.col("cells"), i)
            x = _hypergeometric(good, s["total"], s["take"], _uniform(F.col("node"), i, F.lit(seed)))
            return let(
                x,
                lambda v: F.struct(
                    (s["take"] - v).alias("take"),
                    (s["total"] - good).alias("total"),
                    F.concat(s["got"], F.array(v)).alias("got"),
                ),
            )

        drawn = sides.withColumn("take", take).withColumn("rest", rest).withColumn(
            "mine", F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, draw, lambda s: s["got"])
        )
        both = F.array(
            F.struct(F.col("left").alias("parts"), F.col("mine").alias("cells"), (F.col("node") * 2).alias("node")),
            F.struct(
                F.col("right").alias("parts"),
                F.zip_with("cells", "mine", lambda c, m: c - m).alias("cells"),
                (F.col("node") * 2 + 1).alias("node"),
            ),
        )
        nodes = drawn.select(F.inline(both)).filter(F.size("parts") > 0)
    return nodes.select(F.element_at("parts", 1)["__part"].alias("__part"), "cells")


def assign(rows: DataFrame, shards: int, seed: int = SEED, bucket_rows: int = 5_000) -> DataFrame:
    """``rows`` (written, with __part and __rank) plus shard and slot."""
    counts = written(rows.groupBy("__part").agg(F.count("*").alias("n")), "shard-counts")
    matrix = communication_matrix(counts, shards, seed)
    ends = F.transform(
        positions(F.lit(shards)),
        lambda i: F.aggregate(F.slice("cells", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, c: s + c),
    )
    matrix = written(matrix.select("__part", ends.alias("ends")), "shard-matrix")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("__rank")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, ceil(total / shards / bucket_rows))
    second = F.shiftrightunsigned(F.xxhash64("__part", "__rank", F.lit(seed + 1)), 1)
    sent = rows.join(matrix, "__part").withColumn("shard", shard).drop("ends")
    sent = sent.withColumn("__second", second).withColumn("__bucket", F.pmod("__second", F.lit(buckets)))
    per_bucket = sent.groupBy("shard", "__bucket").count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = written(
        per_bucket.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first")),
        "shard-buckets",
    )
    within = Window.partitionBy("shard", "__bucket").orderBy("__second", "__part", "__rank")
    placed = sent.withColumn("__n", F.row_number().over(within) - 1).join(first, ["shard", "__bucket"])
    return placed.withColumn("slot", (F.col("__first") + F.col("__n")).cast("long")).drop(
        "__n", "__first", "__second", "__bucket", "__part", "__rank"
    )


def sharded(docs: DataFrame, shards: int = 24, seed: int = SEED, bucket_rows: int = 5_000) -> DataFrame:
    """Whole rows with ``shard`` and ``slot`` (columns of these names in
    ``docs`` are replaced)."""
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    ranked = _local_ranks(packed, seed, F.col("__id"), F.col("__text")).drop("__id", "__text")
    out = assign(written(ranked, "shard-rows"), shards, seed, bucket_rows)
    return unpacked(out, "__row", ["shard", "slot"])


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract's columns."""
    text = text_of("text").cast("binary")
    narrow = docs.select(
        "doc_id", (F.octet_length(text_of("text")) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    ranked = _local_ranks(narrow, SEED, F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    out = assign(written(ranked, "shard-rows"), shards)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
