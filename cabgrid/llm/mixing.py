"""Mixing sources to target weights by entropy balancing.

Targets.  Sources in code-point order (null last) weigh ``weights`` in
repetition and share ``budget`` times all words; a target stops at ``ceiling``
times its source's words, and the excess goes to the others by weight until
none is above.

Rates.  For every source the token constraint ``sum(size * rate) = target``
is met by the rates that stay closest, in relative entropy bounded to
(0, ceiling), to the uniform base rate ceiling / 2.  Their form is the
exponential tilt ``rate = ceiling / (1 + exp(-tilt * size / mean size))``;
the tilts maximise the concave dual, found by Newton steps.  Each step is one
Spark aggregate over (source, size, documents) - the exact histogram of the
documents, aggregated once - and joins the tilts by source; nothing per
source or document is collected.  Sums are decimal, so their order cannot
change a result.

Copies.  The rate depends on source and size only, so the documents of one
size in one source form a cell.  Every document gets ``floor(rate)`` copies;
how many of a cell get one more is rounded from the largest size to the
smallest, each cell taking over the words that the ones before missed, so a
source misses its target by about its smallest document.  Which of a cell:
those whose hashed uniform number lies below the cell's cut, found from
counts in ``STEP`` coarse bins and then in ``STEP`` fine bins of one of them.
A rerun takes the same copies.

Defined results: null text has size 0 (its copies cost nothing: its rate is
ceiling / 2); repeated rows are told apart only by what they hold, so equal
rows get equal copies; tilts that don't converge raise ``ArithmeticError``
instead of giving a mix off its targets; an empty table gives no rows; other columns are
ignored (or kept by :func:`mixed`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running, text_hash, text_of, written

WEIGHTS = (3, 1, 2)
STEP = 256
BINS = STEP * STEP
SEED = 20240613


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw): what the mix needs of a document."""
    return docs.select("doc_id", *_own())


def _own() -> list[Column]:
    draw = F.xxhash64(F.col("doc_id"), text_hash(F.col("text")), F.lit(SEED))
    return [
        F.col("source").cast("string").alias("source"),
        n_words(text_of("text")).alias("size"),
        # 52 bits of the hash, as a number in (0, 1)
        ((F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / float(1 << 52)).alias("draw"),
    ]


def targets(
    per_source: DataFrame, weights=WEIGHTS, budget: float = 1.5, ceiling: float = 2.0
) -> DataFrame:
    """``per_source(source, words)`` plus ``target``.

    Sources reach their ceiling in the order of ``words / weight``: if the
    first j do, the rest share what is left by weight.  The number of capped
    sources is the smallest j for which the next one stays below its ceiling,
    so running sums replace the repeated resharing.  One row per source; the
    numbering needs all of them in order.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (((F.col("number") - 1) % len(weights)) + 1).cast("int")
    )
    numbered = (
        per_source.withColumn("number", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("reach", F.col("words") * float(ceiling) / F.col("weight"))
    )
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = Window.orderBy("reach", "number").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    run = numbered.select(
        "*",
        (F.sum(F.col("words").cast("double")).over(every) * float(budget)).alias("all"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum(F.col("words") * float(ceiling)).over(first), zero).alias("full"),
        F.coalesce(F.sum("weight").over(first), zero).alias("full_weight"),
    )
    # the level (target over weight) if all before this source are capped
    level = (F.col("all") - F.col("full")) / (F.col("all_weight") - F.col("full_weight"))
    run = run.withColumn("level", level)
    below = F.when(F.col("reach") > F.col("level"), F.struct("reach", "number", "level"))
    share = F.min(below).over(every)["level"]
    capped = F.least(F.col("weight") * F.coalesce(share, F.lit(float("inf"))), F.col("words") * float(ceiling))
    return run.select(*per_source.columns, capped.alias("target"))


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def tilts(hist: DataFrame, goal: DataFrame, ceiling: float = 2.0, rounds: int = 60, chain: int = 4) -> DataFrame:
    """(source, words, target, mean, tilt, full) by Newton steps on the dual.

    ``hist(source, size, docs)``; ``goal(source, words, docs, target)``.  A
    step stays inside a bracket that every step tightens (the constraint is
    monotone in the tilt) and falls back to its middle, so it converges for
    any sizes.  ``full`` sources are at their ceiling and need none.
    ``chain`` steps run in one job, then the state is written.  Sources that
    are not balanced after ``rounds`` steps are an error.
    """
    limit = 60.0  # far beyond where every rate has reached its bound
    kept = ["words", "target", "mean", "full"]
    state = goal.select(
        "source",
        "words",
        "target",
        F.greatest(F.col("words") / F.col("docs"), F.lit(1e-9)).alias("mean"),
        (F.lit(ceiling) * F.col("words") <= F.col("target") * (1 + 1e-12)).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(-limit).alias("low"),
        F.lit(limit).alias("high"),
        F.lit(False).alias("close"),
    )
    state = written(state, "mix-tilts")
    for _ in range(0, rounds, chain):
        for _ in range(chain):
            state = _newton(state, hist, kept, ceiling)
        state = written(state, "mix-tilts")
        if state.filter(~F.col("close")).isEmpty():
            return state.select("source", *kept, "tilt")
    raise ArithmeticError(f"tilts did not meet their targets in {rounds} Newton steps")


def _newton(state: DataFrame, hist: DataFrame, kept: list[str], ceiling: float) -> DataFrame:
    d = "decimal(38,9)"  # decimal sums do not depend on their order
    x = F.col("size") / F.col("mean")
    p = _logistic(F.col("tilt") * x)
    got = (
        _by_source(hist, state)
        .groupBy("source")
        .agg(
            *[F.first(c).alias(c) for c in (*kept, "tilt", "low", "high", "close")],
            F.sum((F.col("docs") * F.col("size") * p * ceiling).cast(d)).cast("double").alias("got"),
            F.sum((F.col("docs") * F.col("size") * x * p * (1 - p) * ceiling).cast(d)).cast("double").alias("slope"),
        )
    )
    gap = F.col("got") - F.col("target")
    low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
    high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
    got = got.select("source", *kept, "tilt", "slope", "close", gap.alias("gap"), low.alias("low"), high.alias("high"))
    newton = F.col("tilt") - F.col("gap") / F.greatest(F.col("slope"), F.lit(1e-300))
    inside = (F.col("slope") > 1e-9) & (newton > F.col("low")) & (newton < F.col("high"))
    after = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
    close = (
        F.col("close")
        | F.col("full")
        | (F.abs("gap") <= 1e-7 * F.col("target"))
        | (F.col("high") - F.col("low") < 1e-12)
    )
    return got.select(
        "source",
        *kept,
        F.when(close, F.col("tilt")).otherwise(F.round(after, 12)).alias("tilt"),
        "low",
        "high",
        close.alias("close"),
    )


def _by_source(rows: DataFrame, plan: DataFrame, *more: str) -> DataFrame:
    """``rows`` with the columns of ``plan`` for their source (null: null)."""
    p = plan.withColumnsRenamed({"source": "__s", **{m: f"__{m}" for m in more}})
    on = rows["source"].eqNullSafe(p["__s"])
    for m in more:
        on = on & (rows[m] == p[f"__{m}"])
    return rows.join(p, on).drop("__s", *[f"__{m}" for m in more])


def cells(hist: DataFrame, plan: DataFrame, ceiling: float = 2.0) -> DataFrame:
    """(source, size, docs, words, target, rate, base, extra): how many of the
    documents of one size get one copy more than ``base``.

    A source's cells (one per size, so at most as many as its longest text
    has words) are rounded in one array, from the largest size down.
    """
    tilted = _logistic(F.col("tilt") * F.col("size") / F.col("mean")) * ceiling
    rate = F.when(F.col("full"), F.lit(float(ceiling))).otherwise(F.least(tilted, F.lit(float(ceiling))))
    rated = _by_source(hist, plan).withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    cell = F.struct("size", "docs", "rate", "base")

    def add(owed, c):
        owed = owed + c["docs"] * c["size"] * (c["rate"] - c["base"])
        fits = F.greatest(F.least(F.round(owed / F.greatest(c["size"], F.lit(1))).cast("long"), c["docs"]), F.lit(0))
        extra = F.when((c["size"] > 0) & (c["base"] < ceiling), fits).otherwise(F.lit(0)).cast("long")
        row = F.struct(
            c["size"].alias("size"), c["docs"].alias("docs"), c["rate"].alias("rate"), c["base"].alias("base"),
            extra.alias("extra"),
        )
        return owed - extra * c["size"], row

    row_type = "struct<size:bigint,docs:bigint,rate:double,base:bigint,extra:bigint>"
    by_source = rated.groupBy("source").agg(
        F.first("words").alias("words"),
        F.first("target").alias("target"),
        F.sort_array(F.collect_list(cell), asc=False).alias("cells"),
    )
    return by_source.select(
        "source", "words", "target", F.inline(running(F.col("cells"), F.lit(0.0), add, row_type))
    )


def _bin() -> Column:
    return F.floor(F.col("draw") * BINS).cast("int")


def plan_mix(rows: DataFrame, weights=WEIGHTS, budget: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, size, words, target, rate, base, cut) for the rows of
    :func:`sizes`: a document gets ``base`` copies, and one more if its bin
    lies below ``cut``."""
    hist = written(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-histogram")
    per_source = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("docs")).alias("words"), F.sum("docs").alias("docs")
    )
    goal = targets(written(per_source, "mix-sources"), weights, budget, ceiling)
    found = written(cells(hist, tilts(hist, goal, ceiling), ceiling), "mix-cells")

    some = found.filter((F.col("extra") > 0) & (F.col("extra") < F.col("docs"))).select("source", "size", "extra")
    drawn = _by_source(rows, some, "size").select("source", "size", "extra", _bin().alias("bin"))
    run = Window.partitionBy("source", "size").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # a cell has at most STEP coarse bins, and a coarse bin at most STEP fine ones
    coarse = drawn.groupBy("source", "size", "extra", F.floor(F.col("bin") / STEP).alias("at")).count()
    coarse = coarse.withColumn("upto", F.sum("count").over(run)).filter("upto >= extra")
    edge = F.min(F.struct("at", (F.col("extra") - F.col("upto") + F.col("count")).alias("need"))).alias("edge")
    edge = coarse.groupBy("source", "size").agg(edge).select("source", "size", "edge.at", "edge.need")
    near = _by_source(drawn, written(edge, "mix-edges"), "size").filter(F.floor(F.col("bin") / STEP) == F.col("at"))
    fine = near.groupBy("source", "size", "need", F.col("bin").alias("at")).count()
    fine = fine.withColumn("upto", F.sum("count").over(run))
    # the cut before or after a bin, whichever comes nearest to the number wanted
    after = F.struct(F.abs(F.col("upto") - F.col("need")).alias("off"), (F.col("at") + 1).alias("cut"))
    before = F.struct(F.abs(F.col("upto") - F.col("count") - F.col("need")).alias("off"), F.col("at").alias("cut"))
    best = F.min(F.least(after, before))["cut"].alias("cut")
    cut = written(fine.groupBy("source", "size").agg(best), "mix-cuts")
    cut = cut.withColumnsRenamed({"source": "__s", "size": "__size"})
    whole = F.when(F.col("extra") == 0, 0).when(F.col("extra") == F.col("docs"), BINS).otherwise(F.col("cut"))
    out = found.join(cut, found["source"].eqNullSafe(cut["__s"]) & (found["size"] == cut["__size"]), "left")
    return written(
        out.select("source", "size", "words", "target", "rate", "base", whole.alias("cut")), "mix-plan"
    )


def _copies() -> Column:
    return F.col("base") + F.when(_bin() < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) a row."""
    rows = written(sizes(docs), "mix-sizes")
    plan = plan_mix(rows, weights, budget, ceiling)
    out = _by_source(rows, plan, "size")
    return out.select(
        "doc_id",
        "source",
        "size",
        F.col("words").alias("source_size"),
        "target",
        "rate",
        _copies().alias("copies"),
        (_copies() * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, columns unchanged."""
    rows = written(sizes(docs), "mix-sizes")
    plan = plan_mix(rows, weights, budget, ceiling)
    packed = docs.select(F.struct("*").alias("__row"), *_own())
    out = _by_source(packed, plan, "size")
    times = F.array_repeat(F.lit(1), _copies().cast("int"))
    return out.select("__row", F.explode(times)).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")
