"""Language identification with language-bitmask n-gram filters.

Learning: letters of each labelled text, lower-cased, with one blank between
runs, give character n-grams of the orders ``ORDERS``.  An n-gram belongs to
a language if it occurs there at least ``min_count`` times, at a rate of at
least ``min_rate``, and at ``min_share`` of its highest rate in any language
or more.  All languages share one Bloom filter whose slots hold a bit per
language (bit-sliced): the AND of an n-gram's two slots names every language
that contains it.

Prediction: per-language popcounts over all n-grams of the whole text, as
shares, corrected for the false positives that the filter's fill of that
language's slice lets through: ``(share - f) / (1 - f)`` with ``f`` the fill
to the power of the number of probes.  The largest wins (ties: the first
language in code-point order); it is the score.

Bounds: the model learns from about ``sample_docs`` labelled documents per
language, chosen by a hash of the doc_id (a documented bound, all of them
where there are fewer).  A filter has ``2**slot_bits`` slots of a bit per
language, whatever the corpus, and that is what is collected and broadcast.
Any number of languages may be learned: each ``group`` of them (512: 64 MB)
has a filter of its own, loaded, broadcast and asked in turn, and a text's
best language so far is written between two groups.  A language's slice and
its correction depend on no other language's, so the answer is that of one
filter for all; only the table of languages (a row each) is put in order as a
whole.  Texts are read in slabs
of ``SLAB`` characters, so the arrays do not grow with a text.

Defined results: null text or a text without a letter: ``und``, score 0; a
text whose n-grams no language has: the first language, score 0; without
anything learned: ``und`` everywhere; repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unpacked, written

ORDERS = (2, 3, 4)
SLAB = 1 << 18
UNKNOWN = "und"
GROUP = 512  # languages of one filter, a multiple of 64
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

_ALPHA: list = []


def _alpha() -> np.ndarray:
    """Letter flag of every code point (categories L*), once per process."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _ALPHA[0]


def code_points(text: str):
    """Lower-case letters with one blank after each run of them, slab by slab."""
    before = False
    for at in range(0, len(text), SLAB):
        raw = np.frombuffer(text[at : at + SLAB].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _alpha()[raw]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first other character after a run: its blank
        keep[0] |= before
        before = bool(letter[-1])
        yield np.where(letter, raw, 32).astype(np.uint64)[keep]


def _grams(cp: np.ndarray, starts: int) -> np.ndarray:
    """Hashes of the n-grams of all orders that begin at the first ``starts`` places."""
    h, done, out = cp.copy(), 1, []
    for order in ORDERS:
        while done < order:
            h = h[:-1] * _MULT + cp[done:] + np.uint64(done)
            done += 1
        x = h[:starts]
        x = (x ^ (x >> np.uint64(32))) * _MIX
        out.append(x ^ (x >> np.uint64(29)))
    return np.concatenate(out)


def gram_hashes(text: str):
    """Arrays of 64-bit n-gram hashes of all orders; nothing without a letter."""
    last = max(ORDERS) - 1
    blank = np.array([32], dtype=np.uint64)
    held, some = blank, False
    for part in code_points(text):
        if not len(part):
            continue
        held, some = np.concatenate([held, part]), True
        if len(held) > last:
            yield _grams(held, len(held) - last)
            held = held[-last:]
    if some:
        held = held if held[-1] == 32 else np.concatenate([held, blank])
        yield _grams(held, len(held))


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filter: ``slots[w][i]`` holds languages 64w..64w+63."""

    langs: list[str]
    bits: int
    slots: np.ndarray  # (words, 2**bits)

    def __post_init__(self):
        n = len(self.langs)
        self.noise = np.zeros(n)
        for i in range(n):
            fill = np.mean((self.slots[i // 64] >> self.slots.dtype.type(i % 64)) & self.slots.dtype.type(1))
            self.noise[i] = fill**2

    def shares(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected share of the n-grams that each language contains; their number."""
        n = len(self.langs)
        got, total = np.zeros(n), 0
        for h in gram_hashes(text):
            a, b = _slots(h, self.bits)
            total += len(h)
            for w in range(len(self.slots)):
                mask = self.slots[w][a] & self.slots[w][b]
                if self.slots.dtype.itemsize == 1:
                    seen = np.bincount(mask, minlength=256)
                    for i in range(min(8, n)):
                        got[i] += seen[(np.arange(256) >> i) & 1 == 1].sum()
                else:
                    for i in range(64 * w, min(n, 64 * w + 64)):
                        bit = mask.dtype.type(i % 64)
                        got[i] += np.count_nonzero((mask >> bit) & mask.dtype.type(1))
        if not total:
            return got, 0
        return np.clip((got / total - self.noise) / np.maximum(1 - self.noise, 1e-12), 0, 1), total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        shares, total = self.shares(text)
        if not total:
            return UNKNOWN, 0.0
        best = int(np.argmax(shares))
        return self.langs[best], float(shares[best])


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing is learned from."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) with one row per batch, language and n-gram."""

    def run(batches):
        for b in batches:
            by: dict[int, list[np.ndarray]] = {}
            size = 0

            def flush():
                for lang, parts in by.items():
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), lang, np.int32)), pa.array(g.view(np.int64)), pa.array(n)],
                        names=["lang", "gram", "n"],
                    )
                by.clear()

            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for h in gram_hashes(text.as_py() or ""):
                    by.setdefault(lang, []).append(h)
                    size += len(h)
                if size > 4 << 20:
                    yield from flush()
                    size = 0
            yield from flush()

    return rows.mapInArrow(run, "lang int, gram long, n long")


def learn(
    docs: DataFrame,
    sample_docs: int = 4000,
    min_count: int = 2,
    min_rate: float = 1e-5,
    min_share: float = 0.2,
    slot_bits: int = 20,
    group: int = GROUP,
) -> LanguageFilter | FilterGroups:
    """Fit the filter on about ``sample_docs`` labelled documents per language;
    filters of ``group`` languages each where there are more."""
    if group % 64:
        raise ValueError("group must be a multiple of 64")
    known = docs.select("doc_id", "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    order = Window.orderBy("lang")  # UTF-8 order is code-point order; a row per language
    langs = known.groupBy("lang").count().withColumn("number", (F.row_number().over(order) - 1).cast("int"))
    part = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("count"))
    langs = written(langs.select("lang", "number", part.alias("part")), "languages")
    draw = (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sample = known.join(langs, "lang").filter(draw < F.col("part")).select(F.col("number").alias("lang"), "text")
    counts = _counted(sample).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = written(counts.groupBy("lang").agg(F.sum("n").cast("double").alias("total")), "gram-totals")
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.groupBy("gram").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("has")
    )
    chosen = top.select("gram", "top", F.inline("has")).filter(
        (F.col("n") >= min_count) & (F.col("rate") >= min_rate) & (F.col("rate") >= min_share * F.col("top"))
    )
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), lang % 64)")
    halves = F.array(
        F.shiftrightunsigned("gram", 64 - slot_bits), F.col("gram").bitwiseAND(F.lit((1 << slot_bits) - 1))
    )
    filled = (
        chosen.select((F.col("lang") / 64).cast("int").alias("word"), bit.alias("bit"), F.explode(halves).alias("slot"))
        .groupBy("word", "slot")
        .agg(F.bit_or("bit").alias("mask"))
    )
    n = langs.count()
    groups = FilterGroups(langs, filled, n, slot_bits, group)
    if n <= group:
        return groups.load(0)
    groups.filled = written(filled, "language-slots")
    return groups


@dataclass
class FilterGroups:
    """Filters of very many languages, ``group`` at a time."""

    names: DataFrame  # (lang, number)
    filled: DataFrame  # (word, slot, mask)
    n: int
    bits: int
    group: int

    def __len__(self) -> int:
        return -(-self.n // self.group)

    def load(self, i: int) -> LanguageFilter:
        """The filter of group ``i``: at most ``group`` names and
        ``2**bits`` slots for every 64 of them reach the driver."""
        first, last = i * self.group, min(self.n, (i + 1) * self.group)
        own = self.names.filter(F.col("number").between(first, last - 1)).orderBy("number")
        langs = [r.lang for r in own.select("lang").collect()]
        if not langs:
            return LanguageFilter([], self.bits, np.zeros((1, 1 << self.bits), np.uint8))
        words = (last - first + 63) // 64
        got = self.filled.filter(F.col("word").between(first // 64, first // 64 + words - 1)).toArrow()
        slots = np.zeros((words, 1 << self.bits), dtype=np.uint64)
        at = got["word"].to_numpy() - first // 64
        slots[at, got["slot"].to_numpy()] = got["mask"].to_numpy().astype(np.int64).view(np.uint64)
        return LanguageFilter(langs, self.bits, slots.astype(np.uint8) if len(langs) <= 8 else slots)


def identify(
    docs: DataFrame, model: LanguageFilter | FilterGroups, text: str = "text", keep: tuple = ("*",)
) -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred and score."""
    if isinstance(model, FilterGroups):
        return _identified_by_groups(docs, model, text, keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**slot_bits slots
    rows = docs.select(*keep, F.col(text).alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        m = sent.value
        for b in batches:
            out = [m.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            cols = [b.column(i) for i in range(len(names))]
            cols += [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score"])

    schema = T.StructType(
        [*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return rows.mapInArrow(run, schema)


def _identified_by_groups(docs: DataFrame, groups: FilterGroups, text: str, keep: tuple) -> DataFrame:
    """Every group's answer against the best one before; equal scores stay
    with the first language."""
    best = docs.select(F.struct(*keep).alias("__keep"), F.col(text).alias("__told"))
    best = best.withColumns({"__lang": F.lit(UNKNOWN), "__best": F.lit(0.0)})
    for i in range(len(groups)):
        told = identify(best, groups.load(i), "__told")
        better = (F.col("lang_pred") != UNKNOWN) & ((F.col("score") > F.col("__best")) | (F.col("__lang") == UNKNOWN))
        best = told.select(
            "__keep",
            "__told",
            F.when(better, F.col("lang_pred")).otherwise(F.col("__lang")).alias("__lang"),
            F.when(better, F.col("score")).otherwise(F.col("__best")).alias("__best"),
        )
        best = written(best, "language-so-far")
    out = best.withColumnsRenamed({"__lang": "lang_pred", "__best": "score"})
    return unpacked(out, "__keep", ["lang_pred", "score"])


def accepted(docs: DataFrame, model: LanguageFilter | FilterGroups, min_score: float = 0.2) -> DataFrame:
    """Rows of ``docs`` with a recognised language, columns unchanged.

    Rejected: ``und`` and texts of which less than ``min_score`` of the
    n-grams (corrected) belong to the best language.
    """
    packed = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"))
    told = identify(packed, model, "__text", ("__row",))
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    model = learn(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model, "text", ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
