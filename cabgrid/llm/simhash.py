"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Fingerprint of a text: lower-case A-Z, take words ``[^\\x20\\x09-\\x0D]+``,
join every ``shingle`` consecutive words by a space (repeats kept; a shorter
text is one shingle), hash each with XXH64 (seed 42); a bit is 1 if set in
over half of the hashes.  A text without words has fingerprint zero and is
linked like any other.

Links: two fingerprints at ``max_bits`` or fewer differing bits.  The 64 bits
are cut into ``max_bits + 2`` blocks; a close pair agrees in at least two of
them, so every pair of blocks is one join key.  Candidates that meet in a
bucket are verified by their Hamming distance.  A bucket with more than
``bucket_pairs`` fingerprints is not paired: there every fingerprint is
joined to its *hubs* (itself with each choice of up to ``max_bits // 2``
bits flipped outside the key), and two fingerprints within ``max_bits`` bits
share a hub; the smallest node of each hub links to the others.  That is
exact and linear in the bucket, so neither a hot group nor a hot block emits
its pairs.  (An odd ``max_bits`` has no such hubs, so it must be even.)

Equal fingerprints are merged before anything else, so copies cost one row.

Defined results: null text = no word; repeated rows share a fingerprint and
so a component; a null ``doc_id`` counts as larger than any other (it names a
component only where no row of it has an id); empty table = empty result;
extra columns are ignored by :func:`fingerprints` and kept by
:func:`keep_one`.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import left_lookup, text_hash, written
from .components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
PIECE, SLAB = 1 << 20, 1 << 14  # SLAB: below what 16-bit bit counts hold
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(text: bytes):
    """Lower-cased words in order, a piece of the text at a time."""
    at = 0
    while at < len(text):
        gap = _BLANK.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(LOWER).split()
        at = end


def _count_bits(ones: np.ndarray, ws: list[bytes], k: int) -> int:
    """Add the bits of the hashes of all k-word shingles; their number."""
    from xxhash import xxh64_intdigest

    line = b" ".join(ws)
    size = np.array([len(w) + 1 for w in ws])
    end = np.cumsum(size)
    first, last = (end - size)[: len(ws) - k + 1].tolist(), (end - 1)[k - 1 :].tolist()
    for at in range(0, len(first), SLAB):
        h = np.array(
            [xxh64_intdigest(line[a:b], SEED) for a, b in zip(first[at : at + SLAB], last[at : at + SLAB])], dtype="<u8"
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return len(first)


def simhash(text: bytes | None, shingle: int) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text, read in pieces of
    ``PIECE`` bytes that share ``shingle`` - 1 words."""
    ones, n, held = np.zeros(64, dtype=np.int64), 0, []
    for ws in _word_lists(text or b""):
        held = held + ws
        if len(held) >= shingle:
            n += _count_bits(ones, held, shingle)
            held = held[len(held) - shingle + 1 :]
    if not n:
        if not held:
            return 0
        n = _count_bits(ones, held, len(held))
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; ``fp`` is the signed long."""

    def run(batches):
        for b in batches:
            fps = [simhash(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "text_hash", "fp"],
            )

    narrow = docs.select(
        F.col("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("binary").alias("text")
    )
    schema = T.StructType(
        [narrow.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())]
    )
    return narrow.mapInArrow(run, schema)


def _masks(max_bits: int) -> list[tuple[int, int]]:
    """(mask of a block pair, number of it); masks as signed longs."""
    cuts = [round(64 * i / (max_bits + 2)) for i in range(max_bits + 3)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    out = []
    for i, (x, y) in enumerate(combinations(blocks, 2)):
        m = x | y
        out.append((m - (1 << 64) if m >> 63 else m, i))
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _hubs(fp: Column, mask: Column, flips: int) -> Column:
    """``fp`` with each choice of up to ``flips`` bits outside ``mask`` flipped."""
    picks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(64), n)]
    outside = F.filter(
        F.array(*[F.lit(_signed(p)) for p in picks]), lambda p: p.bitwiseAND(mask) == F.lit(0).cast("long")
    )
    return F.transform(outside, lambda p: fp.bitwiseXOR(p))


def links(nodes: DataFrame, max_bits: int = 2, bucket_pairs: int = 64) -> DataFrame:
    """(a, b) links between the distinct fingerprints of ``nodes(node, fp)``.

    Their closure joins exactly the fingerprints that chains of pairs within
    ``max_bits`` bits join.
    """
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even")
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("part"), F.lit(m).cast("long").alias("mask"))
            for m, i in _masks(max_bits)
        ]
    )
    placed = nodes.select("node", "fp", F.inline(keys)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    # written, so that the join below reads two plain tables: adaptive execution can split a hot bucket
    sizes = written(placed.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1"), "block-sizes")
    shared = written(placed.join(sizes, ["part", "key"]), "blocks")

    small = shared.filter(F.col("n") <= bucket_pairs).select("part", "key", "node", "fp")
    other = small.withColumnsRenamed({"node": "node2", "fp": "fp2"})
    pairs = (
        small.join(other, ["part", "key"])
        .filter((F.col("node") < F.col("node2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits))
        .select(F.col("node").alias("a"), F.col("node2").alias("b"))
    )

    hubs = (
        shared.filter(F.col("n") > bucket_pairs)
        .select("part", "node", F.explode(_hubs(F.col("fp"), F.col("mask"), max_bits // 2)).alias("hub"))
    )
    least = hubs.groupBy("part", "hub").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    least = written(least, "hubs")
    stars = hubs.join(least, ["part", "hub"]).filter("node <> least").select(
        F.col("node").alias("a"), F.col("least").alias("b")
    )
    return pairs.union(stars).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, bucket_pairs: int = 64
) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for every row of ``docs``."""
    fps = written(fingerprints(docs, shingle), "simhash")
    return join_components(fps, max_bits, bucket_pairs)


def join_components(fps: DataFrame, max_bits: int = 2, bucket_pairs: int = 64) -> DataFrame:
    """Components of a written (doc_id, text_hash, fp) table.

    ``component`` is the component's own key, its smallest fingerprint;
    ``component_id`` its smallest doc_id.  That one is a name, not a key: with
    repeated or missing doc_ids unconnected components may share it.
    """
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    near = links(nodes.select(F.col("fp").alias("node"), "fp"), max_bits, bucket_pairs)
    comp = components(near)
    named = left_lookup(nodes, comp.withColumnRenamed("node", "fp"), ["fp"])
    named = named.withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = written(named.join(ids, "component").select("fp", "component", "component_id"), "components")
    return fps.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id
    (null last, then text hash); of exact repeats of that row, one stays.
    Components that share a doc_id, or have none, each keep their own row."""
    found = near_duplicates(docs, shingle, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    stay = found.groupBy("component").agg(first.alias("first")).select("first.doc_id", "first.text_hash")
    stay = written(stay.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}).distinct(), "stay")
    rows = docs.select(
        F.struct("*").alias("__row"),
        F.col("doc_id").alias("__doc"),
        text_hash(F.col("text")).alias("__text"),
    )
    kept = rows.join(stay, rows["__doc"].eqNullSafe(stay["__id"]) & (rows["__text"] == stay["__hash"]))
    return kept.dropDuplicates(["__doc", "__text"]).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
