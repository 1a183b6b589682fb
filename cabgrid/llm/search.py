"""Ranked lexical search: the best documents of every item, by dual trees.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
A document scores an item by the sum, over the item's terms with repeats, of
``weight(term) * impact(term in document)``, in 64-bit integers:

* ``weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))``;
* ``impact = (10^9 tf) div (1000 tf + 12 m)``, ``m = 75 + (25 n N) div L``.

Both sides are sparse vectors, a score is their product.  The *dual-tree*
search builds a hierarchy over the items (weights times repeats) and, in every
task, one over its documents (impacts); each node holds the coordinate maxima
of what lies below.  The product of an item node and a document node bounds
every score between them, so a pair goes, with all items and documents below,
when its bound is under the weakest kth score of its items.  Surviving leaves
are scored exactly and raise those kth scores.  Nothing else drops a pair, so
the ranking is exact.

Documents are first put in order of their heaviest terms (a range partition
that ends with a row number, so that no group of equal documents stays in one
task): documents of one node then share terms, and bounds are tight.  The
search starts from kth scores found among some ``SEED_DOCS`` documents spread
by hash; they are true lower bounds and only save work.

Items are taken in blocks of about ``BLOCK_BYTES`` of text, each a search of
its own over all documents; a block's tree and vocabulary, bounded by that
size (or by one item's text), go to the tasks.  The driver sees per block its
items, one document count per term of theirs and one kth score per item.  A
task returns at most ``k`` rows an item.

Defined results: null texts and texts without terms have no rows; every row
of either table is its own document or item, so repeated ids repeat; equal
scores go by doc_id, null ids last; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

TOP = 20
BLOCK_BYTES = 1 << 18
SEED_DOCS = 1 << 14
LEAF_DOCS, FAN = 32, 8  # documents in a leaf; children of a node
CELLS = 1 << 22  # entries of a task's table of leaf maxima: terms x leaves
PIECE = 1 << 20
BEYOND = 1.0 + 1e-9  # covers the rounding of a bound

_KEEP = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b in _KEEP else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_lists(text: bytes):
    """Lower-cased terms in order, a piece of the text at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_TABLE).split()
        at = end


# --- the item tree ---------------------------------------------------------------


@dataclass
class Node:
    """Coordinate maxima (terms, weights) over the items below, with the
    positions of those items and the child nodes (none: one item)."""

    terms: np.ndarray
    weights: np.ndarray
    items: np.ndarray
    below: list


def item_tree(vectors: list[dict[int, int]]) -> Node | None:
    """Tree over items given as {term: weight}; items with like heaviest
    terms lie together."""
    held = [i for i, v in enumerate(vectors) if v]
    heaviest = lambda i: sorted(vectors[i], key=lambda t: (-vectors[i][t], t))[:3]
    nodes = []
    for i in sorted(held, key=lambda i: (heaviest(i), i)):
        terms = np.array(sorted(vectors[i]), dtype=np.int64)
        weights = np.array([vectors[i][t] for t in terms.tolist()], dtype=np.int64)
        nodes.append(Node(terms, weights, np.array([i]), []))
    while len(nodes) > 1:
        nodes = [_parent(nodes[at : at + FAN]) for at in range(0, len(nodes), FAN)]
    return nodes[0] if nodes else None


def _parent(children: list[Node]) -> Node:
    if len(children) == 1:
        return children[0]
    terms = np.concatenate([c.terms for c in children])
    weights = np.concatenate([c.weights for c in children])
    own, at = np.unique(terms, return_inverse=True)
    most = np.zeros(len(own), dtype=np.int64)
    np.maximum.at(most, at, weights)
    return Node(own, most, np.concatenate([c.items for c in children]), children)


# --- the document tree and the search over both -------------------------------------


@dataclass
class Documents:
    """Some documents' postings in order of (leaf, term), and the maxima of
    every level, leaves first: one table (terms x nodes) a level."""

    ids: np.ndarray  # doc_id; null as the largest long plus ``none``
    none: np.ndarray
    key: np.ndarray  # leaf * n_terms + term of a posting
    doc: np.ndarray
    impact: np.ndarray
    levels: list[np.ndarray]


def document_tree(ids, none, size: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> Documents:
    """``size``: postings of each document; ``terms``, ``impacts``: all of them."""
    doc = np.repeat(np.arange(len(size)), size)
    key = doc // LEAF_DOCS * n_terms + terms
    order = np.argsort(key, kind="stable")
    key, doc, impact = key[order], doc[order], impacts[order]
    leaves = -(-len(size) // LEAF_DOCS)
    low = np.zeros((n_terms, leaves))
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low[key[first] % n_terms, key[first] // n_terms] = np.maximum.reduceat(impact, first)
    levels = [low]
    while levels[-1].shape[1] > FAN:
        n = levels[-1].shape[1]
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, n, FAN), axis=1))
    return Documents(ids, none, key, doc, impact, levels)


class Best:
    """The best ``k`` documents of every item so far, and its kth score."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.astype(np.int64).copy()
        self.rows: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64) for _ in least]

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        rows = np.vstack([self.rows[item], np.column_stack([score, none, ids])])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.k]
        self.rows[item] = rows
        if len(rows) == self.k:
            self.least[item] = max(self.least[item], rows[-1, 0])


def _bounds(docs: Documents, node: Node, level: int, at: np.ndarray) -> np.ndarray:
    table = docs.levels[level]
    rows = table[node.terms] if len(at) == table.shape[1] else table[np.ix_(node.terms, at)]
    return node.weights @ rows


def search(docs: Documents, node: Node, best: Best, n_terms: int, level: int | None = None, at=None) -> None:
    """Score every pair of an item below ``node`` and a document below nodes
    ``at`` of ``level`` that may enter the item's best."""
    if level is None:
        level = len(docs.levels) - 1
        at = np.arange(docs.levels[level].shape[1])
    bound = _bounds(docs, node, level, at) * BEYOND
    stay = (bound >= best.least[node.items].min()) & (bound > 0)
    at, bound = at[stay], bound[stay]
    if not len(at):
        return
    if level:
        n = docs.levels[level - 1].shape[1]
        at = (at[:, None] * FAN + np.arange(FAN)).ravel()
        at = at[at < n]
    elif not node.below:
        order = np.argsort(-bound, kind="stable")
        for i in range(0, len(order), FAN):  # best leaves first, as they raise the kth score
            some = order[i : i + FAN]
            some = some[bound[some] >= best.least[node.items[0]]]
            if not len(some):
                return
            _score(docs, node, best, n_terms, at[some])
        return
    for child in node.below or [node]:
        search(docs, child, best, n_terms, max(0, level - 1), at)


def _score(docs: Documents, node: Node, best: Best, n_terms: int, leaves: np.ndarray) -> None:
    """Exact scores of one item in some leaves."""
    key = (leaves[:, None] * n_terms + node.terms).ravel()
    weight = np.tile(node.weights, len(leaves))
    lo, hi = np.searchsorted(docs.key, key, "left"), np.searchsorted(docs.key, key, "right")
    size = hi - lo
    if not size.sum():
        return
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    found, place = np.unique(docs.doc[at], return_inverse=True)
    score = np.zeros(len(found), dtype=np.int64)
    np.add.at(score, place, docs.impact[at] * np.repeat(weight, size))
    item = int(node.items[0])
    stay = (score > 0) & (score >= best.least[item])
    if stay.any():
        best.add(item, score[stay], docs.ids[found[stay]], docs.none[found[stay]])


# --- on Spark -------------------------------------------------------------------------


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document that has a term; ``n`` counts
    all its terms, ``terms`` holds those of the vocabulary."""

    def run(batches):
        get = vocabulary.get
        for b in batches:
            ids, ns, terms, tfs = [], [], [], []
            for i in range(len(b)):
                n, found = 0, Counter()
                for ws in term_lists(b.column("text")[i].as_py()):
                    n += len(ws)
                    found.update([t for w in ws if (t := get(w)) is not None])
                if n:
                    own = sorted(found)
                    ids.append(i)
                    ns.append(n)
                    terms.append(own)
                    tfs.append([found[t] for t in own])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(ids, pa.int64())),
                    pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tf"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def _holders(vectors: DataFrame, n_terms: int) -> list[int]:
    """Documents that hold each term: summed in every task, then by term."""

    def run(batches):
        total = np.zeros(n_terms, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["t", "c"])

    out = [0] * n_terms
    for r in vectors.select("terms").mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).collect():
        out[r.t] = r.c
    return out


def weights_of(holders: list[int], n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holders], dtype=np.int64)


def _impacts(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_all: int) -> DataFrame:
    """(row, doc_id, terms, impact, t1, t2, t3): the three terms that weigh most."""

    def run(batches):
        for b in batches:
            size = np.diff(b.column("terms").offsets.to_numpy())
            terms = b.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = b.column("tf").flatten().to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy(zero_copy_only=False)
            m = np.repeat(75 + 25 * n * n_docs // n_all, size)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
            doc = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((terms, -impact * weights[terms], doc))
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            tops = [
                np.where(size > j, terms[order[np.minimum(first + j, max(0, len(order) - 1))]] if len(order) else -1, -1)
                for j in range(3)
            ]
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"), b.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(impact, pa.int64())),
                    *[pa.array(t, pa.int32()) for t in tops],
                ],
                names=["row", "doc_id", "terms", "impact", "t1", "t2", "t3"],
            )

    return vectors.mapInArrow(run, "row long, doc_id long, terms array<int>, impact array<long>, t1 int, t2 int, t3 int")


def _searched(impacts: DataFrame, root: Node, numbers: np.ndarray, least: np.ndarray, k: int, n_terms: int) -> DataFrame:
    """(item, score, doc_id): at most k rows an item from each task."""
    most = LEAF_DOCS * max(FAN, CELLS // n_terms)

    def run(batches):
        best = Best(least, k)
        for b in batches:
            for at in range(0, len(b), most):
                part = b.slice(at, most)
                terms, impact, ids = (part.column(c) for c in ("terms", "impact", "doc_id"))
                docs = document_tree(
                    ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                    np.diff(terms.offsets.to_numpy()),
                    terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                    impact.flatten().to_numpy(zero_copy_only=False), n_terms,
                )
                search(docs, root, best, n_terms)
        rows = np.vstack([np.column_stack([np.full(len(r), i), r]) for i, r in enumerate(best.rows)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[rows[:, 0]]), pa.array(rows[:, 1]), pa.array(rows[:, 3], mask=rows[:, 2] == 1)],
            names=["item", "score", "doc_id"],
        )

    return impacts.select("doc_id", "terms", "impact").mapInArrow(run, "item long, score long, doc_id long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame | None:
    """(item, rank, doc_id, score) for the items (number, text) of a block."""
    spark = docs.sparkSession
    counted = [Counter(w for ws in term_lists(text) for w in ws) for _, text in items]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counted)))}
    if not vocabulary:
        return None
    n_terms = len(vocabulary)
    vectors = written(_vectors(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "lexical-vectors")
    n_docs, n_all = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weights = weights_of(_holders(vectors, n_terms), n_docs)
    root = item_tree([{vocabulary[w]: c * int(weights[vocabulary[w]]) for w, c in own.items()} for own in counted])

    impacts = _impacts(vectors.filter(F.size("terms") > 0), weights, n_docs, n_all)
    numbers, none = np.array([i for i, _ in items], dtype=np.int64), np.zeros(len(items), dtype=np.int64)
    every = max(1, n_docs // SEED_DOCS)
    seeds = impacts.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0)
    least, place = none.copy(), {int(i): at for at, i in enumerate(numbers)}
    seeded = _top(_searched(seeds, root, numbers, none, k, n_terms), k).filter(F.col("rank") == k)
    for r in seeded.select("item", "score").collect():  # a number an item of the block
        least[place[r.item]] = r.score

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["t1", "t2", "t3", "row"]
    placed = impacts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(_top(_searched(placed, root, numbers, least, k, n_terms), k), "lexical-best")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    rows = items.select("item_id", F.monotonically_increasing_id().alias("item"), text_of().cast("binary").alias("text"))
    rows = written(rows, "search-items")
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        own = [(r.item, bytes(r.text)) for r in rows.filter(F.col("block") == b).orderBy("item").select("item", "text").collect()]
        part = _block(docs, own, k) if own else None
        if part is not None:
            out = part if out is None else out.union(part)
    if out is None:
        return rows.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score"))
    return out.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    return ranked(docs, benchmark)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
held AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM held),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark),
q AS (SELECT item, term, CAST(count(*) AS BIGINT) AS c FROM (SELECT item, unnest(t) AS term FROM i) GROUP BY item, term),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM held)
      WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
s AS (SELECT q.item, held.doc_id,
        CAST(sum(q.c * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * held.n * big_n) // big_l)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN held ON held.r = p.r, total
      GROUP BY q.item, held.r, held.doc_id),
ranked AS (SELECT item, doc_id, score,
        CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= {TOP}
"""
