"""Substring dedup by Relative Lempel-Ziv parsing against content-keyed blocks.

The reference is the corpus itself, cut into blocks by content, so that a
document is parsed against every block that can hold a repeat of it and meets
no other:

1. *Blocks.*  Each window of ``window`` words has an anchor, the smallest
   hash among its ``gram``-word grams.  Equal windows have equal anchors.  A
   *phrase* is a longest run of neighbouring windows with one anchor, so
   phrase edges depend on content alone and shift with it.  A block holds all
   phrases with its anchor, each different one once.  A phrase that stands
   twice or more is repeated whole; spans of neighbouring phrases merge.
2. *Index.*  Of the different phrases of a block up to ``LANES`` are its
   indexed reference: of each residue of the content hash the one that stands
   most often.  Their texts are kept with the place of their anchor gram.
3. *Greedy factors.*  Each different phrase is parsed from the left: the
   longest match with an indexed phrase at the current word, found by extending
   the anchor gram to both sides, word by word as bytes, is a factor if it has
   ``window`` words or more.  A factor is a duplicate span in the phrase and in
   the reference.
4. *Factor boundaries.*  The parse goes on at the first window that the factor
   does not hold, so windows over a boundary are matched too.  A window in no
   factor stands in no indexed phrase of the block; those are counted by hash
   over the block, which finds what repeats outside its reference.  This is
   the exact way for blocks with more phrases than the index holds.

A phrase that holds its anchor gram twice has no single alignment; all its
windows are counted, with those of the block's reference.

Blocks are keys of Spark aggregates and joins, never tasks of their own:
counts combine before the shuffle and the joins read plain written tables,
so that adaptive execution splits a block that holds a large part of all
rows.  Factors compare bytes; whole phrases and the windows outside factors
rest on hashes of 64 bits each for anchor and content, and both must agree.

Defined results: null or empty text has no words; a text with fewer than
``window`` words is kept; exact repeats are occurrences of each other, also
as repeated rows with one doc_id; texts of any length are read in pieces of
``PIECE`` bytes; empty table: no rows; other columns are ignored (or kept by
:func:`without_repeats`).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import left_lookup, text_hash, unpacked, written

WINDOW, GRAM = 35, 8
PIECE = 1 << 20
LANES = 4  # indexed phrases of a block, at most
SHARE = 1024  # phrases of a block to a copy of its index
KEY = ["doc_id", "text_hash"]
U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BLANK, _WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")
_BASES = {"word": 0x9E3779B97F4A7C15, "gram": 0xC2B2AE3D27D4EB4F, "text": 0xD6E8FEB86659FD93}  # odd multipliers
_powers: dict = {}


def _power(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd multiplier and of its inverse modulo 2^64."""
    if name not in _powers or len(_powers[name][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_BASES[name], pow(_BASES[name], -1, 1 << 64)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[name] = tuple(out)
    return _powers[name]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Hash of any stretch of values, from prefix sums of value * base^i."""

    def __init__(self, values: np.ndarray, name: str):
        up, self.down = _power(name, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[first]) * self.down[first]


def word_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    edge = np.ones(len(b) + 2, dtype=np.int8)
    edge[1:-1] = _SPACE[b]
    at = np.flatnonzero(np.diff(edge))
    first, end = at[0::2], at[1::2]
    return _mix(Rolling(b.astype(U) + U(1), "word")(first, end) + (end - first).astype(U) * U(0x165667B19E3779F9))


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every n neighbours."""
    size = 1
    while size * 2 <= n:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _cut(texts, window: int):
    """Lists of whole texts, or pieces of a long one with ``window`` - 1 words
    in common: (number of the text, number of its first word, bytes)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    parts, size = [], 0
    for i, raw in enumerate(texts):
        at = pos = 0
        while len(raw) - pos > PIECE and (gap := _BLANK.search(raw, pos + PIECE)):
            starts = [m.start() for m in _WORD.finditer(raw, pos, gap.start())]
            if len(starts) < window:  # giant words: the rest in one piece
                break
            yield [*parts, (i, at, raw[pos : gap.start()])]
            parts, size = [], 0
            at, pos = at + len(starts) - (window - 1), starts[-(window - 1)]
        parts.append((i, at, raw[pos:]))
        size += len(raw) - pos
        if size >= PIECE:
            yield parts
            parts, size = [], 0
    if parts:
        yield parts


def _hashed(parts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the pieces and the owner of each word, from 0."""
    hashes = [word_hashes(raw) for _, _, raw in parts]
    return np.concatenate(hashes), np.repeat(np.arange(len(parts)), [len(h) for h in hashes])


def pieces(texts, window: int):
    """Batches of whole texts or pieces: (word hashes, owner of each word,
    text and first word number of each owner's piece)."""
    for parts in _cut(texts, window):
        yield *_hashed(parts), [(i, at) for i, at, _ in parts]


class Parse:
    """Windows, anchors and phrases of one batch of texts."""

    def __init__(self, hashes: np.ndarray, owner: np.ndarray, window: int, gram: int):
        n = len(hashes)
        self.window = window
        self.text = Rolling(hashes, "text")
        if n < window:
            self.first = self.last = np.zeros(0, dtype=np.int64)
            self.anchor = np.zeros(0, dtype=U)
            self.loops = np.zeros(0, dtype=bool)
            return
        i = np.arange(n - gram + 1)
        grams = _mix(Rolling(hashes, "gram")(i, i + gram))
        span = window - gram + 1
        least = _sliding(grams, span, np.minimum)  # by window start
        whole = owner[: n - window + 1] == owner[window - 1 :]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
        end = whole.copy()
        end[:-1] &= ~whole[1:] | (least[1:] != least[:-1])
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(end)
        self.anchor = least[self.first]
        self.loops = self._loops(grams, np.where(whole, least, U(0)), owner, span)

    def _loops(self, grams, least, owner, span) -> np.ndarray:
        """Phrases whose anchor gram stands in them twice, at most ``span``
        apart: in one window, or (exactly ``span``) in neighbouring ones."""
        pad = np.zeros(span - 1, dtype=U)
        top = _sliding(np.concatenate([pad, least, pad]), span, np.maximum)
        at = np.flatnonzero((top[: len(grams)] == grams) & (grams > 0))
        x, y = at[:-1], at[1:]
        twice = (grams[x] == grams[y]) & (owner[x] == owner[y]) & (y - x <= span)
        mark = np.zeros(len(least) + 1, dtype=np.int64)
        np.add.at(mark, np.minimum(np.clip(y[twice] - span + 1, 0, x[twice]), len(least)), 1)
        np.add.at(mark, np.minimum(x[twice] + 1, len(least)), -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
        return hit[self.last + 1] > hit[self.first]

    def content(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mix(self.text(first, last + self.window) + (last - first).astype(U))


def _texts(col) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in col]


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("binary").alias("text")
    )


def phrases(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, first, windows, anchor, content, loops)."""
    rows = _narrow(docs)
    schema = T.StructType(
        [*rows.schema.fields[:2]]
        + [T.StructField(n, t) for n, t in (
            ("first", T.IntegerType()), ("windows", T.IntegerType()), ("anchor", T.LongType()),
            ("content", T.LongType()), ("loops", T.BooleanType()),
        )]
    )

    def run(batches):
        for b in batches:
            for hashes, owner, parts in pieces(_texts(b.column(2)), window):
                p = Parse(hashes, owner, window, gram)
                if not len(p.first):
                    continue
                begin = np.searchsorted(owner, np.arange(len(parts)))
                base = np.array([at for _, at in parts]) - begin  # word number in its text
                who = owner[p.first]
                rows_at = pa.array(np.array([i for i, _ in parts])[who])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(rows_at),
                        b.column(1).take(rows_at),
                        pa.array((p.first + base[who]).astype(np.int32)),
                        pa.array((p.last - p.first + 1).astype(np.int32)),
                        pa.array(p.anchor.view(np.int64)),
                        pa.array(p.content(p.first, p.last).view(np.int64)),
                        pa.array(p.loops),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


#: A phrase to parse: ``whole`` if it stands twice or more, ``loops`` if it holds
#: its anchor gram twice, ``ref`` if indexed, ``every`` if all its windows count.
TODO = [("first", "integer"), ("windows", "integer"), ("anchor", "long"), ("content", "long"), ("salt", "long"), ("salts", "long")]
TODO += [(name, "boolean") for name in ("whole", "loops", "ref", "every")]


def _phrase_texts(docs: DataFrame, work: DataFrame, window: int, gram: int) -> DataFrame:
    """The phrases in ``work`` (doc_id, text_hash, todo array<struct<TODO>>), a
    row each, with ``at``, the place of the anchor gram in the phrase (-1 if twice), and
    ``words``, its words joined by one space."""
    rows = _narrow(docs)
    both = left_lookup(rows, work, KEY, "inner").select(*KEY, "text", "todo")
    schema = T.StructType(rows.schema.fields[:2])
    for name, kind in [*TODO, ("at", "integer"), ("words", "binary")]:
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            todo = b.column(3)
            items = todo.flatten()
            off = todo.offsets.to_numpy() - todo.offsets[0].as_py()
            first, count = (items.field(k).to_numpy() for k in (0, 1))
            looped = items.field(7).to_pylist()
            for parts in _cut(_texts(b.column(2)), window):
                hashes, owner = _hashed(parts)
                if len(hashes) < window:
                    continue
                i = np.arange(len(hashes) - gram + 1)
                grams = _mix(Rolling(hashes, "gram")(i, i + gram))
                begin = np.searchsorted(owner, np.arange(len(parts)))
                sizes = np.searchsorted(owner, np.arange(len(parts)), side="right") - begin
                item, who, place, texts = [], [], [], []
                for j, (i, at, raw) in enumerate(parts):
                    f, n = first[off[i] : off[i + 1]] - at, count[off[i] : off[i + 1]]
                    here = np.flatnonzero((f >= 0) & (f + n + window - 1 <= sizes[j]))
                    if not len(here):
                        continue
                    ws = raw.split()
                    for k, x, c in zip(here.tolist(), f[here].tolist(), n[here].tolist()):
                        last = x + c - 1  # all windows hold the gram: it stands from here to the first window's end
                        alone = grams[begin[j] + last : begin[j] + x + window - gram + 1]
                        place.append(-1 if looped[off[i] + k] else c - 1 + int(alone.argmin()))
                        texts.append(b" ".join(ws[x : last + window]))
                        item.append(off[i] + k)
                        who.append(i)
                if item:
                    own, item = pa.array(who, pa.int64()), pa.array(np.array(item))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(own), b.column(1).take(own)]
                        + [items.field(k).take(item) for k in range(len(TODO))]
                        + [pa.array(place, pa.int32()), pa.array(texts, pa.binary())],
                        names=schema.names,
                    )

    return both.mapInArrow(run, schema)


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def factors(words: list[bytes], at: int, indexed: list[tuple[list[bytes], int]], window: int, gram: int):
    """Greedy parse of a phrase against a block's indexed phrases.

    Both hold the block's anchor gram once, at ``at``.  Returns the factors
    (first word, end, number of the indexed phrase, first word there) and the
    starts of the windows that no factor holds."""
    matches = []
    for k, (other, there) in enumerate(indexed):
        right = _common(words[at:], other[there:])
        if right >= gram:  # else another gram with the anchor's hash
            left = _common(words[:at][::-1], other[:there][::-1])
            matches.append((at + right, at - left, k, there - at))
    found, rest, s = [], [], 0
    while s <= len(words) - window:
        end, _, k, shift = max((m for m in matches if m[1] <= s), default=(0, 0, 0, 0))
        if end - s >= window:
            found.append((s, end, k, s + shift))
            s = end - window + 1  # the first window over the factor's boundary
        else:
            rest.append(s)
            s += 1
    return found, rest


def _factored(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Spans and open windows of the phrases: (doc_id, text_hash, first, len,
    anchor, hash, whole); ``hash`` is null for a span of a factor.

    A block's index is copied for every ``SHARE`` phrases of the block, and
    the phrases are spread over the copies, so that no task gets a whole hot
    block."""
    place = F.struct("content", "at", "words", *KEY, "first")
    refs = texts.filter("ref").groupBy("anchor").agg(  # LANES phrases at most
        F.collect_list(place).alias("refs"), F.max("salts").alias("salts")
    )
    refs = refs.select("anchor", "refs", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = left_lookup(texts, written(refs, "block-index"), ["anchor", "salt"]).select(
        *KEY, "first", "windows", "anchor", "content", "whole", "loops", "every", "at", "words", "refs"
    )
    schema = T.StructType(both.schema.fields[:2])
    for name, kind in (("first", "integer"), ("len", "integer"), ("anchor", "long"), ("hash", "long"), ("whole", "boolean")):
        schema = schema.add(name, kind)

    def spans(doc, text, found):
        """Rows of (row number, first, len) triples."""
        who, first, n = (pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32())))
        none = pa.nulls(len(who), pa.int64())
        cols = [doc.take(who), text.take(who), first, n, none, none, pa.nulls(len(who), pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches):
        for b in (batch.slice(i, SHARE) for batch in batches for i in range(0, batch.num_rows, SHARE)):
            col = dict(zip(b.schema.names, b.columns))
            first, windows, content, at, loops, every, words = (
                col[n].to_pylist() for n in ("first", "windows", "content", "at", "loops", "every", "words")
            )
            refs = col["refs"]
            index = refs.flatten()
            off = (refs.offsets.to_numpy() - refs.offsets[0].as_py()).tolist()
            ref_content, ref_at, ref_words, ref_first = (index.field(k).to_pylist() for k in (0, 1, 2, 5))
            anchors, indexed, block = col["anchor"].to_pylist(), [], None
            here, there, open_windows = [], set(), []
            for r, phrase in enumerate(words):
                if loops[r]:
                    open_windows.append((r, range(windows[r])))
                    continue
                if anchors[r] != block:  # rows of a block come together
                    block = anchors[r]
                    indexed = [(k, ref_words[k].split(b" "), ref_at[k]) for k in range(off[r], off[r + 1])]
                others = [x for x in indexed if ref_content[x[0]] != content[r]]
                found, rest = factors(phrase.split(b" "), at[r], [x[1:] for x in others], window, gram)
                for start, end, k, begin in found:
                    k = others[k][0]
                    here.append((r, first[r] + start, end - start))
                    there.add((k, ref_first[k] + begin, end - start))
                if every[r] or rest:
                    open_windows.append((r, range(windows[r]) if every[r] else rest))
            if here:
                yield spans(col["doc_id"], col["text_hash"], here)
                yield spans(index.field(3), index.field(4), sorted(there))
            if open_windows:
                hashes = word_hashes(b" ".join(words))
                begin = np.cumsum([0, *(n + window - 1 for n in windows)])
                who = np.repeat([r for r, _ in open_windows], [len(x) for _, x in open_windows])
                start = np.concatenate([np.array(x) for _, x in open_windows])
                pos, rows_at = begin[who] + start, pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [
                        col["doc_id"].take(rows_at),
                        col["text_hash"].take(rows_at),
                        pa.array((np.array(first)[who] + start).astype(np.int32)),
                        pa.array(np.full(len(who), window, dtype=np.int32)),
                        col["anchor"].take(rows_at),
                        pa.array(_mix(Rolling(hashes, "text")(pos, pos + window)).view(np.int64)),
                        col["whole"].take(rows_at),
                    ],
                    names=schema.names,
                )

    return both.mapInArrow(run, schema)


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, spans array<struct<first, len>>) where there are any."""
    found = written(phrases(docs, window, gram), "phrases")
    blocks = found.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b"), F.max("loops").alias("looped")
    )
    blocks = blocks.filter((F.col("n") > 1) | F.col("looped"))
    mixed = (F.col("a") != F.col("b")) | F.col("looped")
    salts = F.ceil(F.col("n") / SHARE).alias("salts")
    blocks = written(blocks.select("anchor", "looped", mixed.alias("mixed"), salts), "blocks")
    shared = written(found.join(blocks, "anchor"), "shared-phrases")

    # blocks with different phrases: each of them once, at its first place
    place = F.min(F.struct(*KEY, "first", "windows", "loops", "looped", "salts"))
    kinds = shared.filter("mixed").groupBy("anchor", "content").agg(F.count("*").alias("n"), place.alias("at"))
    kinds = written(kinds, "phrase-kinds")
    whole = kinds.filter("n > 1").select(F.col("anchor").alias("__a"), F.col("content").alias("__c"))
    span = F.struct(F.col("first"), (F.col("windows") + (window - 1)).alias("len"))
    copied = shared.filter("NOT mixed").select(*KEY, span.alias("span")).union(
        shared.filter("mixed")
        .join(whole, (F.col("anchor") == F.col("__a")) & (F.col("content") == F.col("__c")), "left_semi")
        .select(*KEY, span.alias("span"))
    )

    # a block's indexed phrases: per residue the one that stands most often
    lane = F.pmod("content", F.lit(LANES))
    most = [F.max(F.when(lane == i, F.struct("n", "content")))["content"].alias(f"l{i}") for i in range(LANES)]
    index = kinds.filter("NOT at.loops").groupBy("anchor").agg(*most)
    index = index.select("anchor", F.explode(F.array(*[f"l{i}" for i in range(LANES)])).alias("content"))
    index = written(index.filter("content IS NOT NULL").withColumn("indexed", F.lit(True)), "indexed-phrases")
    ref = F.col("indexed").isNotNull()
    todo = F.struct(
        "at.first", "at.windows", "anchor", "content", F.pmod(F.xxhash64("content"), "at.salts").alias("salt"),
        "at.salts", (F.col("n") > 1).alias("whole"), "at.loops", ref.alias("ref"),
        (F.col("at.looped") & ref).alias("every"),
    )
    work = left_lookup(kinds, index, ["anchor", "content"]).select("at.doc_id", "at.text_hash", todo.alias("todo"))
    work = written(work.groupBy(*KEY).agg(F.collect_list("todo").alias("todo")), "phrase-work")
    # (a row that is repeated gives its phrases for each repeat, but then all
    # its phrases stand twice or more, and their windows count as such anyway)
    texts = written(_phrase_texts(docs, work, window, gram), "phrase-texts")
    parsed = written(_factored(texts, window, gram), "factors")

    # windows in no factor, counted; those of a phrase that stands twice or more count twice
    wins = parsed.filter("hash IS NOT NULL")
    total = F.sum(F.when(F.col("whole"), 2).otherwise(1))
    twice = written(
        wins.groupBy("anchor", "hash").agg(total.alias("n")).filter("n > 1").select("anchor", "hash"), "repeats"
    )
    parts = wins.filter("NOT whole").join(twice, ["anchor", "hash"], "left_semi")
    partly = parsed.filter("hash IS NULL").union(parts.select(*parsed.columns))
    spans = copied.union(partly.select(*KEY, F.struct("first", "len").alias("span")))
    return written(spans.groupBy(*KEY).agg(F.collect_set("span").alias("spans")), "spans")


def cut(words: list[bytes], spans) -> list[bytes]:
    """``words`` outside the union of (first, len) spans."""
    kept, at = [], 0
    for first, n in sorted(spans):
        if first > at:
            kept += words[at:first]
        at = max(at, first + n)
    return kept + words[at:]


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep=("*",)) -> DataFrame:
    """``keep`` columns of ``docs`` plus n_words, n_removed and kept (the words
    outside duplicate spans, joined by one space; null text: empty)."""
    spans = duplicate_spans(docs, window, gram)
    rows = docs.select(
        F.struct(*keep).alias("__row"),
        F.col("doc_id"),
        text_hash(F.col("text")).alias("text_hash"),
        F.col("text").cast("binary").alias("__bytes"),
    )
    both = left_lookup(rows, spans, KEY).select("__row", "__bytes", "spans")
    schema = T.StructType(
        [both.schema["__row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
         T.StructField("kept", T.BinaryType())]
    )

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for raw, sp in zip(_texts(b.column(1)), b.column(2)):
                ws = raw.split()
                left = cut(ws, [(s["first"], s["len"]) for s in sp.as_py()]) if sp.is_valid else ws
                n.append(len(ws))
                gone.append(len(ws) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                names=schema.names,
            )

    out = both.mapInArrow(run, schema).withColumn("kept", F.col("kept").cast("string"))
    return unpacked(out, "__row", ["n_words", "n_removed", "kept"])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = without_repeats(docs, keep=("doc_id",))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT r, p, list_slice(w, p, p + {WINDOW - 1}) AS k
         FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT k FROM wins GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS i FROM wins JOIN twice USING (k)),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
         FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
