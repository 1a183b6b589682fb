"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``chunk + overlap`` code points is counted in one task: its
pieces between white space (a boundary that every encoding has, as no token
holds white space) are encoded by the tokenizer's library, each distinct piece
once while it is remembered.  A longer text is cut every ``chunk`` code points; each
piece is encoded with ``overlap`` more code points on both sides, as a row of
its own, so that one giant text spreads over many tasks.  At every cut the two
encodings that cover it are spliced at a *stable common boundary*: a position
in the overlap where both have the same token (id, start, end) before it and
the same token after it, and where the character after it never composes with
the one before.

Why that is exact.  If the boundary lies between two pre-tokens of the left
encoding, its last token carries the word end and so does the right one's:
both scans start afresh there, and a pattern without lookaround reads on alike.
If it lies inside a pre-token, both are inside the same run of one character
class.  A sequence of BPE tokens is the encoding of its word exactly if every
two neighbours are the encoding of their joined text; left of the boundary all
neighbours come from one encoding, right of it from the other, and the pair
across it stands in both.  Tokenizers that this does not cover (not BPE,
dropout, patterns with lookaround, another white-space rule at the edges) are
never cut: :func:`can_cut` tells.

Where a cut has no such boundary (a long run without rhythm, such as one
letter repeated), the text is counted again piece by piece in order: the next
piece then starts on a token of the piece before it, the overlap doubles until
a stable boundary appears, and in the last resort the piece grows to the end
of the text.

Per piece only its length and the tokens of its two overlaps are kept; seams
are found by joining neighbouring pieces, and counts are sums.  Nothing but a
text itself is ever gathered.

Defined results: null text counts as empty (0 bytes, 0 tokens); every row is
counted, repeated rows and null ids included; an empty table gives an empty
result; extra columns are ignored.  Special strings inside a text are handled
as the library does by default; nothing is added, cut off or padded.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP = 1 << 15, 1 << 10
BATCH = 1 << 20  # bytes of texts counted together
KNOWN = 1 << 20  # pieces a worker remembers before it starts anew
LIMIT = 2048


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str):
    """The library's tokenizer, one thread a task."""
    os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def can_cut(path: str) -> bool:
    """Does the proof above hold for this tokenizer file?

    Plain BPE with word ends, white space made equal and then dropped, a
    pattern without lookaround, special strings taken as they stand.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("fuse_unk")
    words = bool(model.get("end_of_word_suffix")) and not model.get("continuing_subword_prefix")
    patterns = re.findall(r'"Regex": "((?:[^"\\]|\\.)*)"', json.dumps(spec.get("pre_tokenizer")))
    scans = bool(patterns) and not any("(?" in p for p in patterns)
    normal = _steps(spec.get("normalizer"), "normalizers")
    spaces = any(n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in normal)
    steps = {n["type"] for n in normal}
    return (
        plain and words and scans and spaces and not model.get("ignore_merges") and steps <= {"NFC", "Replace", "Lowercase"}
        and spec.get("post_processor") is None
        and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


def _steps(spec: dict | None, inner: str) -> list[dict]:
    return [] if spec is None else spec[inner] if spec["type"] == "Sequence" else [spec]


@cache
def _joins_back() -> frozenset[str]:
    """Characters that may compose with or move before the one in front."""
    found = {chr(c) for c in range(0x1160, 0x1200)}  # Hangul vowels and finals
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.combining(c):
            found.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def encoded(path: str, text: str, start: int) -> np.ndarray:
    """Rows (start, end, id) of the tokens of a piece that begins at ``start``."""
    e = encoder(path).encode(text, add_special_tokens=False)
    at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + start
    return np.column_stack([at, np.array(e.ids, dtype=np.int64)])


def _boundaries(tokens: np.ndarray) -> np.ndarray:
    """Index of every token that begins where or after the one before it ends."""
    return np.flatnonzero(tokens[1:, 0] >= tokens[:-1, 1]) + 1


def seam(left: np.ndarray, right: np.ndarray, char_at) -> tuple[int, int] | None:
    """(i, j): the encodings go together before token i of ``left``, which is
    token j of ``right``; None where they have no stable common boundary.

    Of several the middle one is taken.  ``char_at(p)`` is the text at p.
    """
    a, b = _boundaries(left), _boundaries(right)
    _, x, y = np.intersect1d(left[a, 0], right[b, 0], assume_unique=True, return_indices=True)
    a, b = a[x], b[y]
    same = (left[a] == right[b]).all(axis=1) & (left[a - 1] == right[b - 1]).all(axis=1)
    found = [(int(i), int(j)) for i, j in zip(a[same], b[same]) if char_at(int(left[i, 0])) not in _joins_back()]
    return found[len(found) // 2] if found else None


def count_in_order(path: str, text: str, chunk: int, overlap: int) -> int:
    """Tokens of one text, piece by piece; every piece starts on a token of
    the one before, and overlaps double until the two agree."""
    a, b = 0, min(len(text), chunk + overlap)
    now, total = encoded(path, text[:b], 0), 0  # tokens of text[a:b]; total: of all before them
    while b < len(text):
        wide = overlap
        while True:
            firsts = now[_boundaries(now), 0]
            starts = firsts[firsts <= b - 2 * wide]
            if not len(starts):  # no room for a wider overlap: a longer piece
                b = min(len(text), a + 2 * (b - a))
                now = encoded(path, text[a:b], a)
                break
            c, end = int(starts[-1]), min(len(text), b + chunk)
            after = encoded(path, text[c:end], c)
            found = seam(now, after, text.__getitem__)
            if found:
                total += found[0]
                now, a, b = after[found[1] :], int(after[found[1], 0]), end
                break
            wide *= 2
    return total + len(now)


def _text(value: pa.Scalar) -> str:
    return value.as_py() or ""


def _count_all(path: str, texts: list[bytes], known: dict[bytes, int]) -> list[int]:
    """Tokens of each text, from its pieces between white space."""
    if not can_cut(path):
        got = encoder(path).encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [len(e) for e in got]
    split = [t.split() for t in texts]
    new = list({w for ws in split for w in ws if w not in known})
    got = encoder(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
    known.update(zip(new, map(len, got)))
    return [sum([known[w] for w in ws]) for ws in split]


@cache
def _known(path: str) -> dict[bytes, int]:
    """What this worker process has counted so far, over its tasks."""
    return {}


def _whole(path: str):
    def run(batches):
        known = _known(path)
        for b in batches:
            texts, counts, at = b.column("text"), [], 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < BATCH:
                    part.append(texts[at].as_buffer().to_pybytes())
                    size += len(part[-1])
                    at += 1
                counts += _count_all(path, part, known)
                if len(known) > KNOWN:
                    known.clear()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def _cut(chunk: int, overlap: int):
    """One row per piece: its number, its first code point and its text."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                text = _text(b.column("text")[i])
                own = {n: [b.column(n)[i].as_py()] for n in ("row", "doc_id", "n_bytes")}
                cuts = range(chunk, len(text) - overlap, chunk)
                for no, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(text)])):
                    x, y = max(0, x - overlap), min(len(text), y + overlap)
                    piece = {"no": [no], "first": [x], "text": [text[x:y]]}
                    yield pa.RecordBatch.from_pydict(own | piece, schema=schema)

    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("no", pa.int64()), ("first", pa.int64()), ("text", pa.string())]
    )
    return run


def _ends(path: str, chunk: int, overlap: int):
    """The tokens around the two cuts of every piece, and how many it has."""
    names = ["row", "no", "n", "head", "tail", "around"]

    def run(batches):
        for b in batches:
            out = {n: [] for n in names}
            for i in range(len(b)):
                no, first, text = b.column("no")[i].as_py(), b.column("first")[i].as_py(), _text(b.column("text")[i])
                tokens = encoded(path, text, first)
                near = [np.abs(tokens[:, :2] - cut).min(axis=1) <= overlap for cut in (no * chunk, (no + 1) * chunk)]
                # tokens stand in order, so what is near a cut is one stretch
                head = tokens[near[0]] if no else tokens[:0]
                tail = tokens[near[1]]
                skipped = int(np.argmax(near[0])) if no and near[0].any() else 0
                after = len(tokens) - int(np.argmax(near[1])) if near[1].any() else 0
                z = max(0, (no + 1) * chunk - overlap - first)
                row = (b.column("row")[i].as_py(), no, len(tokens), _pack(skipped, head), _pack(after, tail), text[z:])
                for n, v in zip(names, row):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema(
        [("row", pa.int64()), ("no", pa.int64()), ("n", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("around", pa.string())]
    )
    return run


def _pack(n: int, tokens: np.ndarray) -> bytes:
    return np.concatenate([[n], tokens.ravel()]).astype("<i8").tobytes()


def _unpack(data: bytes) -> tuple[int, np.ndarray]:
    a = np.frombuffer(data, dtype="<i8")
    return int(a[0]), a[1:].reshape(-1, 3)


def _seams(chunk: int, overlap: int):
    """(row, lost): tokens that the two pieces at a cut hold beyond the
    splice; null where they have no stable common boundary."""

    def run(batches):
        for b in batches:
            lost = []
            for i in range(len(b)):
                after, tail = _unpack(b.column("tail")[i].as_py())
                skipped, head = _unpack(b.column("head")[i].as_py())
                z, around = (b.column("no")[i].as_py() + 1) * chunk - overlap, b.column("around")[i].as_py()
                char_at = lambda p, z=z, s=around: s[p - z : p - z + 1]  # noqa: E731  (no token of the right piece begins before z)
                found = seam(tail, head, char_at) if len(tail) > 1 and len(head) > 1 else None
                lost.append(None if found is None else after - found[0] + skipped + found[1])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(lost, pa.int64())], names=["row", "lost"])

    return run


def _in_order(path: str, chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                pieces = b.column("pieces")[i].as_py()
                text = "".join(p["text"][(overlap if p["first"] else 0) : p["stop"] - p["first"]] for p in pieces)
                n = count_in_order(path, text, chunk, overlap)
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, 1), pa.array([n])], names=["row", "again"])

    return run


def counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``.

    ``path``: tokenizer file of the ``tokenizers`` library, readable at the
    same place on every executor.
    """
    if not 0 < overlap <= chunk // 4:
        raise ValueError("overlap must be positive and at most a quarter of chunk")
    path = path or vocabulary_path()
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long"
    raw = F.col("text").cast("binary").alias("text")
    if not can_cut(path):
        return rows.select("doc_id", "n_bytes", raw).mapInArrow(_whole(path), schema)
    huge = F.length("text") > chunk + overlap
    short = rows.filter(~huge).select("doc_id", "n_bytes", raw).mapInArrow(_whole(path), schema)

    # written once, so that the row numbers stand for good
    pieces = written(
        rows.filter(huge).withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(_cut(chunk, overlap), "row long, doc_id long, n_bytes long, no long, first long, text string"),
        "token-pieces",
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pieces.select("row", "no", "first", "text").repartition(parts, "row", "no")
    ends = written(
        spread.mapInArrow(
            _ends(path, chunk, overlap), "row long, no long, n long, head binary, tail binary, around string"
        ),
        "token-ends",
    )
    heads = ends.filter("no > 0").select("row", (F.col("no") - 1).alias("no"), "head")
    pairs = ends.select("row", "no", "tail", "around").join(heads.hint("merge"), ["row", "no"])
    lost = pairs.mapInArrow(_seams(chunk, overlap), "row long, lost long")
    sums = (
        ends.select("row", F.col("n").alias("n"), F.lit(0).alias("open"))
        .union(lost.select("row", -F.coalesce("lost", F.lit(0)), F.col("lost").isNull().cast("int")))
        .groupBy("row").agg(F.sum("n").alias("n"), F.max("open").alias("open"))
    )
    sums = written(sums, "token-sums")

    stop = ((F.col("no") + 1) * chunk).alias("stop")
    last = F.max(F.struct("no", stop))  # the last piece ends with the text
    again = pieces.join(sums.filter("open = 1").select("row").hint("merge"), "row")
    again = again.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("no", "first", stop, "text"))).alias("pieces"), last.alias("last")
    )
    again = again.select(
        "row",
        F.transform(
            "pieces",
            lambda p: F.struct(
                p["first"].alias("first"),
                F.when(p["no"] == F.col("last.no"), F.lit(2**62)).otherwise(p["stop"]).alias("stop"),
                p["text"].alias("text"),
            ),
        ).alias("pieces"),
    ).mapInArrow(_in_order(path, chunk, overlap), "row long, again long")
    done = sums.join(again.hint("merge"), "row", "left").select("row", F.coalesce("again", "n").alias("n_tokens"))
    named = pieces.filter("no = 0").select("row", "doc_id", "n_bytes").join(done.hint("merge"), "row")
    return short.union(named.select("doc_id", "n_bytes", "n_tokens"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
