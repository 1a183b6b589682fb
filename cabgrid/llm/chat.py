"""Chat formatting as packed prefix trees.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn.  Inside texts one
backslash goes between ``<`` and ``|`` (after any that stand there), inside
roles backslash, newline and ``<`` become ``\\\\``, ``\\n`` and ``\\l``; both are
reversible, and no control string can stand inside a turn.

A conversation of any length is a run of sorted rows, never one row.  Rows are
range-partitioned by conversation and turn; every task numbers, measures and
hashes the turns of its runs, one after another.  The hash of a path is a
polynomial, so that where a conversation goes on over several tasks, the sums
of the tasks before (one row per task) complete it.  A conversation is cut
into parts: turns that start in the same ``part_chars`` formatted characters.
What a part holds depends on the path alone, so conversations that share their
first turns share their first parts too.  A part has less than ``part_chars``
characters and one turn; most conversations are one part.

Conversations that share their first turns share a path in a prefix tree.
Sorted by the path before them and the hashes of their turns, parts are in
depth-first order, so a range-partitioned sort replaces any tree in memory: a
task walks its sorted parts, keeps the open path, and emits each turn that the
path does not hold yet - once, depth first.  A pack ends after ``pack_chars``
or where the path before it changes; a next one of the same path repeats the
ancestors it needs within the part.  So neither a first turn that a third of
all conversations share nor a very large tree meets in one task: the sort
splits anywhere between two different parts, and of equal parts only the one
of the smallest conversation takes part, found from the parts' keys alone.

A pack holds its text and its nodes (turns): ``start`` and ``end`` in the text,
``position`` (position id of its first character: its distance from the start
of its own conversation), ``parent``, the loss interval (the text of an
assistant turn) and ``attends``, the intervals of its ancestors, which together
with the node's own earlier characters are all it may attend to - and, in a
pack that goes on after the path ``prefix`` (the key of the part that ends
there, else empty), all of that path.  ``convs`` names the parts that end at a
node.  Units are code points; :func:`tokenized` gives the same packs in the
tokens of a vocabulary file.

Defined results: null role or text is empty; a null turn number sorts first,
ties by role and text; a null conv_id is one conversation; repeated rows are
repeated turns; an empty table gives no packs; other columns are ignored.
Rows of one conversation with the same turn number, start of role and start of
text are sorted in one task, in bounded memory.  The contract's digest is one
SHA-256 over a whole conversation, which has no parallel form: the parts of a
conversation of several are read back in order by one task, one at a time.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import left_lookup, written

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
PACK_CHARS = PART_CHARS = 1 << 16
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1CE4E5B9BF58476D1CE4E5  # of the path hash
_OUT, _BACK = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_BACK = {"\\\\": "\\", "\\n": "\n", "\\l": "<"}

NODE = (
    "struct<start:int,`end`:int,position:bigint,parent:int,loss_start:int,loss_end:int,"
    "attends:array<struct<start:int,`end`:int>>>"
)
PACKS = f"text string, nodes array<{NODE}>, convs array<struct<conv_key:string,node:int>>, prefix string"
_INTERVAL = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct(
    [(n, pa.int64() if n == "position" else pa.int32())
     for n in ("start", "end", "position", "parent", "loss_start", "loss_end")]
    + [("attends", pa.list_(_INTERVAL))]
)
_CONV = pa.struct([("conv_key", pa.string()), ("node", pa.int32())])


def escape(text: str) -> str:
    return _OUT.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends."""
    head = START + re.sub(r"[\\\n<]", lambda m: _ROLE_OUT[m[0]], role) + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse_turn(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (turn.startswith(START) and turn.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, text = turn[len(START) : -len(END) - 1].split("\n", 1)
    return re.sub(r"\\.", lambda m: _ROLE_BACK[m[0]], role), unescape(text)


def _placed(
    nodes: list[dict], parent: int, start: int, length: int, loss: tuple[int, int], position: int = 0
) -> dict:
    """The node of a turn that begins at ``start`` and follows ``parent``; one
    without a parent has the given position."""
    up = nodes[parent] if parent >= 0 else None
    attends = []
    if up:
        attends = list(up["attends"])
        if attends and attends[-1]["end"] == up["start"]:  # neighbours in the sequence are one interval
            attends[-1] = {"start": attends[-1]["start"], "end": up["end"]}
        else:
            attends.append({"start": up["start"], "end": up["end"]})
    return {
        "start": start,
        "end": start + length,
        "position": up["position"] + up["end"] - up["start"] if up else position,
        "parent": parent,
        "loss_start": start + loss[0],
        "loss_end": start + loss[1],
        "attends": attends,
    }


class Pack:
    """One packed sequence under construction; it goes on after the path
    ``prefix``, which is ``position`` characters long."""

    def __init__(self, prefix: str = "", position: int = 0):
        self.prefix, self.position = prefix, position
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.convs: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # open turns and their nodes

    def add(self, key: str, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.path)) and self.path[same][0] == turns[same]:
            same += 1
        del self.path[same:]
        for turn in turns[same:]:
            parent = self.path[-1][1] if self.path else -1
            self.path.append((turn, self._emit(turn, parent)))
        self.convs.append({"conv_key": key, "node": self.path[-1][1] if self.path else -1})

    def _emit(self, turn: tuple[str, str], parent: int) -> int:
        text, a, b = format_turn(*turn)
        loss = (a, b) if turn[0] == TRAINED else (0, 0)
        self.nodes.append(_placed(self.nodes, parent, self.size, len(text), loss, self.position))
        self.parts.append(text)
        self.size += len(text)
        return len(self.nodes) - 1

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["".join(self.parts)]),
                pa.array([self.nodes], pa.list_(_NODE)),
                pa.array([self.convs], pa.list_(_CONV)),
                pa.array([self.prefix]),
            ],
            names=["text", "nodes", "convs", "prefix"],
        )


def _step(path: int, role: str, text: str) -> int:
    """The hash of a path with one more turn."""
    turn = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
    return (path * BASE + int.from_bytes(turn, "big")) % PRIME


def _joined(path: int, turns: int, more: int) -> int:
    """The hash of a path that goes on with ``turns`` turns of hash ``more``."""
    return (path * pow(BASE, turns, PRIME) + more) % PRIME


def _hex(path: int) -> str:
    return f"{path:032x}"


def _runs(rows: DataFrame) -> DataFrame:
    """Every turn with its place in its task's run of its conversation:
    (conv_id, role, text, task, n, start, end, before, after).

    ``n`` counts turns, ``start`` and ``end`` formatted characters, ``before``
    and ``after`` are path hashes.
    """
    clean = rows.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    heads = [F.substring(c, 1, 32) for c in ("role", "text")]  # the sort's order, without whole texts as bounds
    keys = ["conv_id", "turn"]
    ordered = clean.repartitionByRange(*keys, *heads).sortWithinPartitions(*keys, "role", "text")

    def run(batches):
        task = TaskContext.get().partitionId()
        last, n, end, after = object(), 0, 0, 0
        for b in batches:
            made = []
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if conv != last:
                    last, n, end, after = conv, 0, 0, 0
                start, before = end, after
                n, end, after = n + 1, start + len(format_turn(role, text)[0]), _step(before, role, text)
                made.append((task, n, start, end, _hex(before), _hex(after)))
            if made:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *map(pa.array, zip(*made))],
                    names=["conv_id", "role", "text", "task", "n", "start", "end", "before", "after"],
                )

    id_type = rows.schema["conv_id"].dataType.simpleString()
    return ordered.select("conv_id", "role", "text").mapInArrow(
        run,
        f"conv_id {id_type}, role string, text string, task long, n long, start long, `end` long,"
        " before string, after string",
    )


def _carried(runs: DataFrame) -> DataFrame:
    """What comes before a run that goes on from earlier tasks:
    (conv_id, task, c_n, c_start, c_path), at most a row per task."""
    ends = runs.groupBy("conv_id", "task").agg(F.max(F.struct("n", "end", "after")).alias("last"))
    several = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("task", "last"))).alias("runs"))

    def run(batches):
        for b in batches:
            at, made = [], []
            for i, own in enumerate(b.column(1).to_pylist()):
                n, start, path = 0, 0, 0
                for r in own:
                    if n:
                        at.append(i)
                        made.append((r["task"], n, start, _hex(path)))
                    last = r["last"]
                    path = _joined(path, last["n"], int(last["after"], 16))
                    n, start = n + last["n"], start + last["end"]
            if made:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), *map(pa.array, zip(*made))],
                    names=["conv_id", "task", "c_n", "c_start", "c_path"],
                )

    id_type = runs.schema["conv_id"].dataType.simpleString()
    return several.filter(F.size("runs") > 1).mapInArrow(
        run, f"conv_id {id_type}, task long, c_n long, c_start long, c_path string"
    )


def _gone_on(path: str, turns: str, more: str) -> Column:
    """Hash of a carried path (null: none) that goes on with a run's."""

    def run(path: pd.Series, turns: pd.Series, more: pd.Series) -> pd.Series:
        joined = (
            m if p is None else _hex(_joined(int(p, 16), int(t), int(m, 16))) for p, t, m in zip(path, turns, more)
        )
        return pd.Series(list(joined), dtype=object)

    run.__annotations__ = {"path": pd.Series, "turns": pd.Series, "more": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(path, turns, more)


def conversations(rows: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The parts of all conversations: (conv_id, part, turns
    array<struct<role, text>>, prefix, position, conv_key).

    ``conv_key`` names the path up to the part's end, ``prefix`` the path
    before it (empty: none), ``position`` is that path's length.
    """
    runs = written(_runs(rows), "turns")
    carried = written(_carried(runs), "carried-turns").withColumnsRenamed({"conv_id": "__c", "task": "__t"})
    on = runs["conv_id"].eqNullSafe(carried["__c"]) & (runs["task"] == carried["__t"])
    zero = F.lit(0).cast("long")
    placed = runs.join(carried, on, "left").select(
        "conv_id",
        (F.col("n") + F.coalesce("c_n", zero)).alias("at"),
        (F.col("start") + F.coalesce("c_start", zero)).alias("position"),
        "c_path",
        "n",
        "before",
        "after",
        "role",
        "text",
    )
    part = F.floor(F.col("position") / part_chars).cast("long").alias("part")
    by = placed.groupBy("conv_id", part).agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"),
        F.min("position").alias("position"),
        F.min(F.struct("at", "c_path", (F.col("n") - 1).alias("n"), "before")).alias("first"),
        F.max(F.struct("at", "c_path", "n", "after")).alias("last"),
    )
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    before = _gone_on("first.c_path", "first.n", "first.before")
    out = by.select(
        "conv_id",
        "part",
        turns.alias("turns"),
        F.when(F.col("position") > 0, before).otherwise(F.lit("")).alias("prefix"),
        "position",
        _gone_on("last.c_path", "last.n", "last.after").alias("conv_key"),
    )
    return written(out, "conversation-parts")


def packs(parts: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """(text, nodes, convs, prefix) of the distinct parts of :func:`conversations`."""
    copies = parts.groupBy("conv_key").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "part")).alias("first"))
    copies = written(copies.filter("n > 1").select("conv_key", "first"), "part-copies")
    one = parts.join(copies, "conv_key", "left").filter(
        F.col("first").isNull() | F.struct("conv_id", "part").eqNullSafe(F.col("first"))
    )
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    ordered = one.withColumn("path", path).repartitionByRange("prefix", "path")
    ordered = ordered.sortWithinPartitions("prefix", "path", "conv_key")

    def run(batches):
        pack = Pack()
        for b in batches:
            for key, turns, prefix, position in zip(*(b.column(i).to_pylist() for i in range(4))):
                if pack.size >= pack_chars or prefix != pack.prefix:
                    if pack.convs:
                        yield pack.batch()
                    pack = Pack(prefix, position)
                pack.add(key, [(t["role"], t["text"]) for t in turns])
        if pack.convs:
            yield pack.batch()

    return ordered.select("conv_key", "turns", "prefix", "position").mapInArrow(run, PACKS)


def tokenized(packed: DataFrame, tokenizer_file: str) -> DataFrame:
    """Packs in tokens: (ids, positions, nodes, convs, prefix), nodes in token
    units; positions count from the start of the pack's part
    (:func:`from_the_start` makes them the conversation's).

    ``tokenizer_file``: a JSON file of the ``tokenizers`` library, read by the
    driver and sent to the tasks once (a vocabulary of some MB, whatever the
    corpus).  A turn's text is encoded apart from its frame, so no token
    crosses a turn or the edge of its loss interval, and shared turns have the
    same tokens in every pack.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        vocabulary = packed.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary.value)
        tokenizer.encode_special_tokens = True  # control strings are ordinary text
        for b in batches:
            for text, nodes, convs, prefix in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids, positions, out = [], [], []
                cuts = [(n["start"], n["loss_start"], n["loss_end"], n["end"]) for n in nodes]
                parts = [text[x:y] for c in cuts for x, y in zip(c, c[1:])]
                codes = [e.ids for e in tokenizer.encode_batch(parts, add_special_tokens=False)]
                for i, n in enumerate(nodes):
                    own = codes[3 * i : 3 * i + 3]
                    size = [len(x) for x in own]
                    loss = (size[0], size[0] + size[1])
                    out.append(_placed(out, n["parent"], len(ids), sum(size), loss))
                    ids += own[0] + own[1] + own[2]
                    positions += range(out[-1]["position"], out[-1]["position"] + sum(size))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids], pa.list_(pa.int32())),
                        pa.array([positions], pa.list_(pa.int32())),
                        pa.array([out], pa.list_(_NODE)),
                        pa.array([convs], pa.list_(_CONV)),
                        pa.array([prefix]),
                    ],
                    names=["ids", "positions", "nodes", "convs", "prefix"],
                )

    return packed.mapInArrow(run, f"ids array<int>, positions array<int>, {PACKS.split(', ', 1)[1]}")


def from_the_start(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """Packs of :func:`tokenized` with positions counted from the start of
    their conversations: the tokens of the parts before are added.

    ``tokens`` and ``parts`` are written tables.  Only keys and counts are
    joined and summed; a path has one length in tokens, whoever shares it.
    """
    leaf = F.element_at("nodes", F.col("c.node") + 1)
    own = tokens.select(F.explode("convs").alias("c"), "nodes").select(
        F.col("c.conv_key").alias("conv_key"), (leaf["position"] + leaf["end"] - leaf["start"]).alias("n")
    )
    several = parts.groupBy("conv_id").agg(F.max("part").alias("last")).filter("last > 0").select("conv_id")
    chain = left_lookup(parts.select("conv_id", "part", "conv_key"), several, ["conv_id"], "inner")
    chain = left_lookup(chain, own, ["conv_key"], "inner")
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    long = chain.select(F.col("conv_key").alias("prefix"), F.sum("n").over(upto).alias("__base")).distinct()
    base = F.coalesce(F.col("__base"), F.lit(0))
    moved = F.transform("nodes", lambda n: n.withField("position", n["position"] + base))
    return left_lookup(tokens, written(long, "path-tokens"), ["prefix"]).select(
        "ids",
        F.transform("positions", lambda p: p + base).alias("positions"),
        moved.alias("nodes"),
        "convs",
        "prefix",
    )


FACTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_FACTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(packed: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Digests of every part, from packs alone: (conv_key, the contract's
    columns, said, learnt).

    ``said`` and ``learnt`` (turns, and text under the loss mask) are kept for
    parts of conversations that have, or may have, several: a part after
    another, or one that ends where the next would start.
    """

    def run(batches):
        for b in batches:
            for text, nodes, convs, prefix in zip(*(b.column(i).to_pylist() for i in range(4))):
                out = []
                for c in convs:
                    n, said, learnt, length, end = _spoken(text, nodes, c["node"])
                    facts = (n, _sha(said), len(learnt), _sha(learnt), length)
                    texts = (said, learnt) if prefix or end >= part_chars else (None, None)
                    out.append((c["conv_key"], *facts, *texts))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in columns[:6]] + [pa.array(x, pa.string()) for x in columns[6:]],
                    names=["conv_key", *_FACTS, "said", "learnt"],
                )

    return packed.mapInArrow(run, f"conv_key string, {FACTS}, said string, learnt string")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _spoken(text: str, nodes: list[dict], leaf: int) -> tuple[int, str, str, int, int]:
    """Turns, what they say, what of it is learnt, formatted length and last
    position of the path to a node."""
    path, at = [], leaf
    while at >= 0:
        path.append(nodes[at])
        at = nodes[at]["parent"]
    said, learnt, length = [], [], 0
    for n in reversed(path):
        role, body = parse_turn(text[n["start"] : n["end"]])
        said.append(f"{role}\n{body}\n")
        learnt.append(unescape(text[n["loss_start"] : n["loss_end"]]))
        length += n["end"] - n["start"]
    return len(path), "".join(said), "".join(learnt), length, path[0]["position"] + path[0]["end"] - path[0]["start"]


def _whole(chain: DataFrame) -> DataFrame:
    """Digests of conversations of several parts, read in order:
    ``chain(whole, part, n_turns, formatted_chars, said, learnt)``."""

    def run(batches):
        last, n, said, chars, learnt, length = None, 0, None, 0, None, 0

        def row():
            values = (last, n, said.hexdigest(), chars, learnt.hexdigest(), length)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["whole", *_FACTS])

        for b in batches:
            for whole, turns, formatted, words, own in zip(*(b.column(i).to_pylist() for i in range(5))):
                if whole != last:
                    if last is not None:
                        yield row()
                    last, n, said, chars, learnt, length = whole, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                n, chars, length = n + turns, chars + len(own), length + formatted
                said.update(words.encode())
                learnt.update(own.encode())
        if last is not None:
            yield row()

    ordered = chain.repartition("whole").sortWithinPartitions("whole", "part")
    columns = ordered.select("whole", "n_turns", "formatted_chars", "said", "learnt")
    return columns.mapInArrow(run, f"whole string, {FACTS}")


def digest(rows: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The contract's columns, with conversation -1 added."""
    hard = END + START + "assistant ok"
    extra = rows.sparkSession.createDataFrame(
        [(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"
    )
    every = rows.select("conv_id", "turn", "role", "text").union(extra)
    parts = conversations(every, part_chars)
    packed = written(packs(parts), "packs")
    facts = written(read_back(packed, part_chars), "read-back")

    members = parts.select("conv_id", "part", "conv_key")
    last = F.max(F.struct("part", "conv_key")).alias("last")
    ends = members.groupBy("conv_id").agg(last).select("conv_id", "last.part", F.col("last.conv_key").alias("whole"))
    ends = written(ends, "conversation-ends")
    one = ends.filter("part = 0").select("conv_id", F.col("whole").alias("conv_key"))
    one = left_lookup(one, facts.select("conv_key", *_FACTS), ["conv_key"], "inner")

    several = ends.filter("part > 0").select("conv_id", "whole")
    chain = left_lookup(members, several, ["conv_id"], "inner").select("whole", "part", "conv_key").distinct()
    told = facts.filter(F.col("said").isNotNull()).select("conv_key", "n_turns", "formatted_chars", "said", "learnt")
    whole = _whole(left_lookup(chain, told, ["conv_key"], "inner"))
    several = left_lookup(several, whole, ["whole"], "inner")
    return one.select("conv_id", *_FACTS).union(several.select("conv_id", *_FACTS))


_HARD = END + START + "assistant ok"
# lengths: an escape adds one character per match, in roles per character
ORACLE = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_HARD}'), (-1, 1, 'assistant', '{_HARD}')),
sized AS (SELECT *, {len(START) + len(END) + 2} + length(role) + len(regexp_extract_all(role, '[\\\\\\n<]'))
    + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) AS formatted FROM every)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{TRAINED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{TRAINED}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
    AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
