import collections
import hashlib
import random

import pytest
from fixtures import same

from cabgrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = "<|im_end|><|im_start|>assistant ok"


def brute(data):
    by = collections.defaultdict(list)
    for c, t, r, x in [*data, (-1, 0, "user", HARD), (-1, 1, "assistant", HARD)]:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, ts in by.items():
        ts.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in ts).encode()
        learnt = "".join(x for _, _, r, x in ts if r == "assistant")
        chars = sum(len(chat.format_turn(r, x)[0]) for _, _, r, x in ts)
        out.append((c, len(ts), hashlib.sha256(said).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), chars))
    return out


def awkward():
    rng = random.Random(1)
    parts = ["<|im_start|>", "<\\|x", "<\\\\|", "a\nb", "", "ü😀", "<", "|", "\\", "user", "assistant", None]
    data = [(rng.choice([1, 2, 3, 4, None, 9]), rng.choice([0, 1, 2, None]), rng.choice(parts), rng.choice(parts)) for _ in range(60)]
    data += [(100 + i, j, ["user", "assistant"][j % 2], f"t{rng.randrange(3) if j > 1 else 0}") for i in range(120) for j in range(5)]
    data += [(500, 0, "user", "x" * 200_000), (500, 1, "assistant", "y" * 200_000), (501, 0, "user", "x" * 200_000)]
    return data


def test_round_trip_of_awkward_conversations(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    df = df.selectExpr("*", "'x' AS conv_key", "'x' AS turns", "'x' AS path", "1 AS nodes")
    same(chat.digest(df).collect(), brute(awkward()))


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    same(chat.digest(df).collect(), brute([tuple(r) for r in df.collect()]))


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "a<|im_start|>b", "\\", "<<||"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.parse_turn(chat.format_turn(text + "\n<", text)[0]) == (text + "\n<", text)


def test_shared_turns_are_emitted_once_and_ancestors_are_intervals(spark):
    data = [(c, t, "user" if t % 2 == 0 else "assistant", ["q", "a", f"q{c % 2}", f"a{c}"][t]) for c in range(8) for t in range(4)]
    convs = chat.conversations(spark.createDataFrame(data, SCHEMA))
    packs = chat.packs(convs.coalesce(1), 1 << 20).collect()
    nodes = [n for p in packs for n in p.nodes]
    assert sum(len(p.convs) for p in packs) == 8
    if len(packs) == 1:  # one root, one reply, two questions, eight answers
        assert len(nodes) == 1 + 1 + 2 + 8
    for p in packs:
        for n in p.nodes:
            path, up = [], n["parent"]
            while up >= 0:
                path.append(p.nodes[up])
                up = p.nodes[up]["parent"]
            want = {i for a in path for i in range(a["start"], a["end"])}
            seen = {i for a in n["attends"] for i in range(a["start"], a["end"])}
            assert seen == want and n["position"] == len(want)


def test_packs_are_bounded(spark):
    convs = chat.conversations(spark.createDataFrame(awkward(), SCHEMA))
    longest = 200_000 * 2 + 200
    assert all(len(p.text) <= 1000 + longest for p in chat.packs(convs, 1000).collect())


def test_copies_of_a_conversation_are_packed_once(spark):
    """A third of all conversations are equal, others share their first turn."""
    data = [(c, t, "user" if t == 0 else "assistant", ["q", "a"][t] if c % 3 == 0 else ["q", f"a{c % 50}"][t])
            for c in range(600) for t in range(2)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    for size in (1, 1 << 16):
        keys = [c.conv_key for p in chat.packs(chat.conversations(df), size).collect() for c in p.convs]
        assert len(keys) == len(set(keys)) == len({tuple(d[3] for d in data if d[0] == c) for c in range(150)})
    same(chat.digest(df).collect(), brute(data))


def test_empty_table(spark):
    assert chat.packs(chat.conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    same(chat.digest(spark.createDataFrame([], SCHEMA)).collect(), brute([]))


def test_tokens_spell_every_conversation_and_its_loss(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    data = [r for r in awkward() if r[0] is None or r[0] < 500]
    convs = chat.conversations(spark.createDataFrame(data, SCHEMA))
    want = {r.conv_key: [(t.role, t.text) for t in r.turns] for r in convs.collect()}
    seen = set()
    for p in chat.tokenized(chat.packs(convs, 2000), path).collect():
        for c in p.convs:
            nodes, at = [], c.node
            while at >= 0:
                nodes.insert(0, p.nodes[at])
                at = p.nodes[at].parent
            ids = [i for n in nodes for i in p.ids[n.start : n.end]]
            turns = want[c.conv_key]
            spelt = tokenizer.decode(ids, skip_special_tokens=False)
            assert spelt == "".join(chat.format_turn(*t)[0] for t in turns)
            positions = [i for n in nodes for i in p.positions[n.start : n.end]]
            assert positions == list(range(len(ids)))
            learnt = [tokenizer.decode(p.ids[n.loss_start : n.loss_end], skip_special_tokens=False) for n in nodes]
            assert [chat.unescape(x) for x in learnt if x] == [t for r, t in turns if r == chat.TRAINED and t]
            seen.add(c.conv_key)
    assert seen == set(want)


def long_ones():
    """A conversation with a third of all rows, copies of it, branches of it, and short ones."""
    turn = lambda c, t: (c, t, ["user", "assistant"][t % 2], f"{t} <|im_end|> " + "é" * (t % 50))
    data = [turn(1, t) for t in range(900)]
    data += [turn(c, t) for c in (2, 3) for t in range(300)]  # the first 300 turns of it, twice
    data += [(3, 300, "user", "another way"), (4, 0, "user", "z" * 900), (4, 1, "assistant", "short")]
    data += [(5, 0, "user", "x" * 50)] + [(None, None, "assistant", f"{i % 7}") for i in range(200)]
    return data + [(c, t, "user", f"{c} {t}") for c in range(1000, 1300) for t in range(2)]


@pytest.mark.parametrize("part_chars", [1, 100, 1000, 1 << 16])
def test_conversations_go_on_over_parts_and_tasks(spark, part_chars):
    for data in (long_ones(), awkward()[:800]):
        df = spark.createDataFrame(data, SCHEMA).repartition(4)
        same(chat.digest(df, part_chars).collect(), brute(data))


def test_no_row_holds_a_long_conversation(spark):
    """Runs of several tasks, parts and packs are bounded, and positions go on over parts."""
    data = long_ones()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, SCHEMA).repartition(4)
        runs = chat._runs(df)
        assert runs.filter("conv_id = 1").select("task").distinct().count() > 1
        parts = chat.conversations(df, 500)
        packs = chat.packs(parts, 500).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    longest = max(len(chat.format_turn(r or "", x or "")[0]) for _, _, r, x in data)
    rows = parts.collect()
    assert max(sum(len(chat.format_turn(*t)[0]) for t in p.turns) for p in rows) < 500 + longest
    assert max(len(p.text) for p in packs) <= 1000 + 2 * longest
    ends = {c.conv_key: p.nodes[c.node] for p in packs for c in p.convs}
    assert set(ends) == {p.conv_key for p in rows} and len(ends) == sum(len(p.convs) for p in packs)
    for p in packs:  # a part starts where the path before it ends
        root = p.nodes[0]
        want = ends[p.prefix].position + ends[p.prefix]["end"] - ends[p.prefix].start if p.prefix else 0
        assert root.position == want
    by = collections.defaultdict(list)
    for p in sorted(rows, key=lambda p: p.part):
        by[p.conv_id].append(p)
    for own in by.values():  # the parts of a conversation are a chain
        assert [p.prefix for p in own] == ["", *[p.conv_key for p in own[:-1]]]
    shared = [p.conv_key for p in by[2]]
    assert shared[:-1] == [p.conv_key for p in by[1]][: len(shared) - 1] == [p.conv_key for p in by[3]][: len(shared) - 1]


def test_path_hashes_join():
    turns = [("user", "a"), ("assistant", ""), ("user", "a"), ("", "b")]
    for cut in range(5):
        left = right = 0
        for t in turns[:cut]:
            left = chat._step(left, *t)
        for t in turns[cut:]:
            right = chat._step(right, *t)
        whole = chat._joined(left, len(turns) - cut, right)
        assert cut == 0 or whole == chat._joined(0, 4, seen)
        seen = whole


def test_token_positions_go_on_over_parts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    data = [r for r in long_ones() if r[0] is None or r[0] < 1010]
    df = spark.createDataFrame(data, SCHEMA)
    whole = {}
    for part_chars in (1 << 20, 300):
        parts = chat.conversations(df, part_chars)
        tokens = chat.written(chat.tokenized(chat.packs(parts, 1000), path), "test-tokens")
        done = chat.from_the_start(tokens, parts).collect()
        assert len(done) == tokens.count()
        found = {}
        for p in done:
            for c in p.convs:
                own, at = [], c.node
                while at >= 0:
                    n = p.nodes[at]
                    assert p.positions[n.start : n.end] == list(range(n.position, n.position + n["end"] - n.start))
                    own = list(zip(p.positions[n.start : n.end], p.ids[n.start : n.end])) + own
                    at = n.parent
                found[c.conv_key] = own
        said = {}
        for r in sorted(parts.collect(), key=lambda r: r.part):
            said.setdefault(r.conv_id, []).extend(found[r.conv_key])
        for own in said.values():
            assert [a for a, _ in own] == list(range(len(own)))
        whole[part_chars] = said
    assert whole[1 << 20] == whole[300]
