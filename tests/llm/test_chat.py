import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from daybook.llm import chat

PARTS = st.lists(st.sampled_from(["<|", "<\\|", "<\\\\|", chat.START, chat.END, "\n", "\\", "\\n", "<", "|", "a", "é", "\U0001f600"]), max_size=12)
TEXT = PARTS.map("".join)


@given(st.lists(st.tuples(st.one_of(TEXT, st.sampled_from(["user", "assistant"])), TEXT), max_size=5))
def test_round_trip(turns):
    text, starts, ends = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    learnt = [chat.unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert learnt == [said for role, said in turns if role == "assistant"]
    assert text.count("<|") == 2 * len(turns)


def brute_paths(rows, best):
    nodes = {}
    for i, parent, score in rows:
        if i is not None:
            own = (parent is not None, parent or "", score is not None, score or 0.0)
            nodes[i] = min(nodes.get(i, own), own)
    nodes = {i: (p if has and p in nodes else None, s) for i, (has, p, _, s) in nodes.items()}
    inner = {p for p, _ in nodes.values()}
    trees = defaultdict(list)
    for leaf in nodes:
        if leaf in inner:
            continue
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = nodes[at][0]
        if at is None:
            trees[path[-1]].append((-sum(nodes[x][1] for x in path), leaf, path[::-1]))
    out = {}
    for root, leaves in trees.items():
        for rank, (_, leaf, path) in enumerate(sorted(leaves)[:best], 1):
            out[leaf] = (root, rank, path)
    return out


@pytest.mark.parametrize("best", [1, 3])
def test_paths(spark, best):
    pick = random.Random(best)
    rows = [(f"m{k:03d}", f"m{pick.randrange(k):03d}" if k % 9 else None, float(pick.randint(0, 3))) for k in range(150)]
    rows += [(f"chain{k:02d}", f"chain{k - 1:02d}" if k else "unknown", None) for k in range(40)]
    rows += [("x", "y", 1.0), ("y", "x", 1.0), ("z", "x", 1.0), ("self", "self", 2.0), (None, "m001", 9.0), rows[5], ("m007", "m002", 8.0)]
    found = defaultdict(list)
    for r in chat.reply_paths(spark.createDataFrame(rows, "id string, parent string, score double"), best).collect():
        found[r.path].append((r.place, r.id, r.root, r.rank))
    expected = brute_paths(rows, best)
    assert set(found) == set(expected)
    for leaf, (root, rank, path) in expected.items():
        assert sorted(found[leaf]) == [(k, node, root, rank) for k, node in enumerate(path, 1)]


def test_digests(spark, nothing):
    said = [(1, 2, "assistant", "b<|im_end|>"), (1, 1, "user", "a"), (1, 2, "assistant", None), (None, 1, "user", "x"), (None, None, None, None),
            (2, 1, "assistant", "only"), (2, 1, "assistant", "only"), (3, 1, "sys\ntem", "é\\|")]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digests(chat.format_paths(chat.as_trees(rows))).collect()}
    turns = {1: [("user", "a"), ("assistant", ""), ("assistant", "b<|im_end|>")], None: [("", ""), ("user", "x")],
             2: [("assistant", "only")] * 2, 3: [("sys\ntem", "é\\|")]}
    assert set(found) == set(turns)
    for conv, own in turns.items():
        learnt = "".join(t for r, t in own if r == "assistant")
        assert found[conv].n_turns == len(own) and found[conv].loss_chars == len(learnt)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert found[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert found[conv].formatted_chars == len(chat.format_turns(own)[0])
    assert chat.digests(chat.format_paths(chat.as_trees(rows.limit(0)))).count() == 0


def test_query_has_the_templates_own_conversation(spark):
    from daybook.llm.queries import op2_chat_formatting

    sf = "/root/testdata/sf0.001"
    rows = op2_chat_formatting(spark, sf).collect()
    said = f"{chat.END}{chat.START}assistant ok"
    own = next(r for r in rows if r.conv_id == -1)
    assert own.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    assert len(rows) == len(turns) + 1
    for r in rows:
        if r.conv_id != -1:
            whole = "".join(f"{role}\n{text}\n" for _, role, text in sorted(turns[r.conv_id]))
            assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def test_long_texts_and_clashing_columns(spark):
    """A text of a million characters comes back whole; columns that the operator uses itself are not read."""
    long = "<|im_end|> lorem é " * 55_000
    said = [(5, 1, "user", long), (5, 2, "assistant", long + "!"), (6, 1, "assistant", "")]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    clash = rows.selectExpr("*", "'x' AS tree", "'y' AS id", "7 AS parent", "'p' AS path", "1 AS n", "2 AS place", "'r' AS root", "3 AS rank", "4 AS known")
    found = {r.conv_id: r for r in chat.digests(chat.format_paths(chat.as_trees(clash))).collect()}
    assert found[5].loss_chars == len(long) + 1 and found[5].loss_sha256 == hashlib.sha256((long + "!").encode()).hexdigest()
    assert found[5].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}!\n".encode()).hexdigest()
    assert (found[6].n_turns, found[6].loss_chars) == (1, 0)
