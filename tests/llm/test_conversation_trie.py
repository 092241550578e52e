"""The prefix trie against brute force: odd rows, ties, absent and turnless conversations, one long conversation, many alike."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from barwave.llm import conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, words string, depth int, x string, n int, conv int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 3, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def tie(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = []

    def below(path):
        saved = (len(members[path]) - 1) * len(path[-1][1].split()) if path else 0
        leaves = 0 if kids[path] else 1
        for kid in kids[path]:
            s, n = below(kid)
            saved, leaves = saved + s, leaves + n
        ends = ",".join(str(c) for c in sorted(members[path]) if len(made[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return saved, leaves

    if members:
        below(())
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    says = ["hello there", "", None, "one two  three", "x" * 3000, "a\tb\nc", "naïve 中文 😀"]
    out = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(says)) for c in range(-30, 70) if c % 9 != 4 for t in range(rng.randint(1, 9))]
    out += [(200 + i, t, "user", f"turn {t}") for i in range(40) for t in range(6)]  # many alike
    out += [(100, None, "user", "first"), (100, 5, "user", "tie b"), (100, 5, "user", "tie a"), (100, 5, "user", "tie a"), (None, 1, "user", "nobody"), (141, 0, "user", "no base")]
    return out + out[:2]


@pytest.mark.parametrize(("block", "chunk"), [(4, 4096), (3, 7), (1, 1)])
def test_against_brute_force(spark, rows, block, chunk):
    assert found(conversation_trie.rebuilt_trie(frame(spark, rows), block, chunk)) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    long = [(7, t, "user", f"say {t % 5}") for t in range(900)] + [(9, t, "user", f"say {t % 5}") for t in range(700)] + [(11, 0, "user", "say 0")]
    got = conversation_trie.conversation_trie(frame(spark, long))
    assert sorted((tuple(r[c] for c in COLUMNS[:-1]) for r in got.collect()), key=str) == [r[:-1] for r in brute(long, rebuild=False)]
    texts = {(r["conv_id"], r["depth"]): r["text"] for r in got.collect()}
    assert texts[(7, 0)] is None and texts[(7, 900)] == "say 4"


def test_no_rows(spark):
    assert conversation_trie.rebuilt_trie(frame(spark, [])).count() == 0
    assert conversation_trie.rebuilt_trie(frame(spark, [(None, 0, "user", "a")])).count() == 0
