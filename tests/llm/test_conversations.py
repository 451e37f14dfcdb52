import hashlib
import math
import random
import re
import zlib

import pytest
from conftest_llm import rows

from wheelbase.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(table):
    own = {}
    for conv, turn, role, text in table:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        children = {m for m in below if len(m) == len(node) + 1}
        leaves = sum(not any(len(k) == len(m) + 1 and k[:len(m)] == m for k in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ending = sorted(c for c in convs if whole[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), leaves, saved,
                    hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed, n):
    rng = random.Random(seed)
    opening = [("system", "be kind  and  brief"), ("user", "hello"), (None, None), ("user", ""), ("", "hello")]
    made = []
    for conv in range(n):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            role, text = rng.choice(opening[:2] if turn < 2 else opening)
            made.append((conv, None if rng.random() < 0.05 else turn, role, text if rng.random() < 0.8 else f"word {rng.randint(0, 5)} more"))
    # equal turn numbers only with equal content, as their order is then no question
    unique = {}
    for row in made:
        unique.setdefault((row[0], row[1]), row)
    return list(unique.values())


COPIES = [(c, t, "user", f"same {t}") for c in range(1000, 1090) for t in range(6)]
LONG = [(2000 + k, t, "user", f"turn {t if t < 55 + k else -t}") for k in range(6) for t in range(70)]


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 100_000])
def test_trie_equals_brute_force_however_it_is_cut(spark, shard_turns):
    data = [*table(5, 90), *COPIES, *LONG, (None, 0, "user", "no id"), (-7, 3, "a", "negative"), (-20, 1, "a", "lead"), (5000, 0, "user", "twice"), (5000, 0, "user", "twice")]
    random.Random(1).shuffle(data)
    got = rows(conversation_trie.trie(spark.createDataFrame(data, SCHEMA), shard_turns), *conversation_trie.RESULT)
    assert got == brute(data)


def test_turnless_conversations_no_rows_and_clashing_columns(spark):
    alone = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    data = [(alone, 0, "user", "a"), (alone, 1, "user", "b")]
    frame = spark.createDataFrame(data, SCHEMA)
    assert rows(conversation_trie.trie(frame)) == brute(data) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert rows(conversation_trie.trie(frame.limit(0))) == []
    data = table(9, 40)
    frame = spark.createDataFrame(data, SCHEMA)
    more = frame.selectExpr("*", "1 AS id", "2 AS ids", "3 AS words", "4 AS digest", "5 AS key", "6 AS n", "7 AS part", "8 AS lead", "9 AS h", "'x' AS salt")
    assert rows(conversation_trie.trie(more)) == brute(data)


def test_ids_are_hashed_across_pieces(spark):
    data = [(c, 0, "user", "hi") for c in range(0, 3 * conversation_trie.PIECE)]
    assert rows(conversation_trie.trie(spark.createDataFrame(data, SCHEMA).repartition(5))) == brute(data)


def test_medians_and_the_tree():
    for n in (0, 1, 2, 9, 100):
        assert sorted(conversation_trie.medians(n)) == list(range(n))
    tree = conversation_trie.TernaryTree()
    for i in conversation_trie.medians(1023):
        tree.insert([i], [1])
    depths, stack = [], [(tree.down[0], 1)]
    while stack:
        node, depth = stack.pop()
        if node >= 0:
            depths.append(depth)
            stack += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert len(depths) == 1023 and max(depths) == 10
    assert [tree.turn[v] for v in tree.walk()][1:] == list(range(1023))
