"""Prefix trie: against a recursive trie in plain Python, on ties, nulls, absent starts, chains and long lists of ends."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from dealforge.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, a string, depth int"


def brute(rows):
    talks = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            talks[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    talks = {c: [t[1:] for t in sorted(own)] for c, own in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = talks.get(c - c % 100, [])[:h] + own[h:]
    members, children, out = defaultdict(list), defaultdict(set), []
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[x][0] for x in children[node]) or 1
        saved = sum(below[x][1] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below[node] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def run(spark, rows, **more):
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    found = trie.prefix_trie(turns.select("conv_id").distinct(), trie.borrowed(turns), **more)
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2])


def chats(seed, convs, words):
    rng, rows = random.Random(seed), []
    for c in convs:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(words), "x", 1))
    return rows + rows[:5] + [(None, 0, "user", "lost", "x", 1)]


@pytest.mark.parametrize("most", [10_000, 2])
def test_random_conversations(spark, most):
    rows = chats(most, [*range(0, 40), *range(95, 130), 305, 307], ["a", "b", "", None, "né"])
    assert run(spark, rows, most_ends=most) == brute(rows)


def test_hot_start_long_chain_and_copies(spark):
    rows = [(c, t, "user", "same" if t < 3 else f"own {c % 7}", None, 1) for c in range(100, 160) for t in range(8)]
    rows += [(170, t, "user", f"turn {t}", None, 1) for t in range(300)]
    assert run(spark, rows, most_ends=5) == brute(rows)


def test_shared_start_absent_leaves_conversations_without_turns(spark):
    rows = [(c, 0, "user", "only", None, 1) for c in range(201, 215)]
    found = run(spark, rows)
    assert found == brute(rows)
    assert found[0][1] == 0 and found[0][3] == 14


def test_empty_table_has_no_node(spark):
    assert run(spark, []) == []
