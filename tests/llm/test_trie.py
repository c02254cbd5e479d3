from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from millrace.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, _size int, box string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)


def rebuilt(rows):
    lists = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            lists[conv].append(((turn is not None, turn or 0, said[0], hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()), said))
    own = {c: [said for _, said in sorted(x)] for c, x in lists.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(sequences):
    """The contract's rows for conv_id -> list of (role, text)."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def found(df):
    return sorted(tuple(r) for r in df.select(*trie.NODE).collect())


def chats(draw, n, deep=6, words="abc"):
    rows = []
    for c in range(n):
        for t in range(draw.randrange(deep)):
            rows.append((c, t, draw.choice(["user", "assistant"][: 1 + (t > 0)]), draw.choice(words) * (t + 1)))
    return rows


@pytest.mark.parametrize("container", [1, 7, trie.CONTAINER])
def test_matches_brute_force_whatever_bursts(spark, container):
    draw = random.Random(4)
    rows = chats(draw, 250) + [(1000 + i, t, "user", f"the same long prefix {t}" if t < 30 else f"end {i % 3} {t}") for i in range(9) for t in range(28 + i)]
    draw.shuffle(rows)
    assert found(trie.conversation_trie(table(spark, rows), container)) == brute(rebuilt(rows))


@pytest.mark.parametrize("container", [2, trie.CONTAINER])
def test_odd_rows(spark, container):
    rows = [
        (0, 1, "user", "b"), (0, None, "user", "first of all"), (0, 1, "user", "a"), (0, 1, "assistant", "a"), (0, 0, None, None), (0, 7, "user", "é\U0001f600\x00"),
        (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "user", "x"), (5, 2, "", ""), (5, 1, None, None), (None, 0, "user", "nobody's"), (None, 0, "user", "nobody's"),
        (-3, 0, "user", "below zero"), (-250, 4, "user", "x"), (200, 0, "user", "ab"), (201, 0, "usera", "b"), (104, 9, "user", "no base here"), (107, 1, "user", "long " * 50_000), (108, 1, "user", "long " * 50_000),
    ]
    want = brute(rebuilt(rows))
    assert found(trie.conversation_trie(table(spark, rows), container)) == want
    assert any(not turns for turns in rebuilt(rows).values())  # turnless conversations end at the root


def test_empty_table(spark):
    assert found(trie.conversation_trie(table(spark, []))) == []
    assert found(trie.conversation_trie(table(spark, [(None, 1, "user", "x")]))) == []


def test_hot_first_turn_and_conversation(spark):
    # a third of all conversations are alike, a third begin alike
    rows = [(c, t, "user", f"{t}" if c % 3 == 0 else ("hello" if c % 3 == 1 and t < 7 else f"{c} {t}")) for c in range(0, 90_000, 100) for t in range(9)]
    got = found(trie.prefix_trie(trie.turn_lists(table(spark, rows)), 50))
    lists = defaultdict(list)
    for c, _, role, text in rows:
        lists[c].append((role, text))
    assert got == brute(lists)


@pytest.mark.parametrize("lo, hi, want", [("", "", 0), ("a", "a", 1), ("aab", "aac", 2), ("aaa", "aaaa", 3), ("b", "c", 0), ("a" * 77 + "b", "a" * 77 + "c", 77)])
def test_common_turns(lo, hi, want):
    assert trie.common(*("".join(c * trie.DIGITS for c in s) for s in (lo, hi))) == want
