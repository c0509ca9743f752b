import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm.prefix_trie import RangeMinimum, Trie, conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Every prefix of every rebuilt conversation, by a dictionary."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in turns.items()}
    rebuilt = {}
    for c, told in own.items():
        h = crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + told[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves, saved = (0 if children[p] else 1), (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for child in children[p]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for p, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if rebuilt[c] == p)
        parent = min(members[p[:-1]]) if p else None
        leaves, saved = below(p)
        out.append((min(found), len(p), parent, len(found), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows, cfg):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = turns.select("*", F.lit(1).alias("block"), F.lit("x").alias("path"), F.lit(2).alias("n"), F.lit(3).alias("key"))
    got = [tuple(r) for r in conversation_trie(turns, cfg).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def conversations(seed, convs, deepest, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * convs), convs):
        for t in range(rng.randrange(deepest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("block_bytes", [60, 400, 16 << 20])
def test_equals_brute_force_in_blocks_of_any_size(spark, block_bytes):
    check(spark, conversations(block_bytes, 150, 9, ["a", "bb", "é漢", ""]), Trie(block_bytes, 3))


def test_common_first_turn_and_copies_over_many_blocks(spark):
    rows = [(c, t, "user", "hello" if t < 7 else str(c % 5) * (c % 3)) for c in range(130) for t in range(7 + c % 4)]
    check(spark, rows, Trie(200, 4))


def test_nulls_ties_repeats_and_long_conversations(spark):
    rows = [
        (None, 0, "user", "lost"), (5, None, "user", "b"), (5, 0, "user", "c"), (5, 0, "user", "c"), (6, 0, None, None),
        (7, 0, "", ""), (0, 1, "user", "x"), (0, 2, "user", "y"), (203, 0, "u", "s"), (-7, 3, "user", "\\"), (2**40, 0, "a", "b"),
        *((9, t, "user", "long " * (t % 3)) for t in range(900)), *((10, t, "user", "long " * (t % 3)) for t in range(880)),
    ]
    check(spark, [r for r in rows if r[0] != -7], Trie(500, 2))


def test_empty_table_and_no_texts(spark):
    check(spark, [], Trie())
    check(spark, [(3, None, None, None)], Trie())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.data())
def test_extents_by_range_minima(values, data):
    row = data.draw(st.integers(0, len(values) - 1))
    least = data.draw(st.integers(0, 6))
    table = RangeMinimum(np.array(values, np.int64))
    right = row
    while right + 1 < len(values) and values[right + 1] >= least:
        right += 1
    left = row
    while left > 0 and values[left] >= least:
        left -= 1
    at, d = np.array([row]), np.array([least])
    assert table.right(at, d)[0] == right and table.left(at, d)[0] == left
    assert table.minimum(np.array([left]), np.array([right]))[0] == min(values[left : right + 1])
