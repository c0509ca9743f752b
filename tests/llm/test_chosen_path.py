import os
import random

import numpy as np
import pytest

from pagewright.llm import set_links
from pagewright.llm.chosen_path import ChosenPath, branch, first_of_each_group, near_duplicates
from pagewright.llm.common import components
from pagewright.llm.words import mix, shingle_sets, word_hashes

from .brute import classes, shingles, similar_pairs

DATA = "/root/testdata/sf0.001"


def expected(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = classes(sets, similar_pairs(sets))
    return {(i, len(sets[i]), up[i], up[i] == i) for i in sets}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in near_duplicates(docs).collect()} == expected(rows)


def test_chains_copies_and_large_nodes(spark):
    rng, rows = random.Random(5), []
    for group in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(90)]
        for copy in range(14):
            if copy % 3:
                words[rng.randrange(90)] = f"x{group}{copy}"  # a chain: ends may be dissimilar
            rows.append((100 * group + copy, " ".join(words)))
    rows += [(900 + i, "the same few words") for i in range(5)] + [(990, "A B"), (991, "a\tb"), (992, "a"), (993, ""), (994, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for cfg in (ChosenPath(), ChosenPath(large_node=4, salts=2)):
        assert {tuple(r) for r in near_duplicates(docs, cfg).collect()} == expected(rows)


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id bigint, text string, id int, n string, sketch string, component string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f", 1, "", "", ""), (3, "a b c d e f", 1, "", "", ""), (3, "a b c d e f", 1, "", "", ""), (5, "a b c d e f", 2, "", "", ""), (7, None, 2, "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    found = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (7, 0, 7, True)], key=str)
    left = first_of_each_group(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 3, 7]


def test_word_hashes_are_of_words_alone():
    long = "y" * (1 << 21)
    words, starts, ends, counts = word_hashes([f"One two\x0bone {long}".encode(), b"", b" ONE\n", long.encode()])
    assert counts.tolist() == [4, 0, 1, 1]
    assert words[0] == words[2] == words[4] != words[1] and words[3] == words[5]
    assert [len(s) for s in shingle_sets(words, counts, 2)] == [3, 0, 1, 1]


def test_equal_tokens_stay_together():
    tokens = np.arange(128, dtype=np.uint32).reshape(2, 64)
    tokens[1] = tokens[0]
    children, rows = branch(mix(np.array([9, 9], np.uint64)), tokens)
    assert sorted(children[rows == 0]) == sorted(children[rows == 1])


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5000, 1001)], "a bigint, b bigint").repartition(20)
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000, 5000: 1000}


def test_recall_at_the_threshold_in_the_deepest_nodes(spark):
    # Pairs of 96 shingles each, 11 to 13 of them unlike: similarities 0.76 to 0.80. Every node branches on.
    rng, rows = random.Random(7), []
    for pair in range(2000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        unlike = rng.choice([11, 12, 13])
        other = words[:-unlike] + [f"v{rng.randrange(10**6)}" for _ in range(unlike)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, ChosenPath(large_node=1)).collect()}
    linked = sum(found[2 * p + 1] == 2 * p for p in range(2000))
    assert linked >= 0.999 * 2000 and all(found[2 * p] == 2 * p for p in range(2000))


def test_a_group_of_copies_with_strangers_is_not_compared_with_itself(spark, monkeypatch):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{body} x{i}") for i in range(64)] + [(100 + i, " ".join(f"s{i}{j}" for j in range(20))) for i in range(3)]
    rows.append((200, rows[100 - 36][1] + " end"))  # near a stranger, not the head
    docs = spark.createDataFrame(rows, "id bigint, text string")
    nodes = docs.selectExpr("1L as node", "id", "0L as head")
    read, tiles = spark.sparkContext.accumulator(0), set_links._tiles

    def counted(width, percent):
        run = tiles(width, percent)

        def counting(batches):
            def each():
                for batch in batches:
                    read.add(batch.num_rows)
                    yield batch

            return run(each())

        return counting

    monkeypatch.setattr(set_links, "TILE_TEXTS", 4)
    monkeypatch.setattr(set_links, "_tiles", counted)
    found = set_links.link_within_nodes(nodes, set_links.texts_by_id(docs, nodes), lambda pairs: pairs, 5, 75, 2)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(64)} | {(100, 100), (200, 100)}
    assert 68 <= read.value <= 200  # in tiles of all members, each would be read 17 times
