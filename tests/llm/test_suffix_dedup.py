import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm.deep_shallow import prefix_classes, sort_distinct
from pagewright.llm.suffix_dedup import Repeats, repeated_bytes, without_repeats

from .brute_repeats import removed_bytes

DATA = "/root/testdata/sf0.001"


def found(docs, cfg=Repeats()):
    return {r.doc_id: tuple(r)[1:] for r in repeated_bytes(docs, cfg).collect()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(7)
    assert found(docs) == removed_bytes([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("cfg", [Repeats(), Repeats(large_group=3), Repeats(task_rows=5), Repeats(length=40, gram=16)])
def test_overlaps_edges_and_periods(spark, cfg):
    rng = random.Random(cfg.length + cfg.task_rows)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(90, 400))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randrange(20, 300)], "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 60)))]
        rows.append((i * 3 - 20, "".join(parts)))
    rows += [(1000, "a" * 5000), (1001, "ab" * 700 + "a" * 300), (1002, ""), (1003, None), (1004, passages[0]), (1005, passages[0])]
    rows += [(1004, passages[0])]  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(docs, cfg) == removed_bytes(rows, cfg.length)


def test_long_text_over_chunks(spark):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 1_200_000, dtype=np.uint8)).decode()
    rows = [(1, long), (2, "head " + long[900_000:1_100_000] + " tail"), (3, long[:300] + long[500_000:500_150])]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == removed_bytes(rows)


def test_empty_table_null_ids_and_stage(spark):
    schema = "doc_id bigint, text string, n_chars bigint, ranges string, tag int, doc string"
    assert repeated_bytes(spark.createDataFrame([], schema)).collect() == []
    passage = "é" * 30 + "".join(random.Random(2).choices("abcdefghij", k=200))
    rows = [(None, passage, 230, "", 1, ""), (4, "x" + passage, 231, "", 1, ""), (9, "y" + passage + "z", 232, "", 1, ""), (11, None, None, "", 1, "")]
    docs = spark.createDataFrame(rows, schema)
    assert found(docs) == removed_bytes([r[:2] for r in rows])
    left = {r.doc_id: (r.text, r.n_chars) for r in without_repeats(docs).collect()}
    assert left == {None: ("", 0), 4: ("x" + passage, 231), 9: ("yz", 2), 11: (None, None)}


@pytest.mark.parametrize("cfg", [Repeats(), Repeats(large_group=3)])
def test_many_texts_under_one_id_or_none(spark, cfg):
    rng = random.Random(7)
    passages = ["".join(rng.choices("abcdefghij", k=260)) for _ in range(4)]
    texts = []
    for i in range(900):  # far more than it takes for 14 bits of hash to collide
        a = rng.randrange(100)
        # Passages at the same position of different texts, too.
        texts.append(f"{i:05}" + rng.choice(passages)[a : a + rng.randrange(100, 160)] + f"{i * 7:06}")
    for shared in (None, 5):
        rows = [(shared, t) for t in texts] + [(shared, texts[0]), (1, passages[0][:120])]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
        ordered = [r.text for r in docs.filter("text like '0%'").distinct().orderBy(F.xxhash64("text")).collect()]
        by_text = {t: 100 + i for i, t in enumerate(ordered)}
        truth = removed_bytes([(1, passages[0][:120])] + [(i, t) for t, i in by_text.items()], cfg.length)
        expected = sorted(truth[1 if t == passages[0][:120] else by_text[t]] for _, t in rows)
        assert sorted(tuple(r)[1:] for r in repeated_bytes(docs, cfg).collect()) == expected


def test_sorting_orders_and_shares():
    rng = random.Random(4)
    for _ in range(60):
        items = list({(rng.randrange(3), b"abcdefgh" * rng.randrange(6) + bytes(rng.choice([0, 97, 255]) for _ in range(rng.randrange(5)))) for _ in range(40)})
        strings, group = [s for _, s in items], np.array([g for g, _ in items])
        order, common = sort_distinct(strings, group)
        assert order.tolist() == sorted(range(len(items)), key=lambda i: items[i])
        for before, i, n in zip(order, order[1:], common[1:]):
            same = group[before] == group[i]
            assert n == (len(os.path.commonprefix([strings[before], strings[i]])) if same else -1)
    place, common, sizes = prefix_classes([b"ab", b"ab", b"abc", b""], np.zeros(4, int))
    assert place.tolist() == [1, 1, 2, 0] and common.tolist() == [-1, 0, 2] and sizes.tolist() == [2, 2, 3, 0]


def test_clashing_columns_of_the_stage(spark):
    text = "".join(random.Random(4).choices("abcdefghij", k=300))
    docs = spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id bigint, text string")
    names = ("_doc", "_key", "_ranges", "doc", "key", "ranges", "row", "start")
    left = without_repeats(docs.select("*", *(F.lit(n).alias(n) for n in names))).collect()
    assert {(r.doc_id, r.text) for r in left} == {(1, text), (2, "x")}
    assert all(r[n] == n for r in left for n in names)
