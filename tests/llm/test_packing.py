import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm.packing import Packing, Schedule, pack_documents, special_tokens

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"
SPECIALS = special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id bigint, text string, source string, part int, slot string, ids string"


def token_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array(e.ids + [0], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, rows, length=1024):
    """Every id in one piece, no gaps, right sums; at most the last sequence is short."""
    ids = dict(zip([r[0] for r in rows], token_ids([r[1] for r in rows])))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        data = ids[p.doc_id]
        assert p.length > 0 and p.doc_tokens == len(data)
        assert p.ids_crc32 == zlib.crc32(data[p.start : p.start + p.length].tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for doc, data in ids.items():
        at = 0
        for start, n in sorted(by_doc[doc]):
            assert start == at
            at += n
        assert at == len(data)
    for number, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or number == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_documents_keep_the_corpus_shares(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    for cfg in (Packing(window=4), Packing(window=1), Packing(window=2, max_queues=3)):
        pieces = pack_documents(docs.repartition(5), RANKS, PATTERN, cfg).collect()
        check(pieces, rows)
        total, windows = Counter(), defaultdict(Counter)
        for p in pieces:
            total[p.source] += p.length
            windows[p.window][p.source] += p.length
        if cfg.max_queues > 20:
            everything = sum(total.values())
            windows.pop(max(windows))  # the last one may be short
            for window in windows.values():
                for source, n in total.items():
                    assert abs(window[source] - cfg.window * 1024 * n / everything) < 1 + 1e-6


def test_targets_hold_until_a_source_runs_out(spark):
    rows = [(i, "word " * 50, "abc"[i % 3], 1, "", "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    cfg = Packing(length=64, window=8, targets=(("a", 6.0), ("b", 3.0)))
    pieces = pack_documents(docs, RANKS, PATTERN, cfg).collect()
    check(pieces, [r[:2] for r in rows], 64)
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p.window][p.source] += p.length
    assert abs(windows[0]["a"] - 512 * 2 / 3) < 1 and abs(windows[0]["b"] - 512 / 3) < 1 and not windows[0]["c"]
    assert set(windows[max(windows)]) == {"c"}


def test_texts_where_words_are_not_independent(spark):
    hard = ["a  b", "a   b", " a", "a ", "a  ", "a\n b", "a\n  b", "a \nb", "\u3000 x", "a\u3000 b", "don't  'll 12 345", "x" * 3000, "é ü", "<|endoftext|> a", "\x1c a", "\t\t a b", "",
            "<|endoftext|>", "a <|endoftext|><|endoftext|>b", "x<|endoftext| ><|endoftext|>  y", "<|endoftext|"]
    rows = [(i, t, None if i % 2 else "s", 1, "", "") for i, t in enumerate(hard)] + [(99, None, "s", 1, "", "")]
    check(pack_documents(spark.createDataFrame(rows, SCHEMA), RANKS, PATTERN, Packing(specials=SPECIALS)).collect(), [r[:2] for r in rows])


def test_empty_table_and_repeated_rows(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), RANKS, PATTERN).collect() == []
    rows = [(None, "a b", "x", 1, "", ""), (5, "a b", "x", 1, "", ""), (5, "a b", "x", 1, "", "")]
    pieces = pack_documents(spark.createDataFrame(rows, SCHEMA), RANKS, PATTERN).collect()
    assert sum(p.length for p in pieces) == 9 and [p.doc_id for p in pieces].count(5) == 2


def test_schedule_is_gapless_for_any_mixture():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        totals = [int(x) for x in rng.integers(0, 500, n)]
        plan = Schedule(totals, [int(x) for x in rng.integers(0, 4, n)], int(rng.integers(1, 40)))
        seen = []
        for q, total in enumerate(totals):
            at = 0
            while at < total:
                size = min(int(rng.integers(1, 60)), total - at)
                for start, length, _, place in plan.pieces(q, at, size):
                    seen += range(place, place + length)
                at += size
        assert sorted(seen) == list(range(sum(totals)))


@pytest.mark.parametrize("targets", [None, (("s7", 3.0), ("s29", 1.0), (None, 2.0), ("s3", 0.0), ("absent", 5.0))])
def test_every_source_keeps_its_queue_beyond_max_queues(spark, targets):
    rows = [(i, "word " * (5 + i * i % 90), f"s{i % 30}" if i % 31 else None, 1, "", "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    few, many = (
        pack_documents(docs, RANKS, PATTERN, Packing(length=32, window=16, max_queues=n, targets=targets)).collect()
        for n in (4, 256)
    )
    assert sorted(few, key=str) == sorted(many, key=str)
    check(few, [r[:2] for r in rows], 32)
    total, windows = Counter(), defaultdict(Counter)
    for p in few:
        total[p.source] += p.length
        windows[p.window][p.source] += p.length
    if targets is None:
        for window in range(max(windows)):
            for source, n in total.items():
                assert abs(windows[window][source] - 512 * n / sum(total.values())) < 1 + 1e-6
    else:
        assert abs(windows[0]["s7"] - 256) < 1 and abs(windows[0]["s29"] - 512 / 6) < 1 and abs(windows[0][None] - 512 / 3) < 1
