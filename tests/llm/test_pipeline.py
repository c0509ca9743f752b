import os

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm.packing import PIECE
from pagewright.llm.toxicity import toxicity_scores

from .brute import classes, shingles, similar_pairs
from .brute_repeats import removed_bytes
from .test_packing import check

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], DATA).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:-1]]
    assert all(t.columns == docs.columns for t in tables[:-1])
    # Toxicity: what scores below the threshold stays as it is.
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    fine = {r.doc_id for r in toxicity_scores(docs, labels).filter("predicted = 0").collect()}
    assert rows[1] == {i: rows[0][i] for i in fine} and fine
    # Near-duplicates: the smallest id of each class.
    sets = {i: shingles(r.text) for i, r in rows[1].items()}
    up = classes(sets, similar_pairs(sets))
    assert rows[2] == {i: rows[1][i] for i in sets if up[i] == i}
    # Repeated substrings: sizes of what is left.
    left = removed_bytes([(i, r.text) for i, r in rows[2].items()])
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        size, gone, *_ = left[i]
        assert size - gone - 8 <= len(r.text.encode()) <= size - gone  # characters cut through go
        assert r.n_chars == len(r.text) and (gone or r == rows[2][i])
    # Packing.
    assert tables[4].columns == list(PIECE)
    check(tables[4].collect(), [(i, r.text) for i, r in rows[3].items()])
    assert corpus_pipeline.run(spark, DATA).agg({"length": "sum"}).first()[0] == tables[4].agg({"length": "sum"}).first()[0]


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if os.path.isdir(DATA) else pytest.skip("no test data")
    table = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, DATA)
    assert table.collect() == []
