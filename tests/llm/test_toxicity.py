import random
import zlib

import pytest

from pagewright.llm.toxicity import Toxicity, held_out, toxicity_scores, without_toxic

SCHEMA = "doc_id bigint, text string, id int, toxic string, order string, score int"
CFG = Toxicity(sample=600, l1=2.0, epochs=4)


@pytest.fixture(scope="module")
def corpus():
    rng, rows, labels = random.Random(6), [], []
    for i in range(700):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vile,", "rotten", "scum."])
        rows.append((i, " ".join(words), 1, "", "", 1))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_columns(spark, corpus):
    rows, labels = corpus
    docs, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = toxicity_scores(docs, told, CFG).collect()
    truth = dict(labels)
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    fold = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in fold) / len(fold) > 0.97
    # Labels of the held-out fold make no difference.
    flipped = told.withColumn("toxic", __import__("pyspark").sql.functions.expr("if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic)"))
    again = toxicity_scores(docs, flipped, CFG).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in found}
    clean = without_toxic(docs, told, CFG)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in found if not r.predicted}


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (77, 1)], "doc_id bigint, toxic int")
    rows = [(1, None, 1, "", "", 1), (1, None, 1, "", "", 1), (None, "", 1, "", "", 1), (2, "x " * 100_000, 1, "", "", 1), (3, "a", 1, "", "", 1)]
    found = toxicity_scores(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert len(found) == 5 and len({r.score for r in found if r.doc_id != 2}) == 1
    assert not next(r for r in found if r.doc_id is None).held_out
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity_scores(empty, labels).collect() == []
    alone = toxicity_scores(spark.createDataFrame(rows, SCHEMA), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in alone} == {(0.5, 1)}


def test_labels_of_other_documents_take_no_part_of_the_sample(spark, corpus):
    rows, labels = corpus
    docs, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    others = spark.range(10_000, 60_000).selectExpr("id as doc_id", "1 as toxic")
    alone = {(r.doc_id, r.score) for r in toxicity_scores(docs, told, CFG).collect()}
    assert {(r.doc_id, r.score) for r in toxicity_scores(docs, told.unionByName(others), CFG).collect()} == alone


def test_nothing_is_rejected_unless_both_classes_were_seen(spark, corpus):
    rows, _ = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    for labels in ([], [(10_000, 1), (10_001, 0)], [(1, 0)], [(1, 1)]):
        told = spark.createDataFrame(labels, "doc_id bigint, toxic int")
        assert without_toxic(docs, told, CFG).count() == len(rows)
        # A score is judged alike whatever was learned; only the filter holds back.
        assert all(r.predicted == (r.score >= 0.3) for r in toxicity_scores(docs, told, CFG).collect())


def test_few_telling_words_of_a_long_text_are_learned(spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(120):
        words = [f"v{rng.randrange(10**6)}" for _ in range(30_000)]
        if i % 2:
            words[rng.randrange(len(words))] = "scum"
        rows.append((i, " ".join(words), 1, "", "", 1))
        labels.append((i, i % 2))
    docs, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    probes = spark.createDataFrame([(1000, "scum", 1, "", "", 1), (1001, "fine", 1, "", "", 1)], SCHEMA)
    found = {r.doc_id: r.score for r in toxicity_scores(docs.unionByName(probes), told, Toxicity(l1=2.0, bits=24, min_texts=20)).collect()}
    assert found[1000] > found[1001] + 0.2
