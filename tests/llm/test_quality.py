import zlib

import numpy as np
import pytest

from texts import some_documents
from tidewatt.llm import quality

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in rows if r.quality == 1], [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.06
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_pairs_by_the_sum_of_squares(spark):
    r = np.random.default_rng(1)
    machine = quality.Machine(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    machine.factor = r.normal(size=machine.factor.shape)
    machine.weight = r.normal(size=machine.weight.shape)
    number, value = r.choice(1000, 12, replace=False), r.normal(size=12)
    text = np.zeros(12, np.int64)
    margin, _ = machine.margin(text, number, value, 1)
    v = machine.factor[number] * value[:, None]
    pairs = sum(v[i] @ v[j] for i in range(12) for j in range(i))
    assert margin[0] == pytest.approx(machine.weight[number] @ value + pairs)


def test_gradient():
    r = np.random.default_rng(2)
    column = quality.pa.array([" ".join(r.choice(["a", "b!!", "C", "d1"], 9)) for _ in range(6)])
    data, label = quality.features(column), np.array([0, 1, 1, 0, 1, 0.5])
    machine = quality.Machine(data[3].mean(axis=0), data[3].std(axis=0) + 1e-6)
    before = -np.mean(np.log(machine.score(*data)) * label + np.log(1 - machine.score(*data)) * (1 - label))
    machine.fit(*data, label)
    after = -np.mean(np.log(machine.score(*data)) * label + np.log(1 - machine.score(*data)) * (1 - label))
    assert after < before


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["word", "word", "word", "a b", "a b c", "b c a", None, "c a c a", "", "c"]
    together = quality.features(quality.pa.array(texts, quality.pa.string()))[3]
    alone = [quality.features(quality.pa.array([t], quality.pa.string()))[3][0] for t in texts]
    assert np.array_equal(together, alone)


@pytest.mark.parametrize("labelled", [True, False])
def test_hostile_rows(spark, docs_of, labelled):
    rows = some_documents(3, n=30)
    labels = [(d, i % 2) for i, (d, _) in enumerate(rows)] + [(10**9, 1), (rows[0][0], None)] if labelled else []
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    made = quality.quality_scores(docs_of(rows), table).collect()
    assert sorted(repr(r.doc_id) for r in made) == sorted(repr(d) for d, _ in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in made)
    assert all(0 <= r.score <= 1 for r in made)
    assert quality.keep_good(docs_of(rows), table).columns == docs_of([]).columns


@pytest.mark.parametrize("case", ["no labels", "null labels", "labels of other documents", "all in fold 2"])
def test_nothing_to_train_on_keeps_every_document(spark, docs_of, case):
    rows = some_documents(3, n=30)
    held_out = [(d, i % 2) for i, (d, _) in enumerate(rows) if d is not None and zlib.crc32(str(d).encode()) % 4 == 2]
    assert held_out
    labels = {"no labels": [], "null labels": [(d, None) for d, _ in rows], "labels of other documents": [(10**9 + i, i % 2) for i in range(9)], "all in fold 2": held_out}[case]
    made = quality.keep_good(docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert sorted(repr((r.doc_id, r.text)) for r in made.collect()) == sorted(map(repr, rows))


def test_empty_table(spark, docs_of):
    assert quality.quality_scores(docs_of([]), spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
