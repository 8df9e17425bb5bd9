import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clicklake.llm import subwords

LABELS = "doc_id long, quality int, text string, score double"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture
def few_steps(monkeypatch):
    monkeypatch.setattr(subwords, "STEPS", 300)


@pytest.fixture(scope="module")
def scores(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    return subwords.op12_subwords(spark, folder).collect(), labels, docs


def test_held_out_accuracy(scores):
    rows, labels, docs = scores
    assert len(rows) == docs and len({r["doc_id"] for r in rows}) == docs
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    unseen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(unseen) > 100 and {label for _, label in unseen} == {0, 1}
    assert sum(a == b for a, b in unseen) >= 0.97 * len(unseen)
    assert all(p == 1 for p, label in unseen if label == 1)


def test_labels_of_held_out_rows_are_not_read(spark, sf_dir, few_steps):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(subwords.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (
        {r["doc_id"]: r["score"] for r in subwords.scored(docs, table).collect()} for table in (labels, turned)
    )
    assert one == two and len(set(one.values())) > 50


def test_features_equal_their_definition():
    words = ["a", "été", "日本", "x" * 40, "a-b"]
    found = [set(), set(), set(), set(), set()]
    number = []
    for word_of, bucket in subwords.word_features([w.encode() for w in words]):
        assert (np.diff(word_of) >= 0).all()
        number.append(np.bincount(word_of, minlength=len(words)))
        for word, place in zip(word_of, bucket, strict=True):
            found[word].add(int(place))
    expected = [[1] + [max(0, len(w) + 2 - n + 1) for n in range(1, 5)] for w in words]
    assert np.array(number).T.tolist() == expected
    one, *_ = subwords.word_features([b"a"])
    alone = {int(b) for _, bucket in subwords.word_features([b"a"]) for b in bucket}
    assert alone == found[0] and len(one[0]) == 1


def test_how_far_back_a_word_is():
    words = "a a b a c b d a b a".split() + "a b".split()
    rows = np.array([0] * 10 + [1] * 2)
    codes = np.array([ord(w) - 97 for w in words])
    assert subwords.recurrence(rows, codes).tolist() == [0, 1, 0, 2, 0, 3, 0, 3, 3, 2, 0, 0]


def test_score_equals_a_plain_average(monkeypatch):
    chance = np.random.default_rng(3)
    vectors = chance.normal(0, 1, (subwords.BUCKETS, subwords.DIMENSION)).astype(np.float32)
    layer, bias = chance.normal(0, 1, (2, subwords.DIMENSION)).astype(np.float32), np.array([0.1, -0.2], np.float32)
    texts = ["one two two été one", "", None, " \t ", "x" * 3000 + " y", "a b " * 500]

    def batch():
        row = pa.StructArray.from_arrays([pa.array(range(len(texts)), pa.int64())], ["id"])
        return iter([pa.RecordBatch.from_arrays([row, pa.array(texts)], ["_row", "_text"])])

    def scores():
        found = subwords._scored(vectors, layer, bias, ["id"])(batch())
        return np.concatenate([b.column("_score").to_numpy() for b in found])

    expected = []
    for text in texts:
        words = (text or "").split()
        held, last = [], {}
        for place, word in enumerate(words):
            held += [b for _, bucket in subwords.word_features([word.encode()]) for b in bucket]
            back = place - last[word] if word in last else None
            held.append(subwords.RECURRENCES[0 if back is None else int(np.ceil(np.log2(back))) + 1])
            last[word] = place
        average = vectors[held].mean(0, dtype=float) if held else np.zeros(subwords.DIMENSION)
        sums = layer.astype(float) @ average + bias
        expected.append(1 / (1 + np.exp(sums[0] - sums[1])))
    assert np.allclose(scores(), expected, atol=1e-9)
    for name in ("TOKENS_AT_ONCE", "CHARACTERS_AT_ONCE", "ROWS_AT_ONCE"):
        monkeypatch.setattr(subwords, name, 3)
    assert np.allclose(scores(), expected, atol=1e-9)


def test_odd_documents(spark, odd_documents, few_steps):
    labels = [(i, i % 2, "t", 0.5) for i in range(1, 12)] + [(1, 1, "t", 0.5), (1, None, "t", 0.5), (None, 1, None, None), (2, 7, "t", 0.5)]
    found = subwords.scored(odd_documents, spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == odd_documents.count()
    by_text = {}
    for row in found:
        assert 0 <= row["score"] <= 1 and row["held_out"] == held_out(row["doc_id"])
        by_text.setdefault((row["text"] or "").strip(), set()).add(round(row["score"], 12))
    assert all(len(values) == 1 for values in by_text.values())
    assert set(found[0].asDict()) == {*odd_documents.columns, "held_out", "score", "predicted"}


def test_tables_without_rows(spark, odd_documents, no_documents, few_steps):
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(3, 1, "t", 0.5), (5, 0, "t", 0.5)], LABELS)
    assert subwords.scored(no_documents, some).collect() == []
    assert {(r["score"], r["predicted"]) for r in subwords.scored(odd_documents, none).collect()} == {(0.5, 1)}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(subwords, "TRAIN_ROWS", 10)
    docs = spark.createDataFrame([(n % 40, f"text {n}") for n in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2, None, None) for n in range(40)], LABELS)
    rows = subwords.sample(docs, labels).collect()
    assert len(rows) == 10
    monkeypatch.setattr(subwords, "TRAIN_FEATURES", 0)
    vectors, layer, bias = subwords.trained(subwords.sample(docs, labels))
    assert not vectors.any() and not layer.any() and not bias.any()
