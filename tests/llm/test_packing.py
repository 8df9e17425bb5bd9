import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clicklake.llm import packing

VOCABULARY = packing.default_vocabulary()


def direct(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check_sequences(rows, capacity):
    by_sequence = defaultdict(list)
    for row in rows:
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_pieces_are_those_of_the_tokenizer(spark, odd_documents):
    rows = packing.pieces(odd_documents, VOCABULARY, length=100, with_ids=True).collect()
    found = defaultdict(list)
    for row in rows:
        assert len(row["ids"]) == row["length"] <= 100
        assert row["start"] == 100 * row["piece"]
        assert zlib.crc32(np.array(row["ids"], "<u4").tobytes()) == row["ids_crc32"]
        found[row["doc_id"]].append((row["piece"], row["ids"]))
    for row in odd_documents.filter("doc_id not in (1, 9)").collect():
        joined = [i for _, ids in sorted(found[row["doc_id"]]) for i in ids]
        assert joined == direct(row["text"])
    assert sorted(ids for _, ids in found[1]) == [direct("one two three four five six seven eight")] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_ids_by_words_equal_ids_of_the_whole_text(texts):
    ids, starts = packing.word_ids(VOCABULARY)(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [direct(t) for t in texts]


def test_learnt_words_are_looked_up_one_by_one(monkeypatch):
    """Neither encoded again, nor put into a new table of all words for each batch; one thread a task."""
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    words = packing.WordIds(packing.default_vocabulary())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    texts = pa.array(["the cat's 12 hats", None, "Été THE"])
    first, _ = words(texts)
    monkeypatch.setattr(words, "_learn", None)
    monkeypatch.setattr(packing.pc, "index_in", None)
    again, _ = words(texts)
    assert again.tolist() == first.tolist()


def test_forgotten_words_are_learnt_anew(monkeypatch):
    words, kept = (packing.WordIds(packing.default_vocabulary()) for _ in range(2))
    texts = [pa.array([text]) for text in ("one two three", "four one", "three five two one")]
    whole = [kept(text)[0].tolist() for text in texts]
    monkeypatch.setattr(packing, "WORDS_KEPT", 1)
    assert [words(text)[0].tolist() for text in texts] == whole


def test_special_tokens_and_case_within_words():
    texts = ["a<|endoftext|>B <|ENDOFTEXT|> İ H̱ K don't it's 12ab  x", "  <|startoftext|> "]
    ids, starts = packing.word_ids(VOCABULARY)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [direct(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_best_fit_and_its_bound(lengths):
    sizes = np.array(lengths)
    bins = packing.best_fit(sizes, 20)
    filled = np.bincount(bins, weights=sizes)
    assert filled.max() <= 20 and filled.min() > 0
    # Plain best fit, bin by bin.
    rooms = []
    for size in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= size]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else 20) - size)
    assert len(rooms) == len(filled)
    assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= len(filled) + 1e-9


def test_bound_of_items_over_half_is_their_number():
    assert packing.lower_bound(np.bincount([11] * 7, minlength=21), 20) == 7


def test_rounds_come_near_the_bound(spark):
    generator = np.random.default_rng(5)
    sizes = [(int(n),) for n in generator.integers(1, 900, 3000)]
    frame = spark.createDataFrame(sizes, "length long")
    rows = packing.packed(frame, 1000, per_part=40)
    used = check_sequences(rows.collect(), 1000)
    row = packing.certificate(rows, 1000).first()
    assert rows.count() == 3000 and row["sequences"] == used
    together = len(set(packing.best_fit(np.array([n for n, in sizes]), 1000).tolist()))
    assert row["bound"] <= used <= together * 1.015 + 1


def test_all_documents_are_packed(spark, sf_dir):
    result = packing.op2_packing(spark, sf_dir)
    rows = result.collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used = check_sequences(rows, 4096)
    by_doc = defaultdict(list)
    for row in rows:
        by_doc[row["doc_id"]].append(row)
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = np.array(direct(text), "<u4")
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        assert [r["ids_crc32"] for r in parts] == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in range(0, len(ids), 4096)]
    assert used == packing.certificate(result).first()["bound"]


def test_uniform_lengths_end_at_their_bound(spark):
    """200,000 lengths, which best fit leaves within 0.05 % of the bound; in parts as well."""
    lengths = np.random.default_rng(7).integers(1, 4097, 200_000)
    frame = spark.createDataFrame(pa.table({"length": lengths, "doc": np.arange(len(lengths))})).repartition(13)
    rows = packing.packed(frame, 4096)
    row = rows.agg(F.sum("length").alias("sum"), F.count_distinct("doc").alias("docs")).first()
    assert (row["sum"], row["docs"]) == (lengths.sum(), len(lengths))
    found = packing.certificate(rows, 4096).first()
    assert found["bound"] <= found["sequences"] <= 1.0005 * found["bound"]


def test_two_lengths_in_many_parts_lose_nothing(spark):
    """Each part has more of one length than it can pair; only an exchange of many sequences mends that."""
    lengths = np.where(np.random.default_rng(3).random(40_000) < 0.5, 2500, 1596)
    frame = spark.createDataFrame(pa.table({"length": lengths}))
    found = packing.certificate(packing.packed(frame, 4096, per_part=2500), 4096).first()
    together = len(set(packing.best_fit(lengths, 4096).tolist()))
    assert found["bound"] <= found["sequences"] <= together


def test_columns_of_other_uses_stay(spark):
    columns = "length long, _part string, _bin int, _to string, c0 int, sequence_id string, `a.b` double, _round int, _open boolean, _bound double"
    rows = [(n % 50 + 1, "p", n, "t", n, "s", 0.5, 1, True, 2.0) for n in range(300)]
    found = packing.packed(spark.createDataFrame(rows, columns), 100, per_part=60)
    assert found.columns == ["length", "_part", "_bin", "_to", "c0", "a.b", "_round", "_open", "_bound", "sequence_id", "offset"]
    kept = sorted(tuple(r)[:9] for r in found.collect())
    assert kept == sorted((r[0], *r[1:5], *r[6:]) for r in rows)
    check_sequences(found.collect(), 100)


@pytest.mark.parametrize("name", ["odd_documents", "no_documents"])
def test_odd_documents_are_packed(request, name):
    docs = request.getfixturevalue(name)
    rows = packing.packed(packing.pieces(docs, VOCABULARY)).collect()
    check_sequences(rows, 4096)
    assert sum(r["length"] for r in rows) == sum(len(direct(r["text"])) for r in docs.collect())
