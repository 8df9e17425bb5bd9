from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clicklake.llm import packing, tokens

from .test_packing import direct

VOCABULARY = packing.default_vocabulary()


def check_rows(rows, docs, length):
    """Every document comes back, id by id, and every row is as its facts say."""
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    found = defaultdict(list)
    for r in rows:
        ids, positions = tokens.matrix([r], length)
        ends = r["cu_seqlens"]
        assert ends[0] == 0 and ends[-1] == r["n_ids"] <= length and r["position_resets"] == ends[:-1]
        assert not ids[0, r["n_ids"] :].any()
        for n, (a, b) in enumerate(zip(ends, ends[1:])):
            assert positions[0, a:b].tolist() == list(range(b - a))
            found[r["doc_ids"][n]].append((r["pieces"][n], r["starts"][n], ids[0, a:b].tolist()))
    expected = defaultdict(list)
    for d in docs:
        ids = direct(d["text"])
        expected[d["doc_id"]] += [(n, s, ids[s : s + length]) for n, s in enumerate(range(0, len(ids), length))]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_all_documents(spark, sf_dir):
    rows = tokens.op7_tokens(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check_rows(rows, docs, 4096)
    total = sum(r["n_ids"] for r in rows)
    assert len(rows) <= -(-total // 4096) + 2


@pytest.mark.parametrize("length", [7, 100])
def test_windows_carry_their_emptiest_sequences(spark, sf_dir, odd_documents, no_documents, monkeypatch, length):
    monkeypatch.setattr(tokens, "WINDOW", 500)
    monkeypatch.setattr(tokens, "CARRIED", 3)
    monkeypatch.setattr(tokens, "TEXT_AT_ONCE", 1000)
    check_rows(tokens.matrices(odd_documents, VOCABULARY, length=length).collect(), odd_documents.collect(), length)
    assert tokens.matrices(no_documents, VOCABULARY).count() == 0


def test_written_and_read_again(spark, odd_documents, tmp_path):
    tokens.write_matrices(odd_documents, VOCABULARY, str(tmp_path / "out"), length=64)
    check_rows(spark.read.parquet(str(tmp_path / "out")).collect(), odd_documents.collect(), 64)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 33), min_size=1, max_size=60))
def test_the_tree_packs_as_plain_best_fit(lengths):
    bins = tokens.packed_bins(np.array(lengths), 33)
    assert sorted(i for items in bins for i in items) == list(range(len(lengths)))
    rooms = []
    for size in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= size]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else 33) - size)
    assert sorted(33 - sum(lengths[i] for i in items) for items in bins) == sorted(rooms)
