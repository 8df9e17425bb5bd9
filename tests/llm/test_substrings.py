import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clicklake.llm import substrings


def brute_force(rows, length):
    """What the rule says, by a table of the smallest key of every string."""
    bodies = [(key, (text or "").encode()) for key, text in rows]
    first = {}
    for key, body in bodies:
        for p in range(len(body) - length + 1):
            string = body[p : p + length]
            first[string] = min(first.get(string, 2**63 - 1), 2**63 - 1 if key is None else key)
    out = []
    for key, body in bodies:
        gone = [False] * len(body)
        for p in range(len(body) - length + 1):
            if first[body[p : p + length]] < (2**63 - 1 if key is None else key):
                gone[p : p + length] = [True] * length
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        left = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out.append((key, len(body), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, length=50, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, substrings.without_repeats(frame, length=length, **options).collect()), key=repr)


def test_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = connection.execute(substrings.OP4_SQL)
    names = [c[0] for c in cursor.description]
    rows = substrings.op4_substrings(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(cursor.fetchall())


@pytest.mark.parametrize("chunk_bytes", [600, 20_000, substrings.CHUNK])
def test_passages_at_all_offsets(spark, chunk_bytes):
    generator = random.Random(11)
    noise = lambda n: "".join(generator.choice("abcdefgh é日") for _ in range(n))
    passages = [noise(n) for n in (40, 49, 50, 51, 70, 120)]
    texts = [noise(generator.randrange(90)) + generator.choice(passages) + noise(generator.randrange(60)) for _ in range(60)]
    texts += [passages[5] * 3, passages[4] + passages[5], "x" * 49, "x" * 50, "x" * 51, "x" * 300, "", None, texts[3], texts[3], texts[3][5:] + "!"]
    rows = list(enumerate(texts)) + [(7, passages[5]), (7, passages[5] + "again"), (None, passages[5]), (None, texts[0]), (-5, texts[1])]
    generator.shuffle(rows)
    assert found(spark, rows, chunk_bytes=chunk_bytes) == brute_force(rows, 50)


@pytest.mark.parametrize("told", [0, 2, 1000])
def test_heavy_keys_beyond_those_that_are_told(spark, monkeypatch, told):
    monkeypatch.setattr(substrings, "MOST_HEAVY", told)
    generator = random.Random(5)
    passages = ["".join(generator.choice("abcdefgh") for _ in range(90)) for _ in range(6)]
    rows = [(n, passages[n % 6] + str(n) * (n % 4)) for n in range(60)] + [(None, passages[0]), (3, passages[1]), (99, None)]
    assert found(spark, rows, chunk_bytes=400) == brute_force(rows, 50)


@pytest.mark.parametrize("length", [3, 20, 27, 46])
def test_other_lengths(spark, length):
    generator = random.Random(length)
    rows = [(n, "".join(generator.choice("ab") for _ in range(generator.randrange(80)))) for n in range(30)]
    assert found(spark, rows, length=length, chunk_bytes=200) == brute_force(rows, length)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    docs = odd_documents.withColumnRenamed("kind", "_body").withColumnRenamed("size", "_chunk")
    assert sorted(map(tuple, substrings.without_repeats(docs).collect()), key=repr) == brute_force(rows, 50)
    assert substrings.without_repeats(no_documents).count() == 0
    kept = substrings.without_repeats(odd_documents, with_text=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)


@pytest.mark.parametrize("period", substrings.PERIODS)
def test_difference_covers(period):
    places = substrings.difference_cover(period)
    for a in range(period):
        for b in range(period):
            assert any((a + d) % period in places and (b + d) % period in places for d in range(period))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 40))
def test_names_tell_strings_apart(data, length):
    names = substrings.names_of(np.frombuffer(data, np.uint8), length)
    assert len(names) == max(len(data) - length + 1, 0)
    strings = [data[p : p + length] for p in range(len(names))]
    assert len(set(names.tolist())) == len(set(strings))
    assert len({(n, s) for n, s in zip(names.tolist(), strings, strict=True)}) == len(set(strings))


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_names_are_packed_losslessly(values):
    names = np.unique(np.array(values, np.uint64))
    assert np.array_equal(substrings.unpacked_names(substrings.packed_names(names)), names)
