import math
import re
from collections import Counter

import duckdb
import pytest

from clicklake.llm import lexical


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_force(docs, items, best=10):
    """Rows (item, rank, doc, score) from plain integers."""
    read = [(i, Counter(re.findall(lexical.TERM, lowered(t)))) for i, t in docs]
    read = [(i, c) for i, c in read if c]
    total, words = len(read), sum(sum(c.values()) for _, c in read)
    held = Counter(term for _, c in read for term in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(re.findall(lexical.TERM, lowered(text)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, counts in read:
            m = 10 + (90 * sum(counts.values()) * total) // words
            score = 0
            for term in terms & counts.keys():
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * held[term] + 1)))
                score += w * ((10**9 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda row: row[:3])
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(scored[:best], 1)]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 7)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", 2)
    monkeypatch.setattr(lexical, "TEXT_BYTES", 300)


def test_query_equals_its_sql(spark, sf_dir):
    database = duckdb.connect()
    for name in ("documents", "benchmark"):
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    expected = sorted(database.execute(lexical.OP11_SQL).fetchall(), key=repr)
    found = lexical.op11_lexical(spark, sf_dir)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == expected and expected


def test_small_blocks_and_bundles_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    expected = brute_force(
        [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 3
    )
    assert rows_of(lexical.ranked(docs, items, best=3)) == expected


def test_odd_documents(spark, odd_documents, small_blocks):
    items = [(1, "One two, LAZY dog"), (1, "été"), (2, None), (3, ""), (None, "the id nine? 日本語のテキスト 😀"), (4, "zebra"), (5, "b B b x")]
    asked = spark.createDataFrame([(i, t, "s", 1) for i, t in items], "item_id long, text string, block string, term int")
    expected = brute_force([(r["doc_id"], r["text"]) for r in odd_documents.collect()], items)
    assert rows_of(lexical.ranked(odd_documents, asked)) == expected
    assert {row[0] for row in expected} == {1, None, 5}


def test_ties_go_to_the_smaller_id(spark, small_blocks):
    docs = spark.createDataFrame([(n, "same words here") for n in range(30)] + [(None, "same words here"), (40, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "same")], "item_id long, text string")
    found = [tuple(r)[:3] for r in lexical.ranked(docs.repartition(4), items).orderBy("rank").collect()]
    assert found == [(7, n + 1, n) for n in range(10)]


def test_empty_tables(spark, no_documents, odd_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for docs, items in ((no_documents, some), (odd_documents, none), (no_documents, none)):
        assert lexical.ranked(docs, items).collect() == []


def test_accumulators_are_dropped_only_below_the_best():
    """The bound holds: what a posting adds is under MOST times its weight."""
    for count in (1, 2, 50, 10**6):
        for norm in (10, 100, 10**6):
            assert (10**9 * count) // (1000 * count + 8 * norm) < lexical.MOST
