import random
import re

import duckdb
import pytest

from clicklake.llm import jaccard
from clicklake.llm.components import components


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows):
    """Component of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    out = []
    for n, (key, _) in enumerate(rows):
        keys = [k for m, (k, _) in enumerate(rows) if root(m) == root(n) and k is not None]
        out.append((key, len(sets[n]), (min(keys, default=None) if sets[n] else key)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, jaccard.similar(frame, **options).collect()), key=repr)


def test_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = connection.execute(jaccard.OP10_SQL).fetchall()
    assert sorted(map(tuple, jaccard.op10_jaccard(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect())) == sorted(rows)


def family(generator, words, copies, edits):
    base = [f"w{generator.randrange(10**6)}" for _ in range(words)]
    for _ in range(copies):
        text = list(base)
        for _ in range(generator.randrange(edits + 1)):
            text[generator.randrange(words)] = f"e{generator.randrange(10**6)}"
        yield " ".join(text)


@pytest.mark.parametrize(("members", "queries"), [(512, 2048), (4, 3)])
def test_families_chains_and_shared_passages(spark, monkeypatch, members, queries):
    # The small blocks make a group of many blocks, with a pivot and members that are not joined with it.
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "QUERIES", queries)
    generator = random.Random(7)
    texts = [t for _ in range(6) for t in family(generator, 60, 12, 4)]
    texts += list(family(generator, 80, 40, 3))
    words = [f"c{n}" for n in range(80)]
    texts += [" ".join(words[n : n + 40]) for n in range(0, 40, 2)]  # each like the next only
    passage = " ".join(f"p{n}" for n in range(30))
    texts += [passage + " " + " ".join(f"q{generator.randrange(10**6)}" for _ in range(k % 25)) for k in range(50)]
    texts += texts[:5] + [texts[0].upper(), "", None, "one", "ONE", "one two", " \t\n", "a b c d", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    generator.shuffle(rows)
    assert found(spark, rows) == brute_force(rows)


def test_the_edge_of_similarity(spark):
    words = [f"w{n}" for n in range(104)]
    base = " ".join(words)  # 100 shingles
    rows = [(5, base), (1, " ".join(words[:79])), (2, " ".join(words[30:104])), (3, " ".join(words[:78]))]
    # 75 of 100 is enough; 70 and 74 are not, but the first and the last are alike.
    assert found(spark, rows) == [(1, 75, 1), (2, 70, 2), (3, 74, 1), (5, 100, 1)]


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    docs = odd_documents.withColumnRenamed("kind", "_class").withColumnRenamed("size", "_group")
    assert sorted(map(tuple, jaccard.similar(docs).collect()), key=repr) == brute_force(rows)
    assert jaccard.similar(no_documents).count() == 0
    assert found(spark, [(None, "a b c"), (None, "A b c"), (4, None)]) == [(4, 0, 4), (None, 1, None), (None, 1, None)]


def test_components(spark):
    generator = random.Random(3)
    links = [(generator.randrange(60), generator.randrange(60)) for _ in range(40)]
    links += [(100 + i, 101 + i) for i in range(40)] + [(200, 200), (201, None)]
    group = {n: n for link in links[:-1] for n in link}
    for _ in group:
        for a, b in links[:-1]:
            group[a] = group[b] = min(group[a], group[b])
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in components(frame).collect()} == group
    assert components(frame.limit(0)).count() == 0


def test_a_class_fetches_its_own_text_only(spark, monkeypatch):
    words = [f"w{n}" for n in range(40)]
    # Pairs of near copies, all below one null id or one repeated id.
    rows = [(None if n % 2 else 7, " ".join([*[f"{w}x{n // 4}" for w in words], f"end{n}"])) for n in range(80)]
    docs = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string")
    fetched, run = [], type(docs).mapInArrow

    def watch(self, function, schema, *more, **named):
        if "_tokens" in str(schema):
            fetched.append(self)
        return run(self, function, schema, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", watch)
    found = jaccard.similar(docs).collect()
    assert len(found) == 100 and {(r["n_shingles"], r["component_id"]) for r in found} == {(37, 7)}
    assert [f.count() for f in fetched] == [100]
